"""What each filter of a chain removes, in every order of the chain, by a relational word pipeline.

Five conditions fail a document: A, it has fewer than ``MIN_WORDS`` words; B, under half of its words are distinct; C,
over 3 % of its characters are A-Z; D, it holds a mark of ``MARKS``; E, a document of smaller id has the same text.

Words are exploded, counted by (text, word), and these by text into totals and distincts. The key of a text is a hash of
128 bits, and equal texts are one, so that copies are split into words once; texts are dealt by that key, on which both
counts stand, so no word is ever shuffled. Labels join on ids, first holders on (text, id) and the words' flags on
texts: outer joins of rows that were grouped before, so a group of copies of any size is a few rows a task. Which filters
a document fails is one of 32 patterns, whose counts are 32 columns for each part and label; every order and step is a
sum over some of them.

Words are maximal runs without ASCII white space, case counts. Null texts and parts count as empty. Null ids have no
smaller id, and are smaller than none; they have no labels. Rows that repeat an id and a text are documents each, and
none of them has a smaller id for the other's sake. Of repeated labels any that says 1 counts. An empty table gives no
rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, keep

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
MARKS = "[#$%&*|]"
WHITE = r"[\x20\x09-\x0D]+"
PATTERNS = 1 << len(FILTERS)


def word_counts(texts: DataFrame) -> DataFrame:
    """(k0, k1, n_words, n_distinct) of texts(k0, k1, text); texts without words give no row."""
    words = texts.select("k0", "k1", F.explode(F.split("text", WHITE)).alias("word")).where("word <> ''")
    each = words.groupBy("k0", "k1", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("k0", "k1").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def text_failures(rows: DataFrame) -> DataFrame:
    """(k0, k1, least, a, b, c, d) of rows(k0, k1, doc_id, text): the least id of each text, and what it fails."""
    upper = F.regexp_count("text", F.lit("[A-Z]")) * F.lit(100).cast("bigint") > F.length("text") * F.lit(MAX_UPPER).cast("bigint")
    marked = rows.select("k0", "k1", "doc_id", upper.alias("c"), F.col("text").rlike(MARKS).alias("d"))
    flags = marked.groupBy("k0", "k1").agg(F.min("doc_id").alias("least"), F.first("c").alias("c"), F.first("d").alias("d"))
    once = rows.groupBy("k0", "k1").agg(F.first("text").alias("text"))
    both = flags.join(word_counts(once), ["k0", "k1"], "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    return both.select("k0", "k1", "least", (n < MIN_WORDS).alias("a"), (100 * distinct < MIN_DISTINCT * n).alias("b"), "c", "d")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, a, b, c, d, e, n): documents of each part and label that fail these filters and no others."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("k1"), text.alias("text"))
    told = keep(text_failures(rows), "told")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(is_one("quality"), is_one("toxic"))
    each = rows.groupBy("doc_id", "part", "k0", "k1").agg(F.count(F.lit(1)).alias("n"))
    labelled = each.join(marks, "doc_id", "left")
    firsts = told.select("k0", "k1", F.col("least").alias("doc_id"), F.lit(True).alias("first"))
    flagged = labelled.join(firsts, ["k0", "k1", "doc_id"], "left")
    no = F.lit(False)
    by_text = flagged.groupBy("k0", "k1", "part", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("e")).agg(F.sum("n").alias("n"))
    out = by_text.join(told.drop("least"), ["k0", "k1"])
    counted = out.groupBy("part", "good", "toxic", "a", "b", "c", "d", "e").agg(F.sum("n").alias("n"))
    kept = keep(counted, "counted")
    drop(told)
    return kept


def _total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns, F.lit(0).cast("bigint"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality, toxic); a row for each part, order of the filters and step."""
    pattern = _total([F.col(f).cast("bigint") * (1 << i) for i, f in enumerate(FILTERS.lower())])
    found = failures(docs, labels).withColumn("pattern", pattern)

    def counts(of: Column, name: str) -> list[Column]:
        return [F.sum(F.when((F.col("pattern") == p) & of, F.col("n")).otherwise(0)).alias(f"{name}{p}") for p in range(PATTERNS)]

    wide = found.groupBy("part").agg(*counts(F.lit(True), "all"), *counts(F.col("good"), "good"), *counts(F.col("toxic"), "toxic"))
    arrays = wide.select("part", *(F.array(*(f"{k}{p}" for p in range(PATTERNS))).alias(k) for k in ("all", "good", "toxic")))
    steps = [(order, i + 1, reduce(int.__or__, (1 << FILTERS.index(x) for x in order[:i]), 0), 1 << FILTERS.index(order[i])) for order in map("".join, permutations(FILTERS)) for i in range(len(FILTERS))]
    literal = F.from_json(F.lit(str([list(s) for s in steps]).replace("'", '"')), "array<array<string>>")
    rows = arrays.select("*", F.explode(literal).alias("s")).select(
        "part", "all", "good", "toxic", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.col("s")[2].cast("int").alias("before"), F.col("s")[3].cast("int").alias("own")
    )
    both = F.col("before").bitwiseOR(F.col("own"))

    def summed(counts: str, fits) -> Column:
        """The counts of the patterns that fit."""
        each = F.transform(counts, lambda n, p: F.when(fits(p), n).otherwise(0))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)

    fails = lambda p, mask: p.bitwiseAND(mask) != 0
    here = lambda p: fails(p, F.col("own")) & ~fails(p, F.col("before"))
    out = rows.select(
        "part", "filter_order", "step", "own",
        summed("all", lambda p: ~fails(p, both)).alias("kept"), summed("all", here).alias("removed"),
        summed("all", lambda p: fails(p, F.col("own")) & fails(p, F.col("before"))).alias("redundant"),
        summed("all", lambda p: p == F.col("own")).alias("unique_fails"),
        summed("good", here).alias("good_lost"), summed("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
