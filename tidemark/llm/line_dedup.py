"""Line dedup with DataFrame functions only: repeated runs of lines from a suffix array by prefix doubling.

Each document is a sequence of line ids (a line without the white space around it; empty lines are skipped). Prefix
doubling ranks suffixes by their first 1, 2, 4, ... lines: a rank is the place of a pair of ranks in the range-sorted
table of pairs that occur more than once, so ranks keep the suffixes' order and every task sorts its own range. A
suffix whose prefix is unique leaves, as it can start no repeated run of that length.

A run counts from ``min_words`` words on. Suffixes that share their first m lines are one longest-common-prefix interval
of depth m or more, and a maximal repeated run is such an interval at its full depth. Here intervals are cut at the
depths that suffice: a run's windows are, for each of its lines, the shortest part of it with that many words that
begins there and the one that ends there. This deletes the same lines as whole runs do. Every line of a run is in a
window of it, and where the run is a later copy, so is each of its windows, as the run's first place has them earlier.
Conversely a window that has an earlier copy is a repeated run itself. So doubling can stop at the length of the longest
window (``min_words`` lines at most, however long runs are). A window of m lines is named by the ranks of its first and
its last 2^k lines, 2^k <= m.

The least (doc_id, hash of text, line) of an interval stays; every later window is deleted, but for lines that it has
in common with the first, where a run overlaps itself. Intervals of so many windows that they could make a task slow are
few; their heads are broadcast, all others joined.

Lines are compared without the white space (U+0020, U+0009, U+000B to U+000D) around them; lines of nothing else are
blank: they are in no run and stay, but for those that directly follow a deleted line. Null texts stay null and null ids
sort first; empty texts stay empty. Rows with equal id and text are one document here and all get the same result. An
empty table gives an empty result. All columns of the input are returned, whatever their names, text without the deleted
lines (and n_chars set to its length, if there is such a column), then n_lines and n_deleted, which may be named
otherwise where the input has such columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, keep
from .columns import spare

MIN_WORDS = 50
#: White space within a line.
WHITE = " \t\r\x0b\x0c"
#: Windows of an interval from which its head is broadcast; raised with the number of windows, so that there are at most HOT_HEADS such.
HOT, HOT_HEADS = 500, 20_000
DOC = ["ld_d", "ld_t"]


def _doc_key(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.withColumns({"ld_d": F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63))), "ld_t": F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))})


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(ld_d, ld_t, pos, h, h2, w) of every line that isn't empty; pos counts such lines."""
    trimmed = F.filter(F.transform(F.split(F.col(text_column), "\n"), _bare), lambda x: x != "")
    ids = F.transform(trimmed, lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("h2"), F.size(F.split(x, f"[{WHITE}]+")).alias("w")))
    return _doc_key(docs.select(id_column, text_column), id_column, text_column).select(*DOC, F.posexplode(ids).alias("pos", "l")).select(*DOC, "pos", "l.h", "l.h2", "l.w")


def _ranks(pairs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The keys that occur more than once, with their rank in sorted order."""
    often = pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return keep(often.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), label)


def _shortest(weights: Column, least: int) -> Column:
    """Lines, from the first of ``weights`` on, that have ``least`` words together; 0 if all of them have fewer."""
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("n"))
    total = F.aggregate(weights, start, lambda a, x: F.when(a["s"] < least, F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))
    return F.when(total["s"] >= least, total["n"]).otherwise(F.lit(0))


def deleted_intervals(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(ld_d, ld_t, gone): for each document with deletions, array of struct(first, last) over its lines."""
    lines = keep(_lines(docs, id_column, text_column), "lines")
    names = _ranks(lines, ["h", "h2"], "names")
    active = lines.join(names, ["h", "h2"]).select(*DOC, "pos", "w", "rank").repartition(*DOC).dropDuplicates([*DOC, "pos"])
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    island = active.withColumn("island", F.col("pos") - F.row_number().over(by_doc))
    run = Window.partitionBy(*DOC, "island").orderBy("pos")
    ahead, behind = F.collect_list("w").over(run.rowsBetween(0, min_words - 1)), F.collect_list("w").over(run.rowsBetween(1 - min_words, 0))
    sized = island.withColumns({"ahead": ahead, "behind": behind})
    level = keep(sized.select(*DOC, "pos", "rank", _shortest(F.col("ahead"), min_words).alias("from"), _shortest(F.reverse("behind"), min_words).alias("upto")), "level")
    starts = level.where(F.col("from") > 0).select(*DOC, F.col("pos").alias("s"), F.col("from").alias("m"))
    ends = level.where(F.col("upto") > 0).select(*DOC, (F.col("pos") - F.col("upto") + 1).alias("s"), F.col("upto").alias("m"))
    windows = keep(starts.union(ends).distinct(), "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0

    named, levels, k = [], [level], 0
    while 1 << k <= longest:
        here = windows.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k))
        ranks = level.select(*DOC, "pos", "rank")
        first, last = ranks.withColumnsRenamed({"pos": "s", "rank": "ra"}), ranks.withColumnsRenamed({"pos": "e", "rank": "rb"})
        here = here.join(first, [*DOC, "s"]).withColumn("e", F.col("s") + F.col("m") - (1 << k)).join(last, [*DOC, "e"])
        named.append(here.select(*DOC, "s", "m", "ra", "rb"))
        if 2 << k <= longest:
            step = Window.partitionBy(*DOC).orderBy("pos").rangeBetween(1 << k, 1 << k)
            pairs = keep(ranks.withColumn("other", F.max("rank").over(step)).where("other is not null").withColumnRenamed("rank", "own"), "pairs")
            pair_ranks = _ranks(pairs, ["own", "other"], "ranks")
            level = keep(pairs.join(pair_ranks, ["own", "other"]).select(*DOC, "pos", "rank"), "level")
            drop(pairs, pair_ranks)
            levels.append(level)
        k += 1
    if not named:
        return lines.select(*DOC, F.array(F.struct(F.col("pos").alias("first"), F.col("pos").alias("last"))).alias("gone")).where(F.lit(False))

    whole = keep(reduce(DataFrame.union, named), "named")
    interval = ["m", "ra", "rb"]
    heads = keep(whole.groupBy(*interval).agg(F.min(F.struct(*DOC, "s")).alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    hot = max(HOT, (heads.agg(F.sum("n")).first()[0] or 0) // HOT_HEADS)
    few = heads.where(F.col("n") > hot).withColumnRenamed("head", "hot_head").drop("n")
    dealt = whole.join(F.broadcast(few), interval, "left")  # at most HOT_HEADS
    crowded = dealt.where("hot_head is not null").withColumnRenamed("hot_head", "head")
    rest = dealt.where("hot_head is null").drop("hot_head").join(heads.where(F.col("n") <= hot).drop("n"), interval)
    later = crowded.unionByName(rest).where(F.struct(*DOC, "s") > F.col("head"))
    same = (F.col("head.ld_d") == F.col("ld_d")) & (F.col("head.ld_t") == F.col("ld_t"))
    begin = F.when(same, F.greatest("s", F.col("head.s") + F.col("m"))).otherwise(F.col("s"))
    spans = keep(later.select(*DOC, begin.alias("a"), (F.col("s") + F.col("m") - 1).alias("b")).where("a <= b").distinct(), "spans")
    drop(lines, names, windows, whole, heads, *levels)
    # overlapping and adjoining spans of a document become one
    order = Window.partitionBy(*DOC).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0)).withColumn("g", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = fresh.groupBy(*DOC, "g").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    own = {c: spare(docs.columns, c) for c in (*DOC, "ld_gone", "ld_lines", "ld_filled", "ld_runs")}
    gone = deleted_intervals(docs, min_words, id_column, text_column).withColumnsRenamed({**own, "gone": own["ld_gone"]})
    keyed = docs.withColumns({own["ld_d"]: F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(2**63))), own["ld_t"]: F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))})
    gone_, lines, filled, runs = (F.col(own[c]) for c in ("ld_gone", "ld_lines", "ld_filled", "ld_runs"))
    # column by column, so that each is made once for a row: lines; the places of those that aren't blank; deleted runs,
    # each of which ends before the next line that isn't blank
    out = keyed.join(gone, [own[c] for c in DOC], "left").withColumn(own["ld_lines"], F.split(F.col(text_column), "\n"))
    out = out.withColumn(own["ld_filled"], F.filter(F.transform(lines, lambda x, i: F.when(_bare(x) != "", i)), lambda i: i.isNotNull()))
    out = out.withColumn(own["ld_runs"], F.transform(gone_, lambda g: F.struct(F.get(filled, g["first"]).alias("a"), F.coalesce(F.get(filled, g["last"] + 1), F.size(lines)).alias("b"))))
    begin = lambda j: F.when(j == 0, 0).otherwise(F.get(runs, j - 1)["b"])
    end = lambda j: F.coalesce(F.get(runs, j)["a"], F.size(lines))
    pieces = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j)))
    text = F.when(gone_.isNull(), F.col(text_column)).otherwise(F.array_join(F.flatten(pieces), "\n"))
    changed = {text_column: text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    n_deleted = F.coalesce(F.aggregate(gone_, F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1), F.lit(0))
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns), F.when(F.col(text_column).isNull(), 0).otherwise(F.size(filled)).alias(counts[0]), n_deleted.cast("int").alias(counts[1]))
