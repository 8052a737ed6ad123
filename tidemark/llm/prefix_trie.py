"""The trie of all prefixes of conversations, with sums over subtrees by heavy-path decomposition.

A prefix of d turns is named by its depth and the exclusive or of 128-bit hashes of (place, role, text), one for each of
its turns, so a turn's name for its parent is that without its own hash. Grouping names gives the nodes; a node is then
known by its smallest member and depth, which no two share. Each node picks its largest child (most members, then the
smallest id): these edges make paths that end in leaves, one leaf each, and name them. A light child has at most half of
its parent's members, so a leaf has at most log2(members) light edges above it.

Where a path ends is found from chains, the runs of nodes of one smallest member: only where a node's largest child has
another smallest member does a path go on in another chain, and these links are doubled until all reach their ends. Sums
of whole paths are attached to the paths of their parents in rounds, light paths first, logarithmically many; then one
suffix sum along the arrays of every path gives all nodes their subtree's sums. Arrays hold ``CHUNK`` depths at most, and
the sums of later chunks are added to earlier ones, so a path may have any length.

Hot spots: turns are put in order in blocks (``operators.ordered``), so one conversation may hold any share of the turns;
nodes are counted before they are shuffled; parents of very many children reach these by broadcast, at most
``MANY_PARENTS`` rows; ids of conversations that end at one node are hashed as a stream of strings of ``IDS`` each.

Rows of null id belong to no conversation and are left out; null roles and texts are empty; turns of one number stand in
the order of role and text; a repeated row is a turn more. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators.ordered import blocks
from ..session import drop, keep

#: Depths in one array of a path.
CHUNK = 4_096
#: Ids in one string on their way to a digest.
IDS = 8_192
#: Parents that may be broadcast.
MANY_PARENTS = 100_000
#: Children from which on a parent may be broadcast.
MANY_CHILDREN = 1_000


def _xor(rows: Window, name: str) -> Column:
    return F.bit_xor(name).over(rows)


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, depth, role, text) and convs(conv_id, n_turns), all conversations as they are rebuilt.

    A conversation starts with the first h turns of the one whose id is the next lower multiple of ``group``, and goes on
    with its own turns after its first h, where h is crc32 of its id modulo ``most``.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))
    cut = blocks(rows, "conv_id", ["turn", "role", "text"])
    each = cut.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    upto = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = each.select("conv_id", "_block", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"))
    # the rows of a block's conversation are neighbours there, so their places are differences of places in the block
    own = cut.join(starts, ["conv_id", "_block"]).select("conv_id", "role", "text", (F.col("_at") + F.col("shift") + 1).alias("place"))
    sizes = each.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    known = keep(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "convs")
    first = own.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "role", "text", "place")
    heads = first.join(known, "base").where("place <= head").select("conv_id", F.col("place").alias("depth"), "role", "text")
    # heads have fewer than ``most`` turns, so the shift is known from the id alone, but for the base's length
    tails = own.join(known.select("conv_id", "h", "head"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "role", "text")
    return heads.unionByName(tails), known.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, s0, s1, x0, x1, chars) of turns(conv_id, depth, role, text): names of all prefixes, and of their last turns."""
    one = turns.select("conv_id", "depth", F.xxhash64("depth", "role", "text").alias("x0"), F.xxhash64(F.lit(7), "depth", "role", F.lit(7), "text").alias("x1"), F.length("text").cast("bigint").alias("chars"))
    chunked = one.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    rows = keep(chunked, "turns")
    each = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("x0").alias("c0"), F.bit_xor("x1").alias("c1"))
    upto = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    carried = each.select("conv_id", "chunk", *(F.coalesce(_xor(upto, c), F.lit(0).cast("bigint")).alias(c) for c in ("c0", "c1")))
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"s0": _xor(within, "x0"), "s1": _xor(within, "x1")}).join(carried, ["conv_id", "chunk"])
    return summed.select("conv_id", "depth", F.col("s0").bitwiseXOR(F.col("c0")).alias("s0"), F.col("s1").bitwiseXOR(F.col("c1")).alias("s1"), "x0", "x1", "chars")


KEY = ["depth", "s0", "s1"]


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, s0, s1, p0, p1, conv_id, n_convs, chars): every prefix, its parent's name, smallest member, members."""
    grouped = rows.groupBy(*KEY).agg(F.min("x0").alias("x0"), F.min("x1").alias("x1"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    nodes = grouped.select(*KEY, F.col("s0").bitwiseXOR(F.col("x0")).alias("p0"), F.col("s1").bitwiseXOR(F.col("x1")).alias("p1"), "conv_id", "n_convs", "chars")
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    return nodes.unionByName(root.select(*(zero.alias(c) for c in (*KEY, "p0", "p1")), "conv_id", "n_convs", zero.alias("chars")))


def family(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, heavy (smallest member of the largest child), parent (smallest member of the parent) and is_light."""
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("s0"), F.col("p1").alias("s1"))
    largest = kids.agg(F.count(F.lit(1)).alias("n_children"), F.min_by("conv_id", F.struct(-F.col("n_convs"), "conv_id")).alias("heavy"))
    told = keep(nodes.join(largest, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "told")
    # largest children, and children of the parent's own smallest member, are known from the parent
    inner = told.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), "heavy", F.col("conv_id").alias("parent"))
    down = inner.select("depth", F.explode(F.array_distinct(F.array("heavy", "parent"))).alias("conv_id"), "parent", (F.col("conv_id") != F.col("heavy")).alias("is_light"))
    known = told.join(down, ["conv_id", "depth"], "left")
    known = keep(known, "known")
    lost = known.where("parent is null and depth > 0").drop("parent", "is_light")
    parents = told.select((F.col("depth") + 1).alias("depth"), F.col("s0").alias("p0"), F.col("s1").alias("p1"), F.col("conv_id").alias("parent"), "n_children")
    # children of all parents together are fewer than nodes, so this many parents can't have more each
    crowded = max(MANY_CHILDREN, -(-told.count() // MANY_PARENTS))
    by_key = ["depth", "p0", "p1"]
    some = lost.join(F.broadcast(parents.where(F.col("n_children") >= crowded).drop("n_children")), by_key, "left")
    rest = some.where("parent is null").drop("parent").join(parents.where(F.col("n_children") < crowded).drop("n_children"), by_key)
    columns = [*told.columns, "parent"]
    light = some.where("parent is not null").select(columns).unionByName(rest.select(columns)).withColumn("is_light", F.lit(True))
    out = keep(known.where("parent is not null or depth = 0").withColumn("is_light", F.coalesce("is_light", F.lit(True))).unionByName(light), "family")
    drop(told, known)
    return out


def ends_of_links(links: DataFrame) -> DataFrame:
    """(conv_id, path) of links(conv_id, to): where the chain of links from each ends, by doubling.

    Links that haven't ended lead to places of their own, so no join has a crowded key.
    """
    now, done = keep(links, "links"), None
    while True:
        known = now.select(F.col("conv_id").alias("to"), F.col("to").alias("further"), F.lit(False).alias("ended"))
        if done is not None:
            known = known.unionByName(done.select(F.col("conv_id").alias("to"), F.col("path").alias("further"), F.lit(True).alias("ended")))
        told = Observation()
        step = now.join(known, "to", "left").select("conv_id", F.coalesce("further", "to").alias("to"), F.coalesce("ended", F.lit(True)).alias("ended"))
        both = keep(step.observe(told, F.count_if(~F.col("ended")).alias("open")), "links")
        ended = both.where("ended").select("conv_id", F.col("to").alias("path"))
        done = ended if done is None else done.unionByName(ended)
        if not told.get["open"]:
            return done
        now = both.where("not ended").select("conv_id", "to")


def with_paths(tree: DataFrame) -> DataFrame:
    """tree with chunk and path, the smallest member of the leaf at the end of each node's path."""
    breaks = tree.where("n_children > 0 and heavy <> conv_id").select("conv_id", "depth", "heavy")
    links = breaks.groupBy("conv_id").agg(F.min_by("heavy", "depth").alias("to"))
    ends = ends_of_links(links)
    led = breaks.join(ends.select(F.col("conv_id").alias("heavy"), "path"), "heavy", "left").select("conv_id", "depth", F.coalesce("path", "heavy").alias("led"))
    rows = keep(tree.join(led, ["conv_id", "depth"], "left").withColumn("chunk", F.floor(F.col("depth") / CHUNK)), "led")
    nearest = F.last("led", ignorenulls=True).over(Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")))
    first = rows.where("led is not null").groupBy("conv_id", "chunk").agg(F.min_by("led", "depth").alias("first"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.lit(1).alias("one")).join(first, ["conv_id", "chunk"], "left")
    below = F.first("first", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing))  # a row for each chunk
    later = chunks.select("conv_id", "chunk", below.alias("later"))
    joined = rows.withColumn("near", nearest).join(later, ["conv_id", "chunk"], "left")
    return joined.withColumn("path", F.coalesce("near", "later", "conv_id")).drop("led", "near", "later")


def light_sums(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, leaves, saved): what the light children of each node bring from their subtrees.

    Whole paths are summed; those that wait for no light child are sent to the paths of their parents, again and again.
    """
    rounds = None
    own = tree.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum(F.greatest(F.col("n_children") - 1, F.lit(0))).alias("waiting"))
    heads = tree.where("is_light and depth > 0").select("path", F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    now = keep(own.join(heads, "path", "left"), "paths")
    branches = keep(tree.where("n_children > 1").select("conv_id", "depth", F.col("path").alias("onto")), "branches")
    while True:
        ready = now.where("waiting = 0 and conv_id is not null")
        sent = keep(ready.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n")), "sent")
        if sent.isEmpty():
            break
        rounds = sent if rounds is None else rounds.unionByName(sent)
        onto = sent.join(branches, ["conv_id", "depth"]).groupBy(F.col("onto").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("n"))
        rest = now.where("waiting > 0").join(onto, "path", "left")
        zero = F.lit(0)
        new = keep(rest.select("path", (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"), (F.col("waiting") - F.coalesce("n", zero)).alias("waiting"), "conv_id", "depth"), "paths")
        drop(now)
        now = new
    drop(now, branches)
    rounds = sent if rounds is None else rounds
    return rounds.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def subtree_sums(tree: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): own and light sums, summed from the end of each path upwards."""
    zero = F.lit(0)
    full = tree.join(light_sums(tree), ["conv_id", "depth"], "left")
    node = F.struct((-F.col("depth")).alias("up"), "conv_id", (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"))
    arrays = full.groupBy("path", "chunk").agg(F.array_sort(F.collect_list(node)).alias("nodes"))  # CHUNK at most, deepest first
    arrays = keep(arrays, "arrays")
    whole = lambda c: F.aggregate(F.col("nodes")[c], F.lit(0).cast("bigint"), lambda a, b: a + b).alias(c)
    below = Window.partitionBy("path").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    carried = arrays.select("path", "chunk", whole("leaves"), whole("saved")).select("path", "chunk", *(F.coalesce(F.sum(c).over(below), zero).alias(c) for c in ("leaves", "saved")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0)
            flat, sizes = nodes.flatten(), np.asarray(nodes.value_lengths())
            starts, out = np.cumsum(sizes) - sizes, []
            for name, carry in (("leaves", batch.column(1)), ("saved", batch.column(2))):
                run_sum = np.cumsum(flat.field(name).to_numpy())
                before = np.where(starts > 0, run_sum[starts - 1], 0)
                out.append(run_sum - np.repeat(before, sizes) + np.repeat(carry.to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([flat.field("conv_id"), pa.array(-flat.field("up").to_numpy()), *map(pa.array, out)], names=["conv_id", "depth", "n_leaves", "saved_tokens"])

    dealt = arrays.join(carried, ["path", "chunk"]).select("nodes", "leaves", "saved")
    return dealt.mapInArrow(run, "conv_id bigint, depth bigint, n_leaves bigint, saved_tokens bigint")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, s0, s1, ends_sha256) of ends(depth, s0, s1, conv_id): ids in ascending order, joined by commas.

    Ids of one node may lie in many partitions; each makes strings of them, which one task hashes as they come.
    """
    schema = "depth bigint, s0 bigint, s1 bigint, "

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key, ids) -> tuple:
            return *key, ids[0], ",".join(map(str, ids))

        key, ids, out = None, [], []
        for batch in batches:
            for *k, i in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if ids and (k != key or len(ids) == IDS):
                    out.append(made(key, ids))
                    ids = []
                key = k
                ids.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in made(key, ids)], names=[*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, now = None, None
        for batch in batches:
            out = []
            for *k, _, ids in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if k != key:
                    if now:
                        out.append((*key, now.hexdigest()))
                    key, now = k, hashlib.sha256(ids.encode())
                else:
                    now.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, now.hexdigest())], names=[*KEY, "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    joined = ranged.mapInArrow(strings, schema + "first bigint, ids string")
    return joined.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, schema + "ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text): a row for each node."""
    turns, convs = rebuilt(conversations)
    rows = keep(prefixes(turns), "prefixes")
    zero = F.lit(0).cast("bigint")
    named = rows.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"], "left_semi").select(*KEY, "conv_id")
    ends = named.unionByName(convs.where("n_turns = 0").select(*(zero.alias(k) for k in KEY), "conv_id"))
    tree = family(nodes_of(rows, convs))
    own = tree.withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    pathed = keep(with_paths(own), "tree")
    out = pathed.join(subtree_sums(pathed), ["conv_id", "depth"]).join(end_digests(ends), KEY, "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "path")
