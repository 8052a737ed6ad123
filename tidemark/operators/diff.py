"""Diff of two snapshots: one outer join on the path, classified into five buckets.

A snapshot is a table of entries: path array<string>, path_str, kind (file, dir, link), exec, mtime_sec, mtime_nsec,
chunks array<struct<id, len>>, target. Times stay a pair of integers, since nanoseconds don't fit a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import packed, packed_list, unpacked, unpacked_list
from ..functions.paths import proper_ancestors

STATE = ["kind", "exec", "mtime_sec", "mtime_nsec", "chunks", "target"]
BUCKETS = ["added", "removed", "content_modified", "metadata_modified", "type_changed"]


def state() -> Column:
    """What is compared of an entry."""
    return F.struct(*STATE)


def same_time(a: Column, b: Column) -> Column:
    return (a["mtime_sec"] == b["mtime_sec"]) & (a["mtime_nsec"] == b["mtime_nsec"])


def bucket(a: Column, b: Column) -> Column:
    """The bucket of an entry's states before and after; null if the diff doesn't mention it."""
    kind = a["kind"]
    of_file = F.when(~a["chunks"].eqNullSafe(b["chunks"]), "content_modified").when(~(a["exec"].eqNullSafe(b["exec"]) & same_time(a, b)), "metadata_modified")
    of_link = F.when(~a["target"].eqNullSafe(b["target"]), "content_modified").when(~same_time(a, b), "metadata_modified")
    return (
        F.when(a.isNull(), "added")
        .when(b.isNull(), "removed")
        .when(kind != b["kind"], "type_changed")
        .when(kind == "file", of_file)
        .when(kind == "link", of_link)
    )


def digest(chunks: Column) -> Column:
    """128 bits of the SHA-256 of a chunk list, by which lists are compared; null for none."""
    return F.substring(F.unhex(F.sha2(F.to_json(chunks), 256)), 1, 16)


def lean(entries: DataFrame) -> DataFrame:
    """Entries with the digest of their chunk lists instead of the lists, so that joins by path don't carry those."""
    return entries if dict(entries.dtypes)["chunks"] == "binary" else entries.withColumn("chunks", digest(F.col("chunks")))


def paired(columns: list[str], root: str | None = None, **sides: DataFrame) -> DataFrame:
    """path_str and, of each side, a struct of these columns, null where it has no such path; one exchange whatever the sides.

    With ``root``, a column that says of which tree of many an entry is, a row for each root and path. They are dealt by
    path all the same: what many trees have alike at a path moves side by side, where compression leaves little of it.
    """
    rows, keys = None, ["path_str", *([root] if root else [])]
    for name, df in sides.items():
        one = df.select(*keys, *(F.struct(*columns).alias(name) if n == name else F.lit(None).alias(n) for n in sides))
        rows = one if rows is None else rows.union(one)
    return rows.repartition("path_str").groupBy(*keys).agg(*(F.first(n, True).alias(n) for n in sides))


def below_changed(rows: DataFrame, *pairs: tuple[Column, Column], root: str | None = None) -> DataFrame:
    """(path_str, hidden) of rows(path_str, ...) that appear or go below one that changed its type; a flag for each pair of states.

    With ``root`` as in ``paired`` a row for each path, and instead of a flag the roots of which it holds.
    """
    turned, alone = [F.coalesce(a["kind"] != b["kind"], F.lit(False)) for a, b in pairs], [a.isNull() != b.isNull() for a, b in pairs]
    if root:
        of = lambda flags, name: rows.where(F.exists(F.array(*flags), lambda x: x)).groupBy("path_str").agg(F.array(*(F.collect_list(F.when(f, F.col(root))) for f in flags)).alias(name))
        hidden = lambda a, t: F.flatten(F.collect_list(F.array_intersect(a, t)))
    else:
        of = lambda flags, name: rows.select("path_str", F.array(*flags).alias(name)).where(F.exists(name, lambda x: x))
        hidden = lambda a, t: F.bool_or(a & t)
    down = of(alone, "alone").withColumn("up", F.explode(proper_ancestors(F.split("path_str", "/"))))
    flags = F.array(*(hidden(F.col("alone")[i], F.col("turned")[i]) for i in range(len(pairs))))
    return down.join(of(turned, "turned").withColumnRenamed("path_str", "up"), "up").groupBy("path_str").agg(flags.alias("hidden"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, path_str, bucket, before, after of every entry that differs.

    Two directories never differ. What appears or goes below an entry that changed its type isn't mentioned: the
    change of the ancestor says it. Lists of chunks are compared by their digests and move with packed ids; who doesn't ask
    for ``before`` or ``after`` moves none.
    """
    own = [c for c in STATE if c != "chunks"]
    b, a = F.col("b"), F.col("a")
    hidden = below_changed(paired(["kind"], b=before, a=after), (b, a)).where("hidden[0]").select("path_str")
    summed = lambda df: dict(df.dtypes)["chunks"] == "binary"
    lists = {name: df.select("path_str", F.struct(*own, (F.col("chunks") if summed(df) else digest(F.col("chunks"))).alias("sum")).alias(name), (F.col("chunks") if summed(df) else packed_list(F.col("chunks"))).alias(f"{name}_chunks")) for name, df in (("b", before), ("a", after))}
    listed = {name: F.col(f"{name}_chunks") if summed(df) else unpacked_list(F.col(f"{name}_chunks")) for name, df in (("b", before), ("a", after))}
    empty = lambda like, name: [F.lit(None).cast(t).alias(c) for c, t in lists[like].dtypes if c != "path_str"]
    rows = lists["b"].select("*", *empty("a", "a")).union(lists["a"].select("path_str", *empty("b", "b"), "a", "a_chunks"))
    one = rows.repartition("path_str").groupBy("path_str").agg(*(F.first(c, True).alias(c) for c in rows.columns if c != "path_str"))
    compared = lambda s: F.when(s.isNotNull(), F.struct(*(s["sum" if c == "chunks" else c].alias(c) for c in STATE)))
    whole = lambda n: F.when(F.col(n).isNotNull(), F.struct(*((listed[n] if c == "chunks" else F.col(n)[c]).alias(c) for c in STATE)))
    changed = one.withColumn("bucket", bucket(compared(b), compared(a))).where("bucket is not null").join(hidden, "path_str", "left_anti")
    return changed.select(F.split("path_str", "/").alias("path"), "path_str", "bucket", whole("b").alias("before"), whole("a").alias("after"))


def pruned(before: DataFrame, after: DataFrame, dirs_before: DataFrame, dirs_after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both snapshots without what lies in directories of equal tree id on both sides: (path_str, tree_id) tables say which."""
    equal = dirs_before.join(dirs_after, ["path_str", "tree_id"]).select(F.col("path_str").alias("up"))

    def rest(df: DataFrame) -> DataFrame:
        inside = df.select("path_str", F.explode(proper_ancestors(F.col("path"))).alias("up")).join(equal, "up", "left_semi").select("path_str").distinct()
        return df.join(inside, "path_str", "left_anti")

    return rest(before), rest(after)


def counts(changes: DataFrame) -> DataFrame:
    """One row for each bucket that occurs."""
    return changes.groupBy("bucket").agg(F.count("*").alias("n"))


def pending(changes: DataFrame | None, base_readable: bool = True) -> int | None:
    """Changes since the agreed base: null without an agreement, -1 if its base can't be read."""
    if changes is None:
        return None
    return changes.count() if base_readable else -1


def applied(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The mutations that lead from ``before`` to the other side: path_str, action (remove, upsert), in that order a path.

    A changed type is a removal of the entry and of all below it, then an upsert.
    """
    gone = changes.where("bucket in ('removed', 'type_changed')").select(F.col("path_str").alias("up"))
    below = before.select("path_str", F.explode(proper_ancestors(F.col("path"))).alias("up")).join(gone, "up", "left_semi").select("path_str")
    removes = gone.select(F.col("up").alias("path_str")).union(below).distinct().select("path_str", F.lit("remove").alias("action"))
    return removes.union(changes.where("bucket <> 'removed'").select("path_str", F.lit("upsert").alias("action")))


def tree_apply(desired: DataFrame, live: DataFrame) -> DataFrame:
    """Mutations that make the live tree the desired one, whatever lies between."""
    removes = live.join(desired, "path_str", "left_anti").select("path_str", F.lit("remove").alias("action"))
    same = desired.select("path_str", state().alias("s")).join(live.select("path_str", state().alias("t")), "path_str", "left").where(~F.col("s").eqNullSafe(F.col("t")))
    return removes.union(same.select("path_str", F.lit("upsert").alias("action")))


def changed_chunks(changes: DataFrame) -> DataFrame:
    """Distinct chunk ids of what was added or changed content or type."""
    now = changes.where("bucket in ('added', 'content_modified', 'type_changed')")
    return now.select(F.explode("after.chunks").alias("c")).select(packed(F.col("c.id")).alias("id")).distinct().select(unpacked(F.col("id")).alias("id"))
