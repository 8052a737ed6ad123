"""The registry of synced folders: registering, ensuring and unregistering, by the rule that no two folders nest.

Records are folder_id, path, added_at. Paths overlap if they are equal or one lies below the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import nested_pairs
from ..session import drop, keep


def plain(path: Column) -> Column:
    """A path without slashes at its end."""
    return F.regexp_replace(path, "(?<=.)/+$", "")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_path, right_path) of left(path) and right(path) that overlap."""
    a, b = (df.select(plain(F.col("path")).alias("path_str")).distinct() for df in (left, right))
    same = a.join(b, "path_str").select(F.col("path_str").alias("left_path"), F.col("path_str").alias("right_path"))
    return nested_pairs(a, b).union(same)


def register(records: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry after wanted(folder_id, path, added_at, ord) were registered one after the other, and (path, error) of those that weren't.

    ``bad_path`` isn't absolute; ``already_synced`` overlaps a folder of the registry, or one that was registered before
    it. Each round decides all that no undecided earlier one overlaps, so rounds are as many as such folders stand in a
    chain.
    """
    rows = keep(wanted.withColumn("key", plain(F.col("path"))), "wanted")
    bad = rows.where(~F.startswith("path", F.lit("/")))
    open_ = rows.where(F.startswith("path", F.lit("/")))
    synced = overlaps(open_, records).select(F.col("left_path").alias("key")).distinct()
    refused = [bad.select("path", F.lit("bad_path").alias("error")), open_.join(synced, "key", "left_semi").select("path", F.lit("already_synced").alias("error"))]
    open_ = keep(open_.join(synced, "key", "left_anti"), "open")
    pairs = overlaps(open_, open_).toDF("key", "other")
    of = open_.select(F.col("key").alias("other"), F.col("ord").alias("before"))
    # who stands before whom
    blocks = keep(open_.select("key", "ord").join(pairs, "key").join(of, "other").where("before < ord").select("key", "ord", "other", "before"), "blocks")
    done = []
    while True:
        blocked = blocks.join(open_.select(F.col("key").alias("other"), F.col("ord").alias("before")), ["other", "before"], "left_semi").select("key", "ord").distinct()
        taken = keep(open_.join(blocked, ["key", "ord"], "left_anti"), "taken")
        if taken.isEmpty():
            break
        done.append(taken)
        rest = open_.join(taken.select("key", "ord"), ["key", "ord"], "left_anti")
        lost = blocks.join(taken.select(F.col("key").alias("other"), F.col("ord").alias("before")), ["other", "before"], "left_semi").select("key", "ord").distinct()
        refused.append(keep(rest.join(lost, ["key", "ord"], "left_semi").select("path", F.lit("already_synced").alias("error")), "refused"))
        new = keep(rest.join(lost, ["key", "ord"], "left_anti"), "open")
        drop(open_)
        open_ = new
    out, no = records, refused[0]
    for t in done:
        out = out.unionByName(t.select(*records.columns))
    for r in refused[1:]:
        no = no.unionByName(r)
    return out, no


def ensure(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """The registry in which wanted(folder_id, path, added_at), ids that differ and paths that don't overlap, stand.

    A record of the id and path stays as it is; one of the id elsewhere gives way, and for an id that is new, so do all
    records that overlap its path.
    """
    same = records.join(wanted.select("folder_id", "path"), ["folder_id", "path"], "left_semi")
    new = wanted.join(records.select("folder_id"), "folder_id", "left_anti")
    in_way = overlaps(records, new).select(F.col("left_path").alias("key")).distinct()
    moved = records.join(wanted.select("folder_id"), "folder_id", "left_semi").join(same.select("folder_id"), "folder_id", "left_anti")
    kept = records.join(moved.select("folder_id"), "folder_id", "left_anti").withColumn("key", plain(F.col("path"))).join(in_way, "key", "left_anti").drop("key")
    return kept.unionByName(wanted.join(kept.select("folder_id"), "folder_id", "left_anti").select(*records.columns))


def unregister(records: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry without gone(folder_id), and the ids that it doesn't have."""
    return records.join(gone.select("folder_id"), "folder_id", "left_anti"), gone.select("folder_id").distinct().join(records.select("folder_id"), "folder_id", "left_anti")


def listing(children: DataFrame, records: DataFrame) -> DataFrame:
    """children(parent, name, is_dir) of directories with ``position`` among those of their parent: directories first, then by name.

    Flags of directories: is_repository (it holds ``.git``), initialized (it holds ``.store``), synced (a folder of the
    registry is it, lies below it, or holds it).
    """
    path = F.concat(plain(F.col("parent")), F.when(plain(F.col("parent")) == "/", "").otherwise("/"), F.col("name")).alias("path")
    rows = children.select("parent", "name", "is_dir", path)
    has = lambda name, flag: children.where(F.col("name") == name).select(F.col("parent").alias("path"), F.lit(True).alias(flag)).distinct()
    synced = overlaps(rows.where("is_dir"), records).select(F.col("left_path").alias("path"), F.lit(True).alias("synced")).distinct()
    out = rows.join(has(".git", "is_repository"), "path", "left").join(has(".store", "initialized"), "path", "left").join(synced, "path", "left")
    flags = [(F.col("is_dir") & F.coalesce(c, F.lit(False))).alias(c) for c in ("is_repository", "initialized", "synced")]
    return out.select("parent", "name", "is_dir", *flags)
