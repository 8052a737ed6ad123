"""What to move between stores: missing chunks, packs or single items, batches, and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, keep
from .ordered import Fit, in_bins

#: Wanted blobs of a pack from which the whole pack is moved; null never.
WHOLE_PACK = {"auto": 2, "packs_only": 1, "items_only": None}
#: Id of no manifest.
ZERO = "0" * 64
ITEMS_PER_BATCH, PACKS_PER_BATCH, ADVERTS_PER_BATCH = 512, 128, 2048
PACK_TARGET = 16 << 20
ROUNDS = 1024


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted(id, ...) without what present(id) has."""
    return wanted.join(present.select("id").distinct(), "id", "left_anti")


def located(wanted: DataFrame, adverts: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """wanted(id) with the pack it is taken from: the last advert(id, pack, ord) of each id, of those whose pack exists."""
    if packs is not None:
        adverts = adverts.join(packs.select("pack").distinct(), "pack", "left_semi")
    last = adverts.groupBy("id").agg(F.max_by("pack", "ord").alias("pack"))
    return wanted.join(last, "id", "left")


def pack_choice(placed: DataFrame, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(packs to move whole: pack, wanted; single items: id) of placed(id, pack)."""
    least = WHOLE_PACK[mode]
    per = placed.where("pack is not null").groupBy("pack").agg(F.countDistinct("id").alias("wanted"))
    whole = per.where(F.lit(False) if least is None else F.col("wanted") >= least)
    return whole, placed.join(whole.select("pack"), "pack", "left_anti").select("id").distinct()


def batches(rows: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """rows with a column ``batch``: of each key, ``size`` rows a batch in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / F.lit(size)))


def next_fit(blobs: DataFrame, pool: str, order: list[str], length: str, target: int = PACK_TARGET) -> DataFrame:
    """blobs with a column ``bin``: greedy next-fit of each pool in arrival order.

    A bin is sealed when the next blob would overflow it and it isn't empty; a larger blob has a bin of its own. A
    pool's blobs are packed in blocks, so a store of one pool is no single task.
    """
    return in_bins(blobs, pool, order, length, Fit(target), "bin")


def written_packs(blobs: DataFrame, pool: str, order: list[str], flush: bool = True) -> tuple[DataFrame, DataFrame]:
    """(packs: pack, body; their index rows: kind, id, pack, plain_off, plain_len) of blobs(pool, bin, kind, id, body).

    A pack is the bytes of one bin in order, named by their hash; the last bin of each pool is still open, so it is
    written by a flush only. A bin holds ``PACK_TARGET`` bytes or one larger blob.
    """
    if not flush:
        last = blobs.groupBy(pool).agg(F.max("bin").alias("bin"))
        blobs = blobs.join(last, [pool, "bin"], "left_anti")
    length = F.length("body").cast("bigint")
    before = Window.partitionBy(pool, "bin").orderBy(*order)
    placed = blobs.select(pool, "bin", "kind", "id", "body", length.alias("plain_len"), F.row_number().over(before).alias("_at"), (F.sum(length).over(before.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("plain_off"))
    bodies = placed.groupBy(pool, "bin").agg(F.expr("listagg(body) within group (order by _at)").alias("body")).withColumn("pack", F.sha2("body", 256))
    bodies = keep(bodies, "packs")
    return bodies.select("pack", "body"), placed.join(bodies.select(pool, "bin", "pack"), [pool, "bin"]).select("kind", "id", "pack", "plain_off", "plain_len")


def pull_rounds(roots: DataFrame, children: DataFrame, limit: int = ROUNDS) -> tuple[DataFrame, int]:
    """(id, round) of the tree nodes that are fetched from roots(id) over children(id, child), and how many the rounds don't reach.

    Each round asks for the children of the one before that no round asked for, the roots in round 1.
    """
    children = keep(children.select("id", "child"), "children")
    front = keep(roots.select("id").distinct().withColumn("round", F.lit(1)), "round")
    seen, n = front, 1
    while True:
        found = front.select("id").join(children, "id").select(F.col("child").alias("id")).distinct().join(seen, "id", "left_anti")
        front = keep(found.withColumn("round", F.lit(n + 1)), "round")
        left = front.count()
        if not left or n == limit:
            drop(front, children)
            return seen, left
        seen, n = seen.union(front), n + 1


def referenced(entries: DataFrame, trees: DataFrame) -> DataFrame:
    """Distinct (kind, id) that entries(path_str, kind, chunks) name: chunks of files, and of directories their trees(path_str, tree_id)."""
    data = entries.where("kind = 'file'").select(F.lit("data").alias("kind"), F.explode("chunks.id").alias("id"))
    below = entries.where("kind = 'dir'").join(trees, "path_str").select(F.lit("tree").alias("kind"), F.col("tree_id").alias("id"))
    return data.union(below).distinct()


def first_index_rows(index: DataFrame) -> DataFrame:
    """The first row, by ord, of each (kind, id)."""
    return index.groupBy("kind", "id").agg(F.min_by(F.struct(*[c for c in index.columns if c not in ("kind", "id")]), "ord").alias("r")).select("kind", "id", "r.*")


def pull(mine: Column, theirs: Column, empty: Column, theirs_newer: Column) -> Column:
    """What a session does with a peer's manifest, from root ids: ``empty`` is that of the empty tree, a zero or null id no offer.

    Equal roots settle on the manifest that is later in lineage; an empty peer is not followed unless this side is empty, too.
    """
    offered = theirs.isNotNull() & (theirs != ZERO)
    return F.when(~F.coalesce(offered, F.lit(False)), "nothing").when(mine == theirs, F.when(theirs_newer, "adopt").otherwise("keep")).when((theirs == empty) & (mine != empty), "keep").otherwise("converge")


def settled(held: Column, diverged: Column) -> Column:
    """What a session does after it converged: the peer's manifest is adopted only if nothing was held and no side left the other."""
    return F.when((held == 0) & ~diverged, "adopt").when(held > 0, "store_manifest").otherwise("keep")


def lineage_order() -> Column:
    """Manifests compare by (created_sec, created_nsec, device, root)."""
    return F.struct("created_sec", "created_nsec", "device_id", "root_tree_id")
