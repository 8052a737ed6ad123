"""Before a plan is applied: guards against what changed meanwhile, and what each entry needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold_key
from ..functions.paths import proper_ancestors
from ..session import keep
from .diff import STATE, lean, paired, same_time


#: What is compared of an entry: its state with a digest of its chunks, and the size of its content.
SIZED = [*STATE, "size"]


def sized(entries: DataFrame) -> DataFrame:
    """Entries with the digest and the size of their content instead of its chunks; no size where there is a digest already."""
    if dict(entries.dtypes)["chunks"] == "binary":
        return entries.withColumn("size", F.lit(None).cast("bigint"))
    return lean(entries.withColumn("size", F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, c: a + c["len"])))


def mismatch(expected: Column, live: Column) -> Column:
    """Why a live entry isn't the expected one, or null; directories match whatever their times."""
    of_file = (
        F.when(expected["size"] != live["size"], "size_mismatch")
        .when(~expected["exec"].eqNullSafe(live["exec"]), "exec_mismatch")
        .when(~expected["chunks"].eqNullSafe(live["chunks"]), "content_mismatch")
    )
    of_link = F.when(~expected["target"].eqNullSafe(live["target"]), "target_mismatch")
    return F.when(expected["kind"] != live["kind"], "kind_mismatch").when(live["kind"] == "file", of_file).when(live["kind"] == "link", of_link)


def guarded(plan: DataFrame, expected: DataFrame, live: DataFrame, desired: DataFrame | None = None) -> DataFrame:
    """plan(path_str, action: remove or upsert) against the base it was made for and the live tree: (path_str, reason) of each divergence.

    An upsert over an expected directory is free, and so is one of a ``desired`` entry that is live already: equal with
    its times, or a directory whatever its times, unless its name only differs by case from one that is removed. A removed
    directory must have below it exactly what the base has.

    States meet once, whatever is asked of them: what they say of each path, a few words, is written and read below.
    """
    e, v, w = F.col("e"), F.col("v"), F.col("w")
    plan = keep(plan.select("path_str", "action"), "plan")
    remove = F.col("action") == "remove"
    todo = plan.groupBy("path_str").agg(F.bool_or(remove).alias("removed"), F.bool_or(~remove).alias("upserted"))
    trees = paired(SIZED, e=sized(expected), v=sized(live), **({} if desired is None else {"w": sized(desired)}))
    removal = F.when(e.isNull(), "not_in_base").when(v.isNull(), "expected_present").otherwise(mismatch(e, v))
    upsert = F.when(e.isNull(), F.when(v.isNotNull(), "expected_absent")).when(v.isNull(), "expected_present").when(e["kind"] != "dir", mismatch(e, v))
    deep = F.when(e.isNull(), F.when(v.isNotNull(), "expected_absent")).when(v.isNull(), "expected_present").otherwise(mismatch(e, v))
    there = F.lit(False) if desired is None else w.isNotNull() & v.isNotNull() & mismatch(w, v).isNull() & (same_time(w, v) | (w["kind"] == "dir"))
    removed = F.coalesce("removed", F.lit(False))
    rows = trees.join(todo, "path_str", "full").select("path_str", F.when(removed, removal).alias("removal"), F.when(F.col("upserted"), upsert).alias("upsert"), F.coalesce(there, F.lit(False)).alias("there"), F.when(~removed, deep).alias("deep"))
    said = keep(rows.where("coalesce(removal, upsert, deep) is not null"), "said", clear=True)
    gone = plan.where(remove).select("path_str")
    over = said.where("upsert is not null")
    folds = gone.select(fold_key(F.col("path_str")).alias("fold")).distinct()
    anew = over.where("there").withColumn("fold", fold_key(F.col("path_str"))).join(folds, "fold", "left_semi")
    own = said.where("removal is not null").select("path_str", F.col("removal").alias("reason")).union(over.where("not there").select("path_str", "upsert")).union(anew.select("path_str", "upsert"))
    inside = said.where("deep is not null").select("path_str", F.col("deep").alias("reason"), F.explode(proper_ancestors(F.split("path_str", "/"))).alias("up"))
    return own.union(inside.join(gone.withColumnRenamed("path_str", "up"), "up", "left_semi").select("path_str", "reason").distinct())


def steps(desired: DataFrame, live: DataFrame, removed: DataFrame | None = None, composed: bool = False) -> DataFrame:
    """What each desired entry needs: path_str, action (skip, touch, write).

    Equal content needs its times set at most; a name that only differs by case from one that is removed is written
    anew. ``composed`` says that paths are in NFC.
    """
    side = lambda df, name: sized(df).select("path_str", F.struct(*SIZED).alias(name))
    rows = side(desired, "e").join(side(live, "v"), "path_str", "left")
    e, v = F.col("e"), F.col("v")
    shadowed = F.lit(False)
    if removed is not None:
        folds = removed.select(fold_key(F.col("path_str"), composed).alias("fold")).distinct().withColumn("shadowed", F.lit(True))
        rows = rows.withColumn("fold", fold_key(F.col("path_str"), composed)).join(folds, "fold", "left")
        shadowed = F.coalesce("shadowed", F.lit(False))
    action = F.when(shadowed | v.isNull() | mismatch(e, v).isNotNull(), "write").when(same_time(e, v), "skip").otherwise("touch")
    return rows.select("path_str", action.alias("action"))


def phases(plan: DataFrame, desired: DataFrame, live: DataFrame) -> DataFrame:
    """plan(path_str, action: remove or upsert) as it is carried out: (path_str, action, position), action one of remove, write, touch.

    Removals go first, in descending order of paths, so what is inside goes before what holds it; writes follow in
    ascending order; times are set last, in descending order, as writing inside a directory changes its own. What is
    live as desired is left out, and a name that only differs by case from a removed one is written anew.
    """
    removed = plan.where("action = 'remove'").select("path_str")
    wanted = desired.join(plan.where("action = 'upsert'").select("path_str"), "path_str", "left_semi")
    each = steps(wanted, live, removed).join(wanted.select("path_str", F.col("kind") == "dir"), "path_str").toDF("path_str", "action", "is_dir")
    writes = each.where("action = 'write'").select("path_str", F.lit("write").alias("action"))
    touches = each.where("action = 'touch' or action = 'write' and is_dir").select("path_str", F.lit("touch").alias("action"))
    todo = removed.select("path_str", F.lit("remove").alias("action")).union(writes).union(touches)
    return positions(todo, [F.when(F.col("action") == "remove", 0).when(F.col("action") == "write", 1).otherwise(2), *_by_path(F.col("action") != "write")])


def _by_path(down: Column) -> list[Column]:
    """Paths by their components; descending where ``down`` says so."""
    path = F.split("path_str", "/")
    return [F.when(down, path).desc_nulls_first(), F.when(~down, path).asc_nulls_first()]


def order(plan: DataFrame) -> DataFrame:
    """Removals deepest first, then upserts from the root down, as positions in a sorted table."""
    return plan.orderBy(*_order())


def _order() -> list[Column]:
    path = F.split("path_str", "/")
    depth = F.when(F.col("action") == "remove", -F.size(path)).otherwise(F.size(path))
    return [F.col("action") != "remove", depth, path]


def order_position(plan: DataFrame) -> DataFrame:
    """plan(path_str, action) with ``position``, from 0: the order of applying as a column."""
    return positions(plan, _order())


def positions(rows: DataFrame, by: list[Column]) -> DataFrame:
    """rows with ``position``, from 0, in this order.

    Positions count the rows of earlier ranges of the sorted table, so no task holds more than its range.
    """
    sorted_ = keep(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("m", 33)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("p", "before")
    return sorted_.withColumn("p", part).join(F.broadcast(starts), "p").select(*rows.columns, (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"))
