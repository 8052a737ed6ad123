"""Tables of a store and of a host: index, packs, folders, peers, manifests, and the choices made over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import packed, parse_rfc3339, unpacked
from ..functions.paths import nested_pairs
from ..session import keep
from .diff import STATE
from .ordered import Cut, in_bins

COMPACT_FROM, BATCH_ITEMS, BATCH_BYTES, CONFLICT_FINDINGS = 512, 512, 8 << 20, 20
#: Children that are hashed as one string.
FOLD = 1024
#: Id of no manifest and no parent.
ZERO = "0" * 64


def merged_index(*parts: DataFrame) -> DataFrame:
    """The set union of index parts: equal rows once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def compacted_index(files: DataFrame, index: DataFrame, least: int = COMPACT_FROM) -> DataFrame | None:
    """The index as one set of rows if it has ``least`` files or more, for a single rewrite; null if it needs none."""
    return merged_index(index) if files.count() >= least else None


def rebuilt_index(footers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """footers(pack, ok, entries array<struct<kind,id,plain_off,plain_len>>): index rows of sound packs, and the other packs."""
    named = F.col("pack").rlike("^[0-9a-f]{64}$") & F.col("ok")
    rows = footers.where(named).select("pack", F.explode("entries").alias("e")).select("e.kind", "e.id", "pack", "e.plain_off", "e.plain_len")
    return rows, footers.where(~named).select("pack")


def adopted(packs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packs(pack, body, entries) that a peer sent: index rows of those whose name is their hash, and the others' names."""
    sound = F.sha2("body", 256) == F.col("pack")
    rows = packs.where(sound).select("pack", F.explode("entries").alias("e")).select("e.kind", "e.id", "pack", "e.plain_off", "e.plain_len")
    return rows.join(index, ["kind", "id", "pack", "plain_off", "plain_len"], "left_anti"), packs.where(~sound).select("pack")


def distinct_packs(index: DataFrame) -> DataFrame:
    return index.select("pack").distinct().orderBy("pack")


def item_batches(items: DataFrame, session: str, order: list[str], length: str, most: int = BATCH_ITEMS, flush: int = BATCH_BYTES) -> DataFrame:
    """items with a column ``batch``: of each session in order, a batch ends at ``most`` items or with the item that reaches ``flush`` bytes."""
    return in_bins(items, session, order, length, Cut(most, flush), "batch")


def scan_counts(entries: DataFrame, rescanned: DataFrame, rebuilt: DataFrame | None = None) -> DataFrame:
    """One row: files, dirs, links, bytes_chunked and files_rehashed of a pass; ``rescanned`` are the entries it read, with
    their chunks or just (kind, size).

    With the directories whose ids it hashed anew (``trees.rebuilt``), dirty_dirs as well.
    """
    size = F.col("size") if "size" in rescanned.columns else F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, c: a + c["len"])
    rows = entries.select("kind", F.lit(False).alias("read"), F.lit(0).cast("bigint").alias("size")).union(rescanned.select("kind", F.lit(True), size))
    read, n = F.col("read") & (F.col("kind") == "file"), lambda k: F.count_if(~F.col("read") & (F.col("kind") == k)).alias(f"{k}s")
    counts = [n("file"), n("dir"), n("link"), F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0)).alias("bytes_chunked"), F.count_if(read).alias("files_rehashed")]
    if rebuilt is None:
        return rows.agg(*counts)
    rows = rows.unionByName(rebuilt.select(F.lit("rebuilt").alias("kind"), F.lit(False).alias("read"), F.lit(0).cast("bigint").alias("size")))
    return rows.agg(*counts, F.count_if(F.col("kind") == "rebuilt").alias("dirty_dirs"))


def folded(children: DataFrame) -> DataFrame:
    """children(parent, name, id): (path_str, tree_id) of each parent, a hash of its sorted children; ids may be packed.

    Over ``FOLD`` children are dealt by the hash of their names into as many parts, a power of 256, as bring a part to
    about that number; parts are hashed, then 256 hashes at a time, so that no row holds all children. Children are read
    twice, so they should be cheap to make.
    """
    if dict(children.dtypes)["id"] == "string":
        children = children.withColumn("id", packed(F.col("id")))
    tiers = sum(((F.col("n") > FOLD << 8 * k).cast("int") for k in range(4)), F.lit(0))
    large = keep(children.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") > FOLD).select("parent", tiers.alias("tiers")), "large")
    most = large.agg(F.max("tiers")).first()[0] or 0
    part = F.expr("substring(sha2(name, 256), 1, 2 * coalesce(tiers, 0))")
    sorted_ = F.sort_array(F.transform(F.collect_list(F.struct("name", "id")), lambda c: F.struct(c["name"].alias("name"), unpacked(c["id"]).alias("id"))))
    hashed = F.sha2(F.to_json(sorted_), 256)
    now = children.join(large, "parent", "left").withColumn("part", part).groupBy("parent", "part").agg(hashed.alias("tree_id"))
    for _ in range(most):
        above = F.expr("substring(part, 1, length(part) - 2)")
        up = now.where("part <> ''").select("parent", F.col("part").alias("name"), packed(F.concat(F.lit("t"), "tree_id")).alias("id"), above.alias("part"))
        now = now.where("part = ''").union(up.groupBy("parent", "part").agg(hashed.alias("tree_id")))
    return now.select(F.col("parent").alias("path_str"), "tree_id")


def canonical_ids(entries: DataFrame) -> DataFrame:
    """(path_str, tree_id) of every directory, the root as '': a hash of what is below, times left out.

    Bottom up, one round a level: rows of a level are folded into their directories, whose ids are rows of the level above.
    """
    parent = F.array_join(F.slice("path", 1, F.size("path") - 1), "/")
    what = [c for c in STATE if not c.startswith("mtime")]
    own = F.sha2(F.to_json(F.struct(*what), {"ignoreNullFields": "false"}), 256)
    rows = keep(entries.select("path_str", F.size("path").alias("depth"), parent.alias("parent"), F.element_at("path", -1).alias("name"), "kind", own.alias("own")), "hashed")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    out, below = None, None
    for depth in range(deepest, -1, -1):
        here = rows.where(F.col("depth") == depth)
        if below is not None:
            here = here.join(below.select("path_str", "tree_id"), "path_str", "left")
        else:
            here = here.withColumn("tree_id", F.lit(None).cast("string"))
        if depth == 0:
            break
        each = F.when(F.col("kind") == "dir", F.concat(F.lit("d"), F.coalesce("tree_id", F.sha2(F.lit(""), 256)))).otherwise(F.concat(F.lit("e"), "own"))
        empty = here.where("kind = 'dir' and tree_id is null").select("path_str", F.sha2(F.lit(""), 256).alias("tree_id"))
        found = keep(folded(here.select("parent", "name", each.alias("id"))), "trees")
        out = found.union(empty) if out is None else out.union(found).union(empty)
        below = found
    return out if out is not None else rows.select(F.lit("").alias("path_str"), F.sha2(F.lit(""), 256).alias("tree_id")).limit(0)


def registry_errors(folders: DataFrame) -> DataFrame:
    """folders(folder_id, path, added_at): (folder_id, error) of each record that breaks a rule, pairs that overlap included."""
    valid = F.col("folder_id").rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{64})$")
    alone = F.when(~valid, "invalid_id").when(~F.startswith("path", F.lit("/")), "relative_path").when(parse_rfc3339(F.col("added_at")).isNull(), "invalid_time")
    twice = folders.groupBy("folder_id").count().where("count > 1").select("folder_id", F.lit("duplicate_id").alias("error"))
    paths = folders.select(F.regexp_replace("path", "/+$", "").alias("path_str"), "folder_id")
    same = paths.groupBy("path_str").agg(F.count("*").alias("n")).where("n > 1").join(paths, "path_str").select("folder_id")
    pairs = nested_pairs(paths.select("path_str").distinct(), paths.select("path_str").distinct())
    nested = pairs.select(F.explode(F.array("left_path", "right_path")).alias("path_str")).distinct().join(paths, "path_str").select("folder_id")
    overlap = same.union(nested).distinct().select("folder_id", F.lit("overlapping_path").alias("error"))
    return folders.select("folder_id", alone.alias("error")).where("error is not null").union(twice).union(overlap)


def exactly_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of which there isn't exactly one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n <> 1")


def engine_stats(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """sessions(outcome: ok, failed or rejected): how many of each, by key."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return sessions.groupBy(*keys).agg(n("ok"), n("failed"), n("rejected"))


def diverged(root: Column, baseline: Column, empty: Column) -> Column:
    """Whether a side left its baseline; without one, whether it has anything."""
    return F.when(baseline.isNull(), root != empty).otherwise(root != baseline)


def donor(mine: Column, theirs: Column, empty: Column) -> Column:
    """first or second: which of two manifests (structs of root_tree_id, baseline, created_sec, created_nsec, device_id) the other takes.

    The side that left its baseline while the other didn't; else the one that isn't empty; else the later in lineage.
    """
    a, b = diverged(mine["root_tree_id"], mine["baseline"], empty), diverged(theirs["root_tree_id"], theirs["baseline"], empty)
    ea, eb = mine["root_tree_id"] == empty, theirs["root_tree_id"] == empty
    key = lambda m: F.struct(m["created_sec"], m["created_nsec"], m["device_id"], m["root_tree_id"])
    return F.when(a & ~b, "first").when(~a & b, "second").when(~ea & eb, "first").when(ea & ~eb, "second").when(key(mine) >= key(theirs), "first").otherwise("second")


def release_base(releases: DataFrame, captured: DataFrame, agreements: DataFrame) -> DataFrame:
    """releases(peer, explicit) with ``base`` and where it is from: the explicit one, the pin's, the ledger's, or none."""
    rows = releases.join(captured.select("peer", F.col("manifest_id").alias("pinned")), "peer", "left").join(agreements.select("peer", F.col("manifest_id").alias("agreed")), "peer", "left")
    source = F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("pinned").isNotNull(), "pin").when(F.col("agreed").isNotNull(), "ledger")
    return rows.select("peer", F.coalesce("explicit", "pinned", "agreed").alias("base"), source.alias("source"))


def release_targets(held: DataFrame) -> DataFrame:
    """Of each peer the manifest of its last held entry, which a release reconciles with."""
    return held.groupBy("peer").agg(F.max_by("remote_manifest_id", F.struct("held_sec", "held_nsec", "ord")).alias("manifest_id"))


def pull_needed(current: Column, offered: Column) -> Column:
    return (offered != ZERO) & (offered != current)


def no_change(parent_root: Column, root: Column, parent: Column, new: Column) -> Column:
    """The manifest of a pass: the parent's if the root is the same, so nothing new is written."""
    return F.when(parent_root.eqNullSafe(root), parent).otherwise(new)


def usable_parent(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(id, folder_id) whose manifest exists, was parsed and is of the folder; others count as no parent."""
    return wanted.join(manifests.where("parsed").select("id", "folder_id"), ["id", "folder_id"], "left_semi")


def quarantine_of(conflicts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """conflicts(path_str, ...) with the copy that was kept, if any, of quarantine(path_str, ord, copy); the first by ord of several."""
    return conflicts.join(quarantine.groupBy("path_str").agg(F.min_by("copy", "ord").alias("copy")), "path_str", "left")


def numbered_copies(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted(dir, name) with ``copy``: the name, or the first of name-2, name-3, ... that nothing has, several wanted in turn.

    Of the numbers in use the j-th, k, has k - j free ones before it; the i-th wanted row takes i plus as many as have
    fewer than i, which one window over both counts.
    """
    used = existing.select("dir", F.regexp_extract("name", r"^(.*?)(?:-(\d+))?$", 1).alias("base"), F.col("name").alias("taken"))
    names = wanted.select("dir", "name").distinct()
    as_is = names.join(existing, ["dir", "name"], "left_semi").select("dir", "name", F.lit(1).cast("bigint").alias("k"))
    numbers = names.join(used, (names["dir"] == used["dir"]) & (names["name"] == used["base"])).select(names["dir"], names["name"], F.expr("try_cast(substring(taken, length(name) + 2) as bigint)").alias("k")).where("k >= 2")
    name = Window.partitionBy("dir", "name")
    taken = as_is.union(numbers).distinct().select("dir", "name", (F.col("k") - F.row_number().over(name.orderBy("k"))).alias("at"), F.lit(1).alias("used"))
    rows = wanted.select("dir", "name", F.row_number().over(name.orderBy("name")).cast("bigint").alias("at"), F.lit(0).alias("used"))
    # those in use with as many free ones before them as a wanted row's place stand behind it
    both = rows.union(taken).withColumn("before", F.sum("used").over(name.orderBy("at", "used").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.col("at") + F.col("before")
    return both.where("used = 0").select("dir", "name", F.when(number == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), number.cast("string"))).alias("copy"))


def picked(rows: DataFrame, column: str, typed: str) -> DataFrame:
    """Rows whose column contains what was typed, whatever the case."""
    return rows.where(F.contains(F.lower(column), F.lit(typed.lower())))


def discovered_only(discovered: DataFrame, connected: DataFrame) -> DataFrame:
    return discovered.join(connected.select("peer").distinct(), "peer", "left_anti")


def shown_findings(findings: DataFrame, order: list[str], n: int = CONFLICT_FINDINGS) -> tuple[DataFrame, int]:
    """The first n findings, and how many more there are."""
    return findings.orderBy(*order).limit(n), max(0, findings.count() - n)


def deepest_first(dirs: DataFrame) -> DataFrame:
    return dirs.orderBy(F.size("path").desc(), "path")


def connections(ledger: DataFrame) -> DataFrame:
    """ledger(peer, at, event: connected or disconnected): the last event of each peer."""
    return ledger.groupBy("peer").agg(F.max_by("event", "at").alias("event"), F.max("at").alias("at"))


def conflict_tail(log: DataFrame, seen: int, total: int) -> DataFrame:
    """Rows of log(line, ...) beyond the last count; a log that shrank is read from its start."""
    return log.where(F.col("line") >= (seen if total >= seen else 0))
