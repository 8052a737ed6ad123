"""Snapshots of file trees, ledgers in JSON lines, and the sinks that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunker import BITS, LEAST, MOST, chunks
from ..functions.names import nfc
from ..functions.paths import components, proper_ancestors

STAMP = "struct<device:string,mtime_sec:bigint,mtime_nsec:int>"
CONFLICT = f"ts string, folder_id string, path string, kind string, winner {STAMP}, loser {STAMP}, quarantined_as string"
HELD = "held_sec bigint, held_nsec int, path string, device_id string, remote_manifest_id string, chunks array<struct<id:string,len:bigint>>, decision string, conflict_winner string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files below root: path array, path_str, size, mtime_sec, mtime_nsec, and content, which only chunking reads.

    A path of object stores and file systems alike; these give no exec bits, links, nanoseconds, empty directories or empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = nfc(F.substring_index(F.regexp_replace("path", r"^[a-z]+:/+", ""), base + "/", -1))
    us = F.unix_micros("modificationTime")
    return files.select(rel.alias("path_str"), components(rel).alias("path"), F.col("length").alias("size"), F.floor(us / 1_000_000).cast("bigint").alias("mtime_sec"), (F.pmod(us, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_nsec"), F.lit(False).alias("exec"), "content")


def snapshot(files: DataFrame, polynomial: int, prior: DataFrame | None = None, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """Entries of scanned files and of the directories above them; contents are read only where size, times or flag differ from ``prior``."""
    stat = ["size", "mtime_sec", "mtime_nsec", "exec"]
    if prior is None:
        fresh, reused = files, None
    else:
        same = prior.where("kind = 'file'").select("path_str", *stat, F.col("chunks").alias("reused"))
        fresh = files.join(same.drop("reused"), ["path_str", *stat], "left_anti")
        reused = files.drop("content").join(same, ["path_str", *stat])
    cut = chunks(fresh, polynomial, "path_str", "content", least, most, bits)
    lists = cut.groupBy("path_str").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", "len"))), lambda c: F.struct(c["id"].alias("id"), c["len"].alias("len"))).alias("chunks"))
    none = F.array().cast("array<struct<id:string,len:bigint>>")
    cols = ["path", "path_str", F.lit("file").alias("kind"), "exec", "size", "mtime_sec", "mtime_nsec"]
    out = fresh.drop("content").join(lists, "path_str", "left").select(*cols, F.coalesce("chunks", none).alias("chunks"))
    if reused is not None:
        out = out.unionByName(reused.select(*cols, F.col("reused").alias("chunks")))
    dirs = files.select(F.explode(proper_ancestors(F.col("path"))).alias("path_str")).distinct()
    dirs = dirs.select(F.split("path_str", "/").alias("path"), "path_str", F.lit("dir").alias("kind"), F.lit(False).alias("exec"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_sec"), F.lit(0).alias("mtime_nsec"), none.alias("chunks"))
    return out.unionByName(dirs).withColumn("target", F.lit(None).cast("string"))


def incremental(prior: DataFrame, rescanned: DataFrame, dirty: DataFrame) -> DataFrame:
    """Prior entries outside the dirty directories (column ``dir``), and what rescanning those found.

    A dirty directory speaks for its direct children: those not found again are gone, with all below them.
    """
    parent = F.when(F.size("path") > 1, F.array_join(F.slice("path", 1, F.size("path") - 1), "/")).otherwise("")
    listed = prior.withColumn("dir", parent).join(dirty, "dir", "left_semi").drop("dir")
    gone = listed.join(rescanned, "path_str", "left_anti").select(F.col("path_str").alias("up"))
    below = prior.select("path_str", F.explode(proper_ancestors(F.col("path"))).alias("up")).join(gone, "up", "left_semi").select("path_str").distinct()
    kept = prior.join(listed.select("path_str"), "path_str", "left_anti").join(below, "path_str", "left_anti")
    return kept.join(rescanned, "path_str", "left_anti").unionByName(rescanned)


def stat_sweep(live: DataFrame, cache: DataFrame, ignored: Column | None = None) -> DataFrame:
    """Paths to rescan: new or changed files, links always, and the directory of what vanished.

    What a rule ignores (a column of live, such as of ``Policy``) is as good as not there.
    """
    live = live if ignored is None else live.where(~ignored)
    stat = ["kind", "exec", "size", "mtime_sec", "mtime_nsec"]
    both = live.select("path_str", F.struct(*stat).alias("now")).join(cache.select("path_str", F.struct(*stat).alias("was")), "path_str", "full_outer")
    parent = F.when(F.contains("path_str", F.lit("/")), F.regexp_replace("path_str", r"/[^/]*$", "")).otherwise("")
    out = F.when(F.col("now").isNull(), parent).when((F.col("now.kind") == "link") | ~F.col("now").eqNullSafe(F.col("was")), F.col("path_str"))
    return both.select(out.alias("path_str")).where("path_str is not null").distinct()


def put(blobs: DataFrame, index: DataFrame) -> DataFrame:
    """blobs(kind, id, body) to be stored: once each, none that the index has, none empty."""
    return blobs.where("length(body) > 0").dropDuplicates(["kind", "id"]).join(index.select("kind", "id").distinct(), ["kind", "id"], "left_anti")


def get(wanted: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """wanted(id) read from packs(pack, body) at index(id, pack, plain_off, plain_len, ord): id, pack, body, error.

    Of an id's places, in their order, the first whose pack exists and whose bytes hash to the id is read; an id that has
    none has a null body and ``not_found`` (no such place or pack) or ``hash_mismatch`` as its error.
    """
    body = F.expr("substring(body, cast(plain_off + 1 as int), cast(plain_len as int))")
    read = wanted.select("id").distinct().join(index, "id").join(packs, "pack").select("id", "pack", "ord", body.alias("body")).withColumn("ok", F.sha2("body", 256) == F.col("id"))
    first = read.groupBy("id").agg(F.min_by(F.when(F.col("ok"), F.struct("pack", "body")), F.when(F.col("ok"), F.struct("ord", "pack"))).alias("r"))
    out = wanted.join(first.withColumn("met", F.lit(True)), "id", "left")
    error = F.when(F.col("r").isNotNull(), None).when(F.col("met"), "hash_mismatch").otherwise("not_found")
    return out.select("id", "r.pack", "r.body", error.alias("error"))


def verify(regions: DataFrame) -> DataFrame:
    """regions(id, body) whose body isn't what the id says."""
    return regions.where(F.sha2("body", 256) != F.col("id"))


def read_conflicts(spark: SparkSession, path: str) -> DataFrame:
    """Conflicts in JSON lines; a malformed line is an error."""
    return spark.read.schema(CONFLICT).option("mode", "FAILFAST").json(path)


def read_held(spark: SparkSession, path: str) -> DataFrame:
    """Held entries in JSON lines, one file a peer; a torn last line (no newline after it) is dropped, others are errors."""
    whole = spark.read.text(path, wholetext=True)
    ended = F.regexp_replace("value", r"(?s)(^|\n)[^\n]*\z", "$1")
    lines = whole.select(F.explode(F.split(ended, "\n")).alias("line")).where("trim(line) <> ''")
    return lines.select(F.from_json("line", HELD, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def json_documents(rows: DataFrame, column: str = "document") -> DataFrame:
    """Each row as one JSON document, nulls included; ``.write.text`` puts them out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(column))


def stale_temps(files: DataFrame, now_sec: int, pattern: str = r"(^|/)\.tmp-[^/]*$", age: int = 86_400) -> DataFrame:
    """Temporary files older than a day."""
    return files.where(F.col("path_str").rlike(pattern) & (F.col("mtime_sec") < now_sec - age)).orderBy("path_str")


# patterns of this library; the classes are env files, private keys, credentials and registries' tokens
SECRET_NAMES = {"env-file": r"(^|/)\.env(\.[^/]*)?$", "private-key-file": r"(^|/)(id_rsa|id_ed25519|[^/]*\.pem)$", "credentials-json": r"(^|/)credentials[^/]*\.json$", "npmrc": r"(^|/)\.npmrc$"}
SECRET_LINES = {"aws-access-key": r"\bAKIA[0-9A-Z]{16}\b", "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "bearer-token": r"(?i)\bbearer\s+[a-z0-9._-]{20,}", "assigned-secret": r"""(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*['"]?[^\s'"]{8,}"""}


def secret_names(paths: DataFrame) -> DataFrame:
    """(path, line, class, preview) by name alone; line is null."""
    found = F.coalesce(*(F.when(F.col("path").rlike(r), F.lit(c)) for c, r in SECRET_NAMES.items()))
    return paths.select("path", F.lit(None).cast("int").alias("line"), found.alias("class"), F.lit(None).cast("string").alias("preview")).where("class is not null")


def secret_lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, class, preview) of lines that hold a secret; the first class that fits counts, the preview is redacted."""
    from ..functions.formats import redacted

    lines = texts.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("i", "s"))
    cls = F.coalesce(*(F.when(F.col("s").rlike(r), F.lit(c)) for c, r in SECRET_LINES.items()))
    hit = F.coalesce(*(F.when(F.col("s").rlike(r), F.regexp_extract("s", f"({r})", 1)) for r in SECRET_LINES.values()))
    return lines.select("path", (F.col("i") + 1).alias("line"), cls.alias("class"), redacted(hit).alias("preview")).where("class is not null")


def shared_secrets(texts: DataFrame, ignored: Column, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, class, preview) by name and by line, of the files that no rule ignores (a column such as of ``Policy``)."""
    shared = texts.where(~ignored)
    return secret_names(shared.select(F.col(path).alias("path"))).union(secret_lines(shared, path, text))
