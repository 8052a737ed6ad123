"""Live contents against chunk lists, region by region, without chunking anew."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a file that one task compares.
STRETCH = 64 << 20


def first_mismatch(data: Column, chunks: Column) -> Column:
    """The first region, from 0 on, of a binary column that isn't what chunks array<struct<id, len>> says; null if all are.

    Bytes beyond the last region are not compared; a content that ends before a region does differs there.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("off"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))

    def step(s: Column, c: Column) -> Column:
        body = F.substring(data, (s["off"] + 1).cast("int"), c["len"].cast("int"))
        differs = (F.length(body) < c["len"]) | (F.sha2(body, 256) != c["id"])
        bad = F.when(s["bad"].isNotNull(), s["bad"]).when(differs, s["i"])
        return F.struct((s["off"] + c["len"]).alias("off"), (s["i"] + 1).alias("i"), bad.alias("bad"))

    return F.aggregate(chunks, start, step)["bad"]


def file_mismatches(wanted: DataFrame) -> DataFrame:
    """(path, mismatch) of wanted(path, chunks array<struct<id, len>>): the first region of each file that differs, null if none does.

    Files are of a file system that executors mount. Their regions are dealt in stretches, each of which stops at its first
    that differs; a file that isn't there differs at region 0.
    """
    regions = wanted.select("path", F.posexplode_outer("chunks").alias("i", "c")).select("path", "i", "c.*")
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk of a file
    placed = regions.withColumn("off", F.coalesce(F.sum("len").over(before), F.lit(0)))
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now = f = None
        stopped = False
        for batch in batches:
            out = []
            for path, stretch, i, key, n, at in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (path, stretch) != now:
                    now, stopped = (path, stretch), False
                    if f:
                        f.close()
                    try:
                        f = open(path, "rb")
                    except (FileNotFoundError, NotADirectoryError):
                        f = None
                if stopped or i is None and f:
                    continue
                if f:
                    f.seek(at)
                    body = f.read(n)
                    if len(body) == n and hashlib.sha256(body).hexdigest() == key:
                        continue
                out.append((path, i or 0))
                stopped = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int32()))], names=["path", "i"])
        if f:
            f.close()

    stretch = F.floor(F.col("off") / STRETCH).alias("stretch")
    dealt = placed.select("path", stretch, "i", "id", "len", "off").repartition(parts, "path", "stretch").sortWithinPartitions("path", "stretch", "i")
    found = dealt.mapInArrow(run, "path string, i int").groupBy("path").agg(F.min("i").alias("mismatch"))
    return wanted.select("path").join(found, "path", "left")
