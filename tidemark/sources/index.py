"""The blob index as a folder of numbered parts: appended to, loaded in the order of their names, compacted in place.

A part is a Parquet table of (kind, id, pack, plain_off, plain_len), named by its number. A compaction writes all rows once
as one part, whose name says that it stands for every part of a lower number, and then deletes those; a reader passes over
what a whole compaction stands for, so it doesn't matter where a compaction was cut off. A part counts once it is whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "kind string, id string, pack string, plain_off bigint, plain_len bigint"
KEYS = ["kind", "id", "pack", "plain_off", "plain_len"]
COMPACT_FROM = 512
NAME = re.compile(r"part-(\d{8})(-all)?")


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        self.system = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """The names of the parts that are read, in order."""
        if not self.system.exists(self.path("")):
            return []
        names = sorted(s.getPath().getName() for s in self.system.listStatus(self.path("")))
        whole = [n for n in names if NAME.fullmatch(n) and self.system.exists(self.path(f"{n}/_SUCCESS"))]
        first = max((n for n in whole if n.endswith("-all")), default="")
        return [n for n in whole if n >= first]

    def next_name(self) -> str:
        names = [s.getPath().getName() for s in self.system.listStatus(self.path(""))] if self.system.exists(self.path("")) else []
        return f"part-{1 + max((int(m[1]) for m in map(NAME.fullmatch, names) if m), default=0):08d}"

    def append(self, rows: DataFrame) -> str:
        name = self.next_name()
        rows.select(*KEYS).write.parquet(f"{self.folder}/{name}")
        return name

    def load(self) -> DataFrame:
        """All rows with ``part``, the name, and ``ord``, which orders them: by part, file and place there."""
        names = self.parts()
        if not names:
            return self.spark.createDataFrame([], f"{COLUMNS}, part string, ord struct<part:string,file:string,row:bigint>")
        rows = self.spark.read.schema(COLUMNS).parquet(*(f"{self.folder}/{n}" for n in names))
        part = F.regexp_extract("_metadata.file_path", r"/(part-\d{8}(?:-all)?)/[^/]*$", 1)
        return rows.select("*", part.alias("part"), F.struct(part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("ord"))

    def places(self) -> DataFrame:
        """Each different row once, with the ``ord`` of its first."""
        return self.load().groupBy(*KEYS).agg(F.min("ord").alias("ord"))

    def compact(self, least: int = COMPACT_FROM) -> bool:
        """Rewrite the parts as one if there are ``least`` or more; rows keep the order of their first places."""
        names = self.parts()
        if len(names) < least:
            return False
        name = self.next_name() + "-all"
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.places().repartitionByRange(n, "ord").sortWithinPartitions("ord").select(*KEYS).write.parquet(f"{self.folder}/{name}")
        for s in self.system.listStatus(self.path("")):
            if NAME.fullmatch(s.getPath().getName()) and s.getPath().getName() < name:
                self.system.delete(s.getPath(), True)
        return True
