"""Session helpers: shared scratch tables and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Paths of the tables that are kept, in the order of their writing.
_kept: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers this package, as an archive that Spark distributes; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as d:
            made = os.path.join(d, "tidemark.zip")
            with zipfile.ZipFile(made, "w") as z:
                for folder, _, names in os.walk(package):
                    for name in sorted(x for x in names if x.endswith(".py")):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(package)))
            local, path = (sc._jvm.org.apache.hadoop.fs.Path(x) for x in (f"file://{made}", scratch(spark, "tidemark.zip")))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).copyFromLocalFile(local, path)
        sc.addPyFile(path.toString())
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)  # with its scheme, for those who don't know Spark's default
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{label}"


def keep(df: DataFrame, label: str, clear: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    ``clear`` is for large ones: Spark deletes shuffle files of ended jobs when the driver's JVM collects its garbage,
    which it is asked to do, as it seldom needs to by itself.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    _kept.append(path)
    if clear:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def is_kept(df: DataFrame) -> bool:
    """Whether a table made by ``keep`` is still there."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "kept_at", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
    if path in _kept:
        _kept.remove(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes all tables that were kept within the block, but those that are put into the list.

    Operators leave the tables that their results still read; once a result is written, nothing does.
    """
    before, stay = set(_kept), []
    yield stay
    for path in [p for p in _kept if p not in before and p not in {getattr(df, "kept_at", None) for df in stay}]:
        _delete(spark, path)
