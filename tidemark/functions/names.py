"""Names and links: what may be stored everywhere, and what collides."""

from __future__ import annotations

from collections.abc import Iterable

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: device names that some systems can't store
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def nfc(name: Column) -> Column:
    """Unicode composition. Spark has no such function, so this is an Arrow UDF."""
    return _compose(name)


def fold_key(name: Column, composed: bool = False) -> Column:
    """What names compare by where case doesn't count; ``composed`` says that the name is in NFC already."""
    return F.replace(F.lower(name if composed else nfc(name)), F.lit("ς"), F.lit("σ"))


def is_reserved(name: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(name, ".", 1), r"[ .]+$", "")
    return F.upper(stem).isin(RESERVED)


def link_refusal(target: Column, depth: Column) -> Column:
    """absolute_target, escapes_root, or null for a link that may be kept; depth counts the directories above it."""
    absolute = target.rlike(r"^[/\\]") | target.rlike(r"^[A-Za-z]:")
    start = F.struct(depth.cast("bigint").alias("now"), depth.cast("bigint").alias("least"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "..", -1).when(c.isin("", "."), 0).otherwise(1)
        return F.struct(now.alias("now"), F.least(a["least"], now).alias("least"))

    walked = F.aggregate(F.split(target, r"[/\\]"), start, step)
    return F.when(absolute, "absolute_target").when(walked["least"] < 0, "escapes_root")


def refusal(name: Column, kind: Column, target: Column, depth: Column) -> Column:
    """Why an entry isn't admitted, or null. A null name is one that isn't UTF-8, a null target of a link likewise."""
    link = link_refusal(target, depth)
    return (
        F.when(name.isNull(), "non_utf8_name")
        .when(is_reserved(name), "reserved_name")
        .when(kind == "other", "unknown_file_type")
        .when((kind == "link") & target.isNull(), "non_utf8_symlink_target")
        .when((kind == "link") & (link == "absolute_target"), "absolute_symlink_target")
        .when((kind == "link") & (link == "escapes_root"), "escaping_symlink_target")
    )


def component_error(name: Column) -> Column:
    """Why a name can't be a component when writing, or null."""
    return F.when(name == "", "empty").when(name.isin(".", ".."), "dots").when(name.rlike(r"[/\\:\x00]"), "separator")


def sibling_collisions(entries: DataFrame) -> DataFrame:
    """entries(parent, name): (parent, name, n) of names that several entries of a directory have once composed."""
    return entries.groupBy("parent", nfc(F.col("name")).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def case_collisions(entries: DataFrame, composed: bool = False) -> DataFrame:
    """entries(parent, name): (parent, fold, n) of different names that are one where case doesn't count."""
    name = F.col("name") if composed else nfc(F.col("name"))
    named = entries.select("parent", name.alias("name")).distinct()
    return named.groupBy("parent", fold_key(F.col("name"), True).alias("fold")).agg(F.count("*").alias("n")).where("n > 1")


def spare(taken: Iterable[str], name: str) -> str:
    """``name`` for a column that is added for a while, with as many underscores before it as make it none of ``taken``, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name
