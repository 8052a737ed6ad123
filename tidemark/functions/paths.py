"""Paths: arrays of components, and their strings joined by '/'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(path: Column) -> Column:
    return F.array_join(path, "/")


def components(path: Column) -> Column:
    """Components of a path string; none for the empty string."""
    return F.filter(F.split(path, "/"), lambda c: c != "")


def proper_ancestors(path: Column) -> Column:
    """Strings of all proper prefixes of a component array, without the root."""
    n = F.size(path)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def with_root(path: Column) -> Column:
    """Strings of all prefixes, from the root ('') to the path itself."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda i: F.array_join(F.slice(path, F.lit(1), i), "/"))


def nests(prefix: Column, whole: Column) -> Column:
    """Whether ``prefix`` is a proper ancestor of ``whole``; both are strings."""
    return F.startswith(whole, F.concat(prefix, F.lit("/")))


def enclosing_dirs(path: Column) -> Column:
    """What to rescan when a path changed: itself and its parent, or the root for the root."""
    parent = F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), "/")
    return F.when(F.size(path) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.array(joined(path), parent)))


def close_under_ancestors(dirty: DataFrame) -> DataFrame:
    """dirty(path) with every prefix of every path, the root included, once each."""
    return dirty.select(F.explode(with_root(F.col("path"))).alias("dir")).distinct()


def nested_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_path, right_path) in which one is a proper ancestor of the other.

    A theta join made equi: the deeper side is exploded into its ancestors, so work is rows times depth.
    """
    a, b = left.select(F.col("path_str").alias("left_path"), F.split("path_str", "/").alias("p")), right.select(F.col("path_str").alias("right_path"), F.split("path_str", "/").alias("p"))
    up = lambda df: df.withColumn("up", F.explode(proper_ancestors(F.col("p")))).drop("p")
    down = up(b).join(a.drop("p"), F.col("up") == F.col("left_path"))
    across = up(a).join(b.drop("p"), F.col("up") == F.col("right_path"))
    return down.select("left_path", "right_path").union(across.select("left_path", "right_path"))
