"""Folds over rows in order, without one task for all rows of a key.

Rows are cut into blocks of consecutive rows. Each block says what it does to the state that reaches it, the few rows of
that are chained along a key's blocks, and then every block is folded by itself from the state it starts with.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep, ship

BLOCK_ROWS = 250_000


def blocks(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``_at``, ascending in (key, order), and ``_block``: written, ranges of about ``BLOCK_ROWS`` rows."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // BLOCK_ROWS)
    dealt = rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    return keep(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_at", 33)), "blocks")


def with_previous(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with ``name``: the value, a struct, of the row before of the same key; null at the first.

    Blocks look at their own rows, and a key's first row in a block at the last of its block before.
    """
    cut = blocks(rows, key, order).withColumn("_value", value)
    here = Window.partitionBy(key, "_block").orderBy("_at")
    last = cut.groupBy(key, "_block").agg(F.max_by("_value", "_at").alias("_last"))
    before = last.select(F.col(key).alias("_key"), F.col("_block").alias("_in"), F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_before")).where("_before is not null")
    met = cut.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_in")), "left")
    return met.withColumn(name, F.coalesce(F.lag("_value").over(here), "_before")).drop("_value", "_key", "_in", "_before", "_at", "_block")


@dataclass
class Fit:
    """A bin ends before the item that would overflow it, if it isn't empty; ``sums`` are those up to each item."""

    target: int
    after = 0

    def head(self, sums: np.ndarray) -> int:
        return min(len(sums), int(np.searchsorted(sums, self.target)) + 1)

    def is_fresh(self, count: int, size: int) -> bool:
        return size == 0

    def end(self, sums: np.ndarray, count: int, size: int) -> int:
        return int(np.searchsorted(sums, self.target - size, "right"))

    def next_starts(self, before: np.ndarray) -> np.ndarray:
        """Of a bin that starts at each item where the next one does; over all items if it doesn't end here."""
        sums, m = before[1:], len(before) - 1
        j = np.searchsorted(sums, before + self.target, "right")
        j += (j < m) & (before[np.minimum(j, m)] == before)  # an item over the target fills an empty bin
        return np.where(j < m, j, m + 1)


@dataclass
class Cut:
    """A bin ends with its ``most``-th item or the one that brings it to ``flush``."""

    most: int
    flush: int
    after = 1

    def head(self, sums: np.ndarray) -> int:
        return min(len(sums), self.most)

    def is_fresh(self, count: int, size: int) -> bool:
        return count == 0

    def end(self, sums: np.ndarray, count: int, size: int) -> int:
        return min(int(np.searchsorted(sums, self.flush - size)), self.most - 1 - count)

    def next_starts(self, before: np.ndarray) -> np.ndarray:
        m = len(before) - 1
        j = np.minimum(np.searchsorted(before[1:], before + self.flush) + 1, np.arange(m + 1) + self.most)
        return np.where(j <= m, j, m + 1)


def exits(rule: Fit | Cut, before: np.ndarray) -> list[tuple[int, int, int]]:
    """Of a bin that starts at each item: items and size of the last bin at the end of the block, and the bins begun since.

    Where the next bin of the next bin starts, and of four, of eight: by doubling all bins reach their last one at once.
    """
    m, total = len(before) - 1, int(before[-1])
    at = np.arange(m + 1)
    nxt = rule.next_starts(before)
    leap, begun = np.where((nxt <= m) & (nxt != at), nxt, at), ((nxt <= m) & (nxt != at)).astype(np.int64)
    while True:
        further = leap[leap]
        if (further == leap).all():
            break
        begun, leap = begun + begun[leap], further
    return list(zip((m - leap).tolist(), (total - before[leap]).tolist(), begun.tolist()))


def segments(pdf: pd.DataFrame, key: str, length: str):
    """(key, first row, end row, sums before each item) of the keys of a block, whose rows are in order."""
    k = pdf[key]
    new = (k != k.shift()) & ~(k.isna() & k.shift().isna())
    starts = np.flatnonzero(new.to_numpy() | (np.arange(len(k)) == 0))
    sizes = pdf[length].to_numpy(np.int64)
    for i, j in zip(starts, [*starts[1:], len(k)]):
        yield k.iat[i], i, j, np.concatenate([[0], np.cumsum(sizes[i:j])])


def in_bins(rows: DataFrame, key: str, order: list[str], length: str, rule: Fit | Cut, name: str) -> DataFrame:
    """rows with a column ``name``: the number of each row's bin, from 0 on in each key; null lengths count as 0.

    What a block does to a bin that reaches it depends on the item at which that bin ends. These items are one bin's
    at most, and neighbours of the same outcome are one entry.
    """
    cut = blocks(rows.withColumn("_len", F.coalesce(F.col(length).cast("bigint"), F.lit(0))), key, order)
    kind, columns = dict(rows.dtypes)[key], rows.columns
    ship(rows.sparkSession)

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        every, out = list(segments(pdf, key, "_len")), []
        for k, _, _, before in every[:1] + every[1:][-1:]:
            sums, leave = before[1:], exits(rule, before)
            limits, ends = [], []
            for i in range(rule.head(sums)):
                n, size, bins = leave[i + rule.after]
                if rule.after == 0 and ends and ends[-1] == (n, size, bins + 1):
                    limits[-1] = int(sums[i])
                else:
                    limits.append(int(sums[i]))
                    ends.append((n, size, bins + 1))
            out.append({key: k, "_block": pdf["_block"].iat[0], "items": len(sums), "total": int(before[-1]), "fresh": list(leave[0]), "limits": limits, "ends": [list(e) for e in ends]})
        return pd.DataFrame(out)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, count, size, bins = [], 0, 0, 0
        for row in pdf.sort_values("_block").to_dict("records"):
            out.append((row[key], row["_block"], count, size, bins))
            limits = np.array(row["limits"], np.int64)
            if rule.is_fresh(count, size):
                count, size, more = (int(x) for x in row["fresh"])
            elif (at := rule.end(limits, count, size)) < len(limits):
                count, size, more = (int(x) for x in row["ends"][at])
            else:
                count, size, more = count + row["items"], size + row["total"], 0
            bins += more
        return pd.DataFrame(out, columns=[key, "_block", "count", "size", "bins"])

    def number(pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        first = {None if pd.isna(k) else k: (c, s, b) for k, c, s, b in zip(states[key], states["count"], states["size"], states["bins"])}
        out = np.zeros(len(pdf), np.int64)
        for k, i, j, before in segments(pdf, key, "_len"):
            count, size, bins = first.get(None if pd.isna(k) else k, (0, 0, 0))
            nxt, m = rule.next_starts(before), j - i
            if rule.is_fresh(count, size):
                at = int(nxt[0])
            else:
                end = rule.end(before[1:], count, size)
                at = end + rule.after if end < m else m + 1
            flags = np.zeros(m + 1, np.int64)
            while at < m:
                flags[at], at = 1, int(nxt[at])
            out[i:j] = bins + np.cumsum(flags[:m])
        return pdf.assign(**{name: out})[[*columns, name]]

    told = cut.select(key, "_len", "_at", "_block").groupBy("_block").applyInPandas(outcomes, f"`{key}` {kind}, _block bigint, items bigint, total bigint, fresh array<bigint>, limits array<bigint>, ends array<array<bigint>>")
    starts = keep(told.groupBy(key).applyInPandas(chain, f"`{key}` {kind}, _block bigint, count bigint, size bigint, bins bigint"), "starts")
    return cut.groupBy("_block").cogroup(starts.groupBy("_block")).applyInPandas(number, f"{', '.join(f'`{c}` {k}' for c, k in rows.dtypes)}, `{name}` bigint")
