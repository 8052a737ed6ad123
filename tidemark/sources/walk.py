"""Full scans of a tree on a file system that all executors mount: links, flags, nanoseconds, empty files and directories included."""

from __future__ import annotations

import os
import stat
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunker import BITS, LEAST, MOST
from ..functions.names import nfc
from ..functions.paths import components
from ..operators.ignore import Policy, Layer, compile_rules, layers
from ..session import keep, ship
from .files import snapshot

STORE, LISTED = ".store", 10_000
FOUND = "raw string, kind string, exec boolean, size bigint, mtime_sec bigint, mtime_nsec int, target string"
STAT = ["size", "mtime_sec", "mtime_nsec", "exec"]


def entry(raw: str, e: os.DirEntry) -> tuple | None:
    """A row of ``FOUND``; none for what is no file, directory or link. A name that isn't UTF-8 is ``refused``."""
    s = e.stat(follow_symlinks=False)
    kind = "link" if stat.S_ISLNK(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else None
    if kind is None:
        return None
    target = os.readlink(e.path) if kind == "link" else None
    plain = lambda x: x if x is None else os.fsencode(x).decode("utf-8", "replace")
    if plain(raw) != raw or plain(target) != target:
        kind = "refused"
    return plain(raw), kind, kind == "file" and bool(s.st_mode & 0o100), s.st_size if kind == "file" else 0, s.st_mtime_ns // 10**9, s.st_mtime_ns % 10**9, plain(target)


def listed(dirs: DataFrame, root: str) -> DataFrame:
    """``FOUND`` of the children of dirs(raw); a directory that vanished meanwhile has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for pdf in parts:
            rows = []
            for up in pdf["raw"]:
                try:
                    children = os.scandir(os.path.join(root, up) if up else root)
                except FileNotFoundError:
                    continue
                with children:
                    for e in children:
                        try:
                            row = None if not up and e.name == STORE else entry(f"{up}/{e.name}" if up else e.name, e)
                        except FileNotFoundError:
                            continue
                        if row:
                            rows.append(row)
                        if len(rows) >= LISTED:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return dirs.select("raw").mapInPandas(run, FOUND)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """path, path_str (in NFC), raw, kind (file, dir, link, refused), exec, size, mtime_sec, mtime_nsec, target of all below the root.

    Level by level: the directories of one are listed in parallel and give the next. The store at the top is left out.
    """
    ship(spark)
    here, levels = spark.createDataFrame([("",)], "raw string"), []
    while True:
        levels.append(keep(listed(here, root), "level"))
        here = levels[-1].where("kind = 'dir'").select("raw")
        if here.isEmpty():
            break
        here = here.repartition("raw")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    name = nfc(F.col("raw"))
    return out.select(components(name).alias("path"), name.alias("path_str"), *out.columns)


#: Names of files whose lines are rules for the directory they are in; those of the root hold for the whole tree.
RULE_FILES = (".gitignore", "tidemark.ignore")
RULES = "array<struct<dir:string,lines:array<string>>>"


@dataclass(frozen=True)
class RuleSet:
    """What a walk obeys: rule files by name, in the order in which they hold, presets, and rules that override all."""

    names: tuple[str, ...] = RULE_FILES
    presets: tuple[str, ...] = ()
    overrides: tuple[str, ...] = ()


def rule_lines(folder: str, names: tuple[str, ...]) -> list[list[str]]:
    """The lines of each of a directory's rule files; none of one that isn't there or isn't text."""
    out = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out.append(f.read().splitlines())
        except (FileNotFoundError, IsADirectoryError, PermissionError, UnicodeDecodeError):
            out.append([])
    return out


class Decider:
    """Decisions for the entries of directories whose rules came with them; layers are compiled once."""

    def __init__(self, chain: list[str]):
        self.matcher, self.layer = Policy(chain).matcher(), lru_cache(maxsize=10_000)(lambda lines: Layer(compile_rules(lines)))

    def ignored(self, path: str, is_dir: bool, rules: list[tuple[str, tuple[str, ...]]]) -> bool:
        self.matcher.overlays = {d: self.layer(lines) for d, lines in rules}
        return self.matcher.decide(path, is_dir)


def admitted_below(dirs: DataFrame, root: str, chain: list[str], rules: RuleSet) -> DataFrame:
    """``FOUND`` and ``rules`` of the children of dirs(raw, rules) that no rule ignores.

    A directory's own rule files are read with it, and handed down with those of the directories above.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decider = Decider(chain)
        for pdf in parts:
            rows = []
            for up, above in zip(pdf["raw"], pdf["rules"]):
                folder = os.path.join(root, up) if up else root
                here = [(r["dir"], tuple(r["lines"])) for r in above]
                if up and (own := [x for lines in rule_lines(folder, rules.names) for x in lines]):
                    here.append((unicodedata.normalize("NFC", up), tuple(own)))
                down = [{"dir": d, "lines": list(x)} for d, x in here]
                try:
                    children = os.scandir(folder)
                except FileNotFoundError:
                    continue
                with children:
                    for e in children:
                        try:
                            row = None if not up and e.name == STORE else entry(f"{up}/{e.name}" if up else e.name, e)
                        except FileNotFoundError:
                            continue
                        if row and not decider.ignored(row[0], row[1] == "dir", here):
                            rows.append((*row, down if row[1] == "dir" else None))
                        if len(rows) >= LISTED:
                            yield pd.DataFrame(rows, columns=[*names, "rules"])
                            rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[*names, "rules"])

    return dirs.select("raw", "rules").mapInPandas(run, f"{FOUND}, rules {RULES}")


def walk_admitted(spark: SparkSession, root: str, rules: RuleSet | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``walk`` gives of all that no rule ignores, and the directories that were listed for it: raw.

    Rules are read on the way down: each level reads the rule files of its directories, hands their lines on as a column,
    and doesn't go into what they ignore. Only the root's own files are read first, as they hold for the whole tree.
    """
    ship(spark)
    rules = rules or RuleSet()

    def read_root(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(lines,) for _ in pdf["raw"] for lines in rule_lines(root, rules.names)], columns=["lines"])

    own = [r.lines for r in spark.createDataFrame([("",)], "raw string").repartition(1).mapInPandas(read_root, "lines array<string>").collect()]
    chain = layers(rules.presets, [], [x for lines in own for x in lines], rules.overrides)
    here, levels, listed_dirs = spark.createDataFrame([("", [])], f"raw string, rules {RULES}"), [], []
    while True:
        listed_dirs.append(here.select("raw"))
        levels.append(keep(admitted_below(here, root, chain, rules), "level"))
        here = levels[-1].where("kind = 'dir'").select("raw", "rules")
        if here.isEmpty():
            break
        here = here.repartition("raw")
    out, seen = reduce(DataFrame.union, levels), reduce(DataFrame.union, listed_dirs)
    name = nfc(F.col("raw"))
    return out.select(components(name).alias("path"), name.alias("path_str"), *[c.split()[0] for c in FOUND.split(", ")]), seen


def contents(files: DataFrame, root: str) -> DataFrame:
    """files(raw, ...) with ``content``, read one by one; a file that vanished meanwhile is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("raw")
            for i in range(batch.num_rows):
                try:
                    with open(os.path.join(root, batch.column(at)[i].as_py()), "rb") as f:
                        body = f.read()
                except FileNotFoundError:
                    continue
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([body], pa.binary())], names=[*row.schema.names, "content"])

    return files.mapInArrow(run, f"{', '.join(f'`{c}` {k}' for c, k in files.dtypes)}, content binary")


def full_snapshot(spark: SparkSession, root: str, polynomial: int, prior: DataFrame | None = None, least: int = LEAST, most: int = MOST, bits: int = BITS, rules: RuleSet | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, refused: path_str) of a walk, of all or of what ``rules`` admit; files whose size, times and flag are those of ``prior`` keep its chunks and aren't read."""
    found = keep(walk(spark, root) if rules is None else walk_admitted(spark, root, rules)[0], "walked")
    files = found.where("kind = 'file'")
    fresh = files if prior is None else files.join(prior.where("kind = 'file'").select("path_str", *STAT), ["path_str", *STAT], "left_anti").select(files.columns)
    out = snapshot(contents(fresh, root), polynomial, None, least, most, bits).where("kind = 'file'")
    if prior is not None:
        out = out.unionByName(prior.where("kind = 'file'").join(files.select("path_str", *STAT), ["path_str", *STAT], "left_semi").select(out.columns))
    rest = found.where("kind in ('dir', 'link')").withColumn("chunks", F.array().cast("array<struct<id:string,len:bigint>>"))
    return out.unionByName(rest.select(out.columns)), found.where("kind = 'refused'").select("path_str")
