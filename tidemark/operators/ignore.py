"""Layered ignore rules: the last match wins, and what lies in an ignored directory stays ignored.

Rules are configuration, some thousands at most, and are compiled on the driver. ``ignored`` evaluates them in an
Arrow UDF (exact names and endings by look-up, the rest by one regular expression each); ``ignored_column`` is a plain
expression for short rule lists.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import proper_ancestors

# fixed values: rules that hold before all others
DEFAULT_RULES = [".DS_Store", "Thumbs.db", "desktop.ini", "*.swp", "*~", "node_modules/", ".env", ".env.*"]
# fixed values: presets, as excluded and then re-included patterns
PRESETS = {
    "claude": {
        "excludes": ["projects/**/sessions/**", "**/*.log", "statsig/", "telemetry/", "cache/", "shell-snapshots/", "downloads/"],
        "includes": ["CLAUDE.md", "settings.json", "memory/**", "skills/**", "commands/**", "agents/**", "projects/*/memory/**"],
    },
    "opencode": {
        "excludes": ["sessions/**", "**/*.log", "cache/", "tmp/", "node_modules/"],
        "includes": ["AGENTS.md", "opencode.json", "agent/**", "agents/**", "command/**", "commands/**", "plugin/**", "plugins/**", "skill/**", "skills/**", "memory/**"],
    },
}
#: What the last component of a quarantined copy contains; such names are never ignored.
MARKER = ".conflict."


@dataclass(frozen=True)
class Rule:
    pattern: str
    regex: str
    negated: bool
    dir_only: bool


def preset_lines(name: str) -> list[str]:
    p = PRESETS[name]
    return [*p["excludes"], *("!" + x for x in p["includes"])]


def _glob(pattern: str) -> str | None:
    """The body of a regular expression for a glob over '/'-joined paths; null for a bad one."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == n:
            out.append("/.+")
            i += 3
        elif c == "*":
            while i + 1 < n and pattern[i + 1] == "*":
                i += 1
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            negate = body[0] in "!^"
            body = body[1:] if negate else body
            out.append("[" + "^" * negate + body.replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end + 1
        elif c == "\\":
            if i + 1 == n:
                return None
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def compile_line(line: str) -> Rule | None:
    """A rule, or null for blank lines, comments and bad globs."""
    text = unicodedata.normalize("NFC", line).rstrip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    body = text[1:] if negated else text
    if body.startswith(("\\!", "\\#")):
        body = body[1:]
    dir_only = body.endswith("/")
    body = body.rstrip("/") if dir_only else body
    anchored = "/" in body
    glob = _glob(body.lstrip("/"))
    if not body.strip("/") or glob is None:
        return None
    return Rule(text, f"^{'' if anchored else '(?:.*/)?'}{glob}$", negated, dir_only)


def compile_rules(lines: Iterable[str]) -> list[Rule]:
    return [r for r in map(compile_line, lines) if r]


def bad_lines(lines: Iterable[str]) -> int:
    """How many lines are rules that can't be compiled."""
    return sum(1 for x in lines if x.rstrip() and not x.startswith("#") and compile_line(x) is None)


class BadPattern(ValueError):
    """A pin's pattern that is no glob."""


def validated_pins(patterns: list[str]) -> list[str]:
    """The patterns of a pin, if all can be compiled; a pin on everything needs no other."""
    if "*" not in patterns:
        for line in patterns:
            if bad_lines([line]):
                raise BadPattern(f"bad pattern: {line}")
    return patterns


def bad_pins(pins: DataFrame, pin: str, pattern: str) -> DataFrame:
    """(pin, pattern) of pins that are refused: each pattern that can't be compiled, of pins that don't hold everything."""

    @F.pandas_udf("boolean")
    def bad(lines: pd.Series) -> pd.Series:
        return pd.Series([x is not None and bad_lines([x]) > 0 for x in lines], dtype="bool")

    every = pins.where(F.col(pattern) == "*").select(pin).distinct()
    return pins.join(every, pin, "left_anti").where(bad(F.col(pattern))).select(pin, pattern)


def layers(config_presets: Iterable[str] = (), root_git: Iterable[str] = (), root_rules: Iterable[str] = (), overrides: Iterable[str] = ()) -> list[str]:
    """All lines that hold for the whole tree, weakest first."""
    return [*DEFAULT_RULES, *root_git, *root_rules, *(x for p in config_presets for x in preset_lines(p)), *overrides]


class Policy:
    """Rules for the whole tree, and for single directories (by their path) over those."""

    def __init__(self, lines: Iterable[str], overlays: dict[str, list[str]] | None = None, marker: str = MARKER):
        self.chain, self.marker = compile_rules(lines), marker
        self.overlays = {d: compile_rules(x) for d, x in (overlays or {}).items()}

    def matcher(self):
        """decide(path, is_dir) with memos of directories; made where it runs."""
        return Matcher(self)

    def ignored(self, path: Column, is_dir: Column) -> Column:
        """A boolean column, by an Arrow UDF."""
        policy = self

        @F.pandas_udf("boolean")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            decide = policy.matcher().decide  # once for all batches of a task
            for paths, dirs in batches:
                yield pd.Series([p is not None and decide(p, bool(d)) for p, d in zip(paths, dirs)], dtype="bool")

        return run(path, is_dir)


#: Rules beyond this number are looked up in a function instead of an expression each.
LONG = 50


class Layer:
    """Rules of one layer: the last that matches, found by name, by ending, or by expression."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.names, self.endings, self.rest = rules, {}, {}, []
        for i, r in enumerate(rules):
            body = r.pattern.removeprefix("!").rstrip("/")
            if re.fullmatch(r"[\w .-]+", body):
                self.names.setdefault(body, []).append(i)
            elif re.fullmatch(r"\*\.[\w-]+", body):
                self.endings.setdefault(body[1:], []).append(i)
            else:
                self.rest.append((i, re.compile(r.regex, re.S)))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        name = path.rpartition("/")[2]
        found = [*self.names.get(name, ()), *(self.endings.get("." + name.rpartition(".")[2], ()) if "." in name else ())]
        found += [i for i, x in self.rest if x.match(path)]
        last = max((i for i in found if is_dir or not self.rules[i].dir_only), default=None)
        return None if last is None else not self.rules[last].negated


class Matcher:
    def __init__(self, policy: Policy):
        self.marker = policy.marker
        self.chain = Layer(policy.chain)
        self.overlays = {d: Layer(r) for d, r in policy.overlays.items()}
        self.dir_ignored = lru_cache(maxsize=100_000)(self._dir_ignored)

    def verdict(self, path: str, is_dir: bool) -> bool:
        out = self.chain.verdict(path, is_dir)
        at = path.find("/")
        while at > 0 and self.overlays:
            if (layer := self.overlays.get(path[:at])) and (v := layer.verdict(path[at + 1 :], is_dir)) is not None:
                out = v
            at = path.find("/", at + 1)
        return bool(out)

    def _dir_ignored(self, path: str) -> bool:
        parent = path.rpartition("/")[0]
        return bool(parent) and self.dir_ignored(parent) or self.verdict(path, True)

    def dropped(self, path: str, store: str) -> bool:
        """Whether an event for the path says nothing: below the store, in an ignored directory, or ignored as file and as directory."""
        parts = path.split("/")
        if store in parts:
            return True
        above = any(self.chain.verdict("/".join(parts[:k]), True) for k in range(1, len(parts)))
        return above or bool(self.chain.verdict(path, False)) and bool(self.chain.verdict(path, True))

    def decide(self, path: str, is_dir: bool) -> bool:
        path = unicodedata.normalize("NFC", path)
        if not path or self.marker in path.rpartition("/")[2]:
            return False
        parent = path.rpartition("/")[0]
        return bool(parent) and self.dir_ignored(parent) or self.verdict(path, is_dir)


def verdict_column(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """Whether the last rule that matches this path ignores it, ancestors apart."""
    out = F.lit(False)
    for r in rules:
        hit = path.rlike(r.regex) & is_dir if r.dir_only else path.rlike(r.regex)
        out = F.when(hit, F.lit(not r.negated)).otherwise(out)
    return out


def ignored_column(path: Column, is_dir: Column, rules: list[Rule], marker: str = MARKER) -> Column:
    """The decision for a path string as an expression; for rule lists of up to some dozens."""
    above = F.exists(proper_ancestors(F.split(path, "/")), lambda p: verdict_column(p, F.lit(True), rules))
    kept = F.contains(F.element_at(F.split(path, "/"), -1), F.lit(marker))
    return F.when((path == "") | kept, F.lit(False)).otherwise(above | verdict_column(path, is_dir, rules))


def event_dropped(path: Column, rules: list[Rule], store: str = ".store") -> Column:
    """Whether a watch event for the path is dropped: below the store, in an ignored directory, or ignored as file and as directory.

    Long lists of rules are looked up, as an expression for each of thousands is no plan.
    """
    if len(rules) > LONG:
        policy = Policy([])
        policy.chain = rules

        @F.pandas_udf("boolean")
        def drops(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = policy.matcher()
            for paths in batches:
                yield pd.Series([None if p is None else matcher.dropped(p, store) for p in paths], dtype="boolean")

        return drops(path)
    inside = F.array_contains(F.split(path, "/"), store)
    above = F.exists(proper_ancestors(F.split(path, "/")), lambda p: verdict_column(p, F.lit(True), rules))
    return inside | above | (verdict_column(path, F.lit(False), rules) & verdict_column(path, F.lit(True), rules))


def held_column(path: Column, patterns: list[str]) -> Column:
    """Whether a pin holds a path: '*' holds all; else a match of it or of an ancestor, or a pattern below it."""
    if "*" in validated_pins(patterns):
        return F.lit(True)
    rules = compile_rules(patterns)
    match = verdict_column(path, F.lit(False), rules) | F.exists(proper_ancestors(F.split(path, "/")), lambda p: verdict_column(p, F.lit(True), rules))
    for p in patterns:
        match = match | F.startswith(F.lit(p), F.concat(path, F.lit("/")))
    return match


def simple_ignored(name: Column, is_dir: Column, lines: Iterable[str], marker: str = MARKER) -> Column:
    """The one-shot walker's variant: names only, at most one '*', no paths; it answers differently for patterns with '/'."""
    out = F.lit(False)
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        negated, pat = line.startswith("!"), line.removeprefix("!")
        dir_only, pat = pat.endswith("/"), pat.removesuffix("/")
        head, star, tail = pat.partition("*")
        if not star or "*" in tail and head and not tail.endswith("*"):
            hit = name == pat
        elif not head:
            hit = F.endswith(name, F.lit(tail))
        elif tail and "*" not in tail:
            hit = F.startswith(name, F.lit(head)) & F.endswith(name, F.lit(tail))
        else:
            hit = F.startswith(name, F.lit(pat.removesuffix("*")))
        out = F.when(hit & is_dir if dir_only else hit, F.lit(not negated)).otherwise(out)
    return F.when(F.contains(name, F.lit(marker)), F.lit(False)).otherwise(out)
