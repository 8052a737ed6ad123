"""Main text of HTML pages by differencing with the pages of nearest URL.

A page becomes text lines, one for each block element, of three levels: furniture stands in elements that by their kind
(nav, footer, form, ...), or by a class, id or role that says nothing else, never hold main text; content stands in an
article or main element; everything else is open. Each page is paired with the pages of the same host whose paths sort
next to it. The lines of both that aren't content, furniture too, are aligned by longest common subsequence; what they
share is what the site repeats, and open lines among it are deleted. So the text is the content and the open lines that
neighbours don't have. Content stays where a neighbour has it as well: copies and series share articles, too. A
neighbour that leaves a page without content no line at all is the same page and decides nothing.

Neighbours are found by a range sort of (host, path) and a join on the position in it, so a host with any share of
all pages is dealt like the rest. Null html gives empty text; pages with equal URLs are neighbours like others;
repeated rows give repeated results. Reading a page takes one forward scan: what closes nowhere is looked for once, so
broken pages of any length take time in proportion. Aligning takes memory in proportion to lines times a root of lines.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .url_filter import host_of, path_of

#: Elements that never hold main text.
FURNITURE = frozenset("head nav footer aside form script style noscript template svg iframe select button dialog menu object canvas map audio video".split())
#: Words of a class, id or role that mark furniture if all of its words are among these and the next.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies disqus respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar search pagination pager complementary contentinfo dialog".split())
#: Words beside them that say nothing of their own.
NEUTRAL = frozenset("area bar block bottom box container global inner left link links list page right section site top unit wrap wrapper".split())
#: Elements that begin and end a line.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no markup.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "svg", "textarea")}
FURNISHED, OPEN, CONTENT = 0, 1, 2

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
#: Elements that give way where content begins inside, as pages may be one form.
WRAPPERS = frozenset("form header dialog".split())
#: What a menu doesn't hold: where one of these begins, a menu that is closed nowhere has ended.
BODIES = frozenset("div h1 h2 h3 h4 h5 h6 p section table".split())


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of what isn't text, in order; name is empty where it is no tag."""
    at, gone = 0, set()  # gone: closings that the rest of the page doesn't have

    def find(what: str, start: int) -> int:
        end = -1 if what in gone else page.find(what, start)
        if end < 0:
            gone.add(what)
        return end

    while (start := find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        m = NAME.match(page, start)
        if page.startswith("<!--", start) and (end := find("-->", start + 4)) >= 0:
            at = end + 3
            yield start, at, False, "", ""
        elif m is None:
            end = find(">", start + 1) if after and after in "!?/" else -1
            at = end + 1 if end >= 0 else start + 1
            if end >= 0:
                yield start, at, False, "", ""
        else:
            end = m.end()
            while "tag" not in gone and end >= 0:
                stop = STOP.search(page, end)
                if stop is None:
                    gone.add("tag")  # no tag ends from here on, if quotes are what they seem
                elif stop[0] == ">":
                    break
                else:
                    close = find(stop[0], stop.end())
                    end = close + 1 if close >= 0 else stop.end()
            else:
                stop = None
            end = stop.start() if stop else find(">", m.end())
            if end < 0:
                at = start + 1
                continue
            name, attrs, at = m[2].lower(), page[m.end() : end], end + 1
            if not m[1] and name in RAW and name not in gone:
                closed = RAW[name].search(page, at)
                if closed:
                    at = closed.end()
                    yield start, at, False, "", ""
                    continue
                gone.add(name)
            yield start, at, bool(m[1]), name, attrs


def attributes(text: str) -> dict[str, str]:
    """Names, lower-cased, and values of a tag's attributes; the first of several of one name counts."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def is_furniture(name: str, attrs: str, level: int) -> bool:
    if name in FURNITURE or name == "header" and level == OPEN:
        return True
    if not attrs.strip() or name in ("html", "body", "main") or name in HEADINGS or name == "article" and level == OPEN:
        return False
    own = attributes(attrs)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or UNSHOWN.search(own.get("style", "")):
        return True
    for key in ("class", "id", "role"):
        for mark in own.get(key, "").lower().split():
            words = {w for w in re.split(r"[^a-z0-9]+", mark) if w}
            # an article's own section may be about a search
            marks = words & MARKS if level == OPEN or key == "role" else words & MARKS - {"search"}
            if marks and words <= MARKS | NEUTRAL or level == OPEN and words <= {"header", "masthead", *NEUTRAL} and words - NEUTRAL:
                return True
    return False


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The lines of a page with the level of where they stand."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    at, inside, skip, depth = 0, {"article": 0, "main": 0}, "", 0
    page = page or ""
    closings: dict[str, int] = {}

    def is_closed(name: str, start: int) -> bool:
        """Whether the element is closed anywhere from here on."""
        if name not in closings:
            closings[name] = max((m.start() for m in re.finditer(rf"</{name}\b", page, re.I)), default=-1)
        return closings[name] >= start

    def level() -> int:
        return FURNISHED if skip else CONTENT if any(inside.values()) else OPEN

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(buffer)).split()):
            out.append((text, level()))
        buffer.clear()

    for start, end, close, name, attrs in tags(page):
        if start > at:
            buffer.append(page[at:start])
        at = end
        if name == "br":
            buffer.append(" ")
        elif not close and not skip and name and name not in VOID and is_furniture(name, attrs, level()):
            flush()
            if not attrs.endswith("/"):
                skip, depth, endless = name, 1, name == "nav" and not is_closed(name, end)
        elif skip and not close and (skip in WRAPPERS and name in inside and not any(inside.values()) and not is_furniture(name, attrs, CONTENT) or endless and name in BODIES):
            flush()
            skip, depth = "", 0
            if name in inside:
                inside[name] += 1
            elif is_furniture(name, attrs, OPEN) and not attrs.endswith("/"):
                skip, depth, endless = name, 1, False
        elif skip and (name == skip or close and name in ("article", "main", "body", "html")):
            depth += -1 if close else 0 if attrs.endswith("/") else 1
            if name != skip or not depth:
                flush()
                ended, skip, depth = skip, "", 0
                if name != ended and name in inside:
                    inside[name] = max(0, inside[name] - 1)
        elif name in BLOCKS:
            flush()
            if not skip and name in inside:
                inside[name] = max(0, inside[name] - 1) if close else inside[name] + 1
    buffer.append(page[at:])
    flush()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of both, by bit-parallel rows and a walk back.

    Only elements that both have are rows; every so many rows one is kept, and those between are made again for the walk.
    """
    both = set(a) & set(b)
    places, b = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    a = [a[i] for i in places]
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full, every = (1 << len(b)) - 1, math.isqrt(len(a)) + 1

    def step(v: int, x: int) -> int:
        u = v & masks[x]
        return ((v + u) | (v - u)) & full

    marks, v = [full], full
    for i, x in enumerate(a, 1):
        v = step(v, x)
        if i % every == 0:
            marks.append(v)
    out, j = [], len(b)
    for block in range(len(a) // every, -1, -1):
        rows = [marks[block]]
        for x in a[block * every : (block + 1) * every]:
            rows.append(step(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                out.append(places[block * every + i - 1])
                i, j = i - 1, j - 1
    return out[::-1]


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html): page_id, url, text, n_chars, n_shared (open lines that differencing deleted)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [lines_of(page.as_py()) for page in part.column(3)]
                cols = [pa.array([[x[k] for x in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int8()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], names=["uid", "page_id", "url", "lines", "levels"])

    source = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    parsed = keep(source.mapInArrow(parse, "uid bigint, page_id bigint, url string, lines array<string>, levels array<tinyint>"), "parsed")
    has_open = F.array_contains("levels", F.lit(OPEN).cast("tinyint"))
    # without open lines there is nothing to decide: such pages are neighbours only, and their text isn't shuffled
    closed = parsed.where(~has_open).select("page_id", "url", F.filter("lines", lambda x, i: F.get("levels", i) == CONTENT).alias("lines"), F.lit(0).alias("n_shared"))
    opened = parsed.where(has_open)

    # the position of every page in the order of host and path
    hashes = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.get("levels", i).alias("level"))), lambda x: x["level"] < CONTENT)
    order = parsed.select("uid", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), has_open.alias("is_open"), hashes.alias("outside"), F.size("lines").alias("n"))
    keys = ["host", "path", "uid"]
    sorted_ = keep(order.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("m", F.monotonically_increasing_id()), "sorted")
    part = F.shiftrightunsigned("m", 33)
    before, starts = 0, []
    for p, n in sorted_.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        starts.append((p, before))
        before += n
    starts_df = F.broadcast(sorted_.sparkSession.createDataFrame(starts, "p bigint, before bigint"))
    ranked = sorted_.withColumn("p", part).join(starts_df, "p").withColumn("r", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    other = lambda shift, name: ranked.select((F.col("r") + shift).alias("r"), F.struct("host", F.col("outside.h").alias("hashes")).alias(name))
    own = ranked.where("is_open").select("uid", "host", "outside", "n", "r")
    pairs = own.join(other(1, "previous"), "r", "left").join(other(-1, "following"), "r", "left").select("uid", "host", "outside", "n", "previous", "following")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, gone = [], []
            for r in batch.to_pylist():
                own = [x["h"] for x in r["outside"]]
                is_open = {k for k, x in enumerate(r["outside"]) if x["level"] == OPEN}
                found: set[int] = set()
                for x in (r["previous"], r["following"]):
                    if x and x["host"] == r["host"]:
                        now = is_open.intersection(shared(own, x["hashes"]))
                        if len(now) < len(is_open) or len(own) < r["n"]:
                            found |= now
                if len(found) == len(is_open) and len(own) == r["n"]:
                    found = set()  # neighbours that only together have all of a page
                uids.append(r["uid"])
                gone.append(sorted(r["outside"][k]["i"] for k in found))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["uid", "gone"])

    gone = pairs.mapInArrow(align, "uid bigint, gone array<int>")
    stays = lambda x, i: (F.get("levels", i) > FURNISHED) & ~F.array_contains("gone", i)
    differenced = opened.join(gone, "uid").select("page_id", "url", F.filter("lines", stays).alias("lines"), F.size("gone").alias("n_shared"))
    text = F.array_join("lines", "\n\n")
    return closed.union(differenced).select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), "n_shared")
