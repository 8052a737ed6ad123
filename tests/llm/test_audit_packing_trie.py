"""Filter audit, packing, prefix trie; crowded lists of near copies; queries and candidates without ids."""

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, near_copies, packing, prefix_trie, topk
from tidemark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TOKENIZER = "word_bpe_49k.json"


def documents(spark, rows):
    """Extra columns carry names that operators use inside."""
    full = [(i, t, lang, 1, 2, "x", 3) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, k0 long, n int, part string, length int")


ODD = [
    (1, "Ab " * 150 + "cd " * 60, "en"), (1, "Ab " * 150 + "cd " * 60, "en"), (2, "Ab " * 150 + "cd " * 60, "fr"), (3, None, None), (4, "", ""), (None, "", "en"),
    (None, "five $ signs", "en"), (5, "five $ signs", "en"), (5, "other text of the id", "en"), (6, " \t\n\x0b\x0c\r ", "en"), (7, "É è  x ü 日本 " * 60, "de"), (8, "w " * 60_000, "de"),
    (9, " ".join(f"w{i}" for i in range(30_000)), "de"), (10, "ABC def " * 120, "en"), (11, "a\nb\tc " * 100, "en"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (3, None, 1), (5, 1, 0), (None, 1, 1), (8, 1, None), (99, 1, 1)]


# 11


def brute_audit(rows, labels):
    least, good, toxic = {}, collections.defaultdict(set), None
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    found = []
    for i, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        found.append((lang or "", i, {x for x in "ABCDE" if fails[x]}))
    out = {}
    for part in {p for p, _, _ in found}:
        own = [(i, f) for p, i, f in found if p == part]
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for s, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                redundant = sum(x in f for _, f in own) - len(gone)
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                out[part, order, s + 1] = [len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for k, v in out.items():
            if k[0] == part:
                v[6] = total[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_of_odd_documents(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id bigint, quality int, toxic int, lang string")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute_audit(ODD, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_splits_no_copies_twice(spark):
    """A large group of copies is one text: the words of it are exploded once."""
    rows = [(i, "same words again", "en") for i in range(3000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    told = filter_audit.failures(docs, labels).collect()
    assert sorted((r.e, r.n) for r in told) == [(False, 1), (True, 2999)]


# 12


def placed_well(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_odd_documents(spark):
    from tokenizers import Tokenizer

    rows = [*ODD, (12, "very long words here " * 9_000, "en")]
    tok = Tokenizer.from_file(vocab.path(TOKENIZER))
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in rows]
    want = sorted((str(i), k, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for (i, _, _), x in zip(rows, ids) for k, at in enumerate(range(0, len(x), 4096)))
    got = packing.packed(documents(spark, rows), vocab.path(TOKENIZER), with_ids=True)
    out = got.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r["length"], r.ids_crc32) for r in out) == want
    assert placed_well(out, 4096) == -(-sum(x[3] for x in want) // 4096)
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert all(whole[r.sequence_id][r.offset : r.offset + r["length"]] == r.ids for r in out)
    assert packing.packed(documents(spark, rows).limit(0), vocab.path(TOKENIZER)).count() == 0


@pytest.mark.parametrize("name, most", [("small", 1.0), ("thirds", 1.01)])
def test_packing_over_several_regions(spark, name, most):
    """Leftovers of regions meet: small pieces waste one bin at most; of pieces of about a third, no more bins than best fit needs."""
    rng = np.random.default_rng(5)
    sizes = np.clip(rng.lognormal(5.5, 1.0, 9_000).astype(int), 1, 4096) if name == "small" else rng.integers(1000, 1700, 5_000)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "row bigint, length bigint")
    out = packing.pack(items).join(items, "row").collect()
    assert sorted(r["row"] for r in out) == list(range(len(sizes)))
    n = placed_well([r.asDict() for r in out], 4096)
    space = packing.Region(np.asarray(sizes), 4096, 1)
    best = space.fresh(0.0).max() + 1
    assert n <= (space.least + 1 if name == "small" else most * best)


def test_the_last_round_places_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUNDS", 1)
    monkeypatch.setattr(packing, "REGION", 50)
    items = spark.createDataFrame([(i, 1 + i * 37 % 3000) for i in range(400)], "row bigint, length bigint")
    out = packing.pack(items).join(items, "row").collect()
    assert len(out) == 400
    placed_well([r.asDict() for r in out], 4096)


def test_breeding_keeps_what_is_good():
    space = packing.Region(np.random.default_rng(2).integers(1000, 1700, 600), 4096, 7)
    start = [space.fresh(0.02 * k) for k in range(4)]
    end = space.evolve(list(start), 40)
    assert space.fitness(end[0]) > max(map(space.fitness, start))
    for p in end:
        assert np.bincount(p, space.lengths).max() <= 4096 and len(p) == 600 and set(p) == set(range(p.max() + 1))
    again = packing.Region(space.lengths, 4096, 7)
    assert all((a == b).all() for a, b in zip([again.fresh(0.02 * k) for k in range(4)], start))


# 13


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, t in sorted(full.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = collections.defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in kids[k]) or 1
        saved = sum(sums[x][1] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        sums[k] = leaves, saved
        ends = ",".join(str(c) for c in members[k] if len(full[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, 5, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, path string")
    return sorted(tuple(r) for r in prefix_trie.trie(frame).select(*COLUMNS).collect())


def test_trie_of_odd_conversations(spark):
    rng = np.random.default_rng(3)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "null first"), (7, 1, "user", "x"), (7, 1, "user", "x"), (-205, 0, "a", "neg"), (-200, 0, "a", "base"), (150, 3, "é", "日本" * 3000)]
    for c in range(60):
        for t in range(rng.integers(1, 9)):
            rows.append((c * 7, t, "user" if t % 2 == 0 else "bot", f"t{rng.integers(0, 2)}"))
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == []


def test_trie_of_long_and_common_conversations(spark, monkeypatch):
    """Paths over many arrays, links over many chains, ends in many strings, and parents of many children."""
    for name, value in (("CHUNK", 8), ("IDS", 16), ("MANY_CHILDREN", 10)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = [(100_000 + i, t, "u", "same") for i in range(150) for t in range(7)]
    rows += [(200_001 + i, t, "u", f"s{t}" if t < 6 else f"s{t} {i}") for i in range(120) for t in range(8)]
    rows += [(300_000, t, "u", f"long {t}") for t in range(150)]
    # each of these leaves the path of the one before a little later, so paths are chains of links
    rows += [(400_100 * 1000 + 100 * i, t, "u", f"c {t}") for i in range(40) for t in range(3 * (40 - i))] + [(400_900 * 1000 + 100 * i, t, "u", f"c {t}" if t < 3 * i + 1 else f"c {t} {i}") for i in range(40) for t in range(3 * i + 4)]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_ends_of_links(spark):
    links = [(i, i + 1) for i in range(37)] + [(100, 200), (50, 60), (60, 70)]
    got = {r.conv_id: r.path for r in prefix_trie.ends_of_links(spark.createDataFrame(links, "conv_id bigint, to bigint")).collect()}
    assert got == {**{i: 37 for i in range(37)}, 100: 200, 50: 70, 60: 70}


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLE[name]).df()[got.columns]
    assert sorted(map(tuple, got.toPandas().astype(str).to_numpy())) == sorted(map(tuple, want.astype(got.toPandas().dtypes.to_dict()).astype(str).to_numpy()))


# near copies and top-k


def shingles(t):
    ws = t.split()
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def test_near_copies_of_templated_texts(spark):
    """One template with few own words each: lists of all documents, in which some pairs link and most don't."""
    rng = np.random.default_rng(17)
    template = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join([*template, *(f"o{x}" for x in rng.integers(0, 10**9, [2, 6, 5, 4][i % 4]))])) for i in range(240)]
    docs += [(1000 + i, docs[i][1] + " more") for i in range(0, 40, 3)]
    s = {i: shingles(t) for i, t in docs}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(s, 2):
        if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = sorted({find(i) for i in s})
    got = near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want and 100 < len(want) < 220


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    test_near_copies_of_templated_texts(spark)


def test_rows_that_share_one_hash_stay(spark, monkeypatch):
    """Rows are told apart by two hashes: one alone may be the same for all."""
    own = near_copies.key_of
    monkeypatch.setattr(near_copies, "key_of", lambda: [F.lit(1).cast("bigint"), own()[1]])
    docs = [(i, f"text number {i} with words w{i} x{i} y{i} z{i}") for i in range(30)]
    assert near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).count() == 30


def test_top_k_without_ids(spark, monkeypatch):
    """Rows of null id are neither candidates nor queries, in any block."""
    rows = [(i, [i, 1]) for i in range(40)] + [(None, [100, 100]), (None, None), (41, None), (42, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    want = [(q, r + 1, i) for q in range(0, 40, 10) for r, i in enumerate(sorted((i for i in range(40) if i != q), key=lambda i: (-q * i - 1, i))[:3])]
    for numbers in (4_000_000, 4):
        monkeypatch.setattr(topk, "BLOCK_NUMBERS", numbers)
        got = topk.top_k(frame, frame.where("vec_id % 10 = 0 or vec_id is null"), 3)
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == want
    monkeypatch.setattr(topk, "AT_ONCE", 2)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(frame, frame.where("vec_id % 10 = 0"), 3).collect()) == want


# pages: wrappers, attributes and menus without an end

from tidemark.llm import html_text  # noqa: E402


def texts(body):
    return [t for t, level in html_text.lines_of(f"<html><body>{body}</body></html>") if level != html_text.FURNISHED]


@pytest.mark.parametrize(
    "body, lines",
    [
        ("<form><input><article><p>Body</p></article><p>after</p></form>", ["Body", "after"]),
        ("<form><p>search</p></form><main><p>Body</p></main>", ["Body"]),
        ("<form><article class='comments'><p>nice</p></article></form><p>Body</p>", ["Body"]),
        ("<article><p data-x='is hidden here'>One</p><p title=\"the hidden cost\">two</p><p hidden>three</p><p hidden=''>four</p><p data-hidden>five</p></article>", ["One", "two", "five"]),
        ("<article><p aria-hidden=true>a</p><p aria-hidden='false'>b</p><p style='display : none'>c</p><p title='display:none'>d</p></article>", ["b", "d"]),
        ("<article><section class='search'><p>About search</p></section><div role=search>box</div><div class='comments'><p>x</p></div></article>", ["About search"]),
        ("<section class='search'><p>box</p></section><p>Body</p>", ["Body"]),
        ("<nav><a>Home</a><a>More</a><div><p>Body</p></div><p>end</p>", ["Body", "end"]),
        ("<nav><div><p>menu</p></div></nav><p>Body</p>", ["Body"]),
        ("<nav><ul><li>menu</ul><div class='sidebar'><p>side</p></div><p>Body</p>", ["Body"]),
        ("<footer><p>imprint</p><div>address", []),
        ("<aside><article><p>teaser</p></article></aside><p>Body</p>", ["Body"]),
    ],
)
def test_wrappers_attributes_and_open_menus(body, lines):
    assert texts(body) == lines


def test_pages_of_many_open_tags_take_linear_time():
    import time

    def seconds(n):
        page = "<nav>" * n + "<div hidden class=" + "x " * n + "<p>" * n
        began = time.perf_counter()
        html_text.lines_of(page)
        return time.perf_counter() - began

    seconds(1_000)
    assert seconds(40_000) < 12 * seconds(10_000) + 0.5
