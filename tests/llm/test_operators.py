"""Operators against brute force, libraries and defined edge cases, on small fixtures."""

import collections
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers as vocab
import pyarrow.parquet as pq
import pytest
import xxhash

from tidemark.llm import byte_bpe, crf_quality, decontaminate, html_text, katz, line_dedup, near_copies, simhash, token_store, topk, url_filter
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Null id, null and empty texts, repeated rows, ties, odd characters, a long text.
ODD = [(1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (None, "lost id"), (4, "ONE two\tthree\nfour"), (5, "é ́x İ Σ ΟΔΟΣ 日本 it's <|endoftext|> 12,5!"), (6, "word " * 5000), (7, " \n\n \t")]


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns carry names that operators use inside."""
    rows = [(i, t, "h", 1.5, i, 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, host string, score double, rank bigint, n_lines int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))


# 1


def page(body):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def content(html):
    return [t for t, level in html_text.lines_of(html) if level == html_text.CONTENT]


def test_html_structure():
    html = page('<nav><p>menu</p></nav><script>var a="</p>";</script><div class="ad">buy</div><article><h1>A &amp; B</h1><p>One<br>two <b>three</b></p><div class="comments"><p>nice</p></div></article><footer>f</footer>')
    assert content(html) == ["A & B", "One two three"]
    assert html_text.lines_of(None) == html_text.lines_of("") == []
    assert content('<article><h2 id="notice">Notice of change</h2></article>') == ["Notice of change"]
    assert content('<article><div class="post-comment-policy">text</div></article>') == ["text"]
    assert content("<main><article><p>A</p></article><p>B tail</p></main>") == ["A", "B tail"]
    assert content("<nav><li>a<li>b</nav><article>c</article>") == ["c"] == content("<nav><li>a<article>x</article><article>c</article>")


@pytest.mark.parametrize("part", ["<!-- a ", "<textarea>", '<a "x ', '<a ">" ', "<p>a", "<nav><p>", "<", "</", "<b '\"", "<script>"])
def test_broken_pages_take_linear_time(part):
    began = time.perf_counter()
    html_text.lines_of(part * (2_000_000 // len(part)))
    assert time.perf_counter() - began < 6  # about 1 s on a free machine


def test_long_pages_align():
    a = [i % 977 for i in range(6000)]
    b = [x for x in a if x % 5]
    found = html_text.shared(a, b)
    assert len(found) == len(b) and [a[i] for i in found] == b


def test_shared_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        found = html_text.shared(a, b)
        it = iter(b)
        assert len(found) == d[-1, -1] and found == sorted(found) and all(a[i] in it for i in found)


def test_html_differencing(spark):
    body = lambda x: page(f"<div>Site menu</div><p>{x} first line</p><p>{x} second line</p><div>All rights</div>")
    rows = [(1, "http://a.example/x/1", body("red")), (2, "http://a.example/x/2", body("blue")), (3, "http://b.example/", body("lone")), (4, "http://a.example/x/3", None), (5, None, page("<article><p>kept</p></article>")), (5, None, page("<article><p>kept</p></article>"))]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, lines string")
    got = collections.defaultdict(list)
    for r in html_text.main_text(pages).collect():
        got[r.page_id].append((r.text, r.n_chars))
    assert got[1] == [("red first line\n\nred second line", 31)]
    assert got[2][0][0] == "blue first line\n\nblue second line"
    assert got[3][0][0].startswith("Site menu") and got[4] == [("", 0)] and got[5] == [("kept", 4)] * 2
    assert html_text.main_text(pages.limit(0)).count() == 0


def brute_text(rows):
    """Main text of (page_id, url, html), with a plain longest common subsequence of neighbours in sorted order."""
    host = lambda u: re.sub(r"[/?#].*", "", u.split("://", 1)[1]).lower() if u and "://" in u else ""
    path = lambda u: re.sub(r"[?#].*", "", re.sub(r"^[^/?#]*", "", u.split("://", 1)[1])) if u and "://" in u else ""
    rows = sorted(rows, key=lambda r: (host(r[1]), path(r[1])))
    lines, out = [html_text.lines_of(r[2]) for r in rows], {}
    for k, r in enumerate(rows):
        gone, outside = set(), [(i, t) for i, (t, level) in enumerate(lines[k]) if level < 2]
        open_ = {i for i, (_, level) in enumerate(lines[k]) if level == 1}
        for j in (k - 1, k + 1):
            if 0 <= j < len(rows) and host(rows[j][1]) == host(r[1]):
                other = [t for t, level in lines[j] if level < 2]
                d = np.zeros((len(outside) + 1, len(other) + 1), int)
                for x, (_, t) in enumerate(outside):
                    for y, u in enumerate(other):
                        d[x + 1, y + 1] = d[x, y] + 1 if t == u else max(d[x, y + 1], d[x + 1, y])
                x, y, now = len(outside), len(other), set()
                while x and y:
                    if d[x, y] == d[x, y - 1]:
                        y -= 1
                    elif d[x, y] == d[x - 1, y]:
                        x -= 1
                    else:
                        x, y = x - 1, y - 1
                        now.add(outside[x][0])
                if open_ - now or len(outside) < len(lines[k]):
                    gone |= now & open_
        if not open_ - gone and len(outside) == len(lines[k]):
            gone = set()
        out[r[0]] = "\n\n".join(t for i, (t, level) in enumerate(lines[k]) if level and i not in gone)
    return out


def test_main_text_is_brute_force(spark):
    """The given pages as they are, and without their article and div tags: there, differencing decides."""
    given = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    bare = [(10_000 + i, f"http://bare.example/{i % 7}/{i:03}", "<p>Site of all</p><p>menu</p>" * (i % 5 > 0) + re.sub("</?article>|</?nav>", "", h) + "<p>All rights</p>") for i, (_, _, h) in enumerate(given)]
    rows = given + bare
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = brute_text(rows)
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert sum(r.n_shared > 0 for r in got.values()) >= 45


# 2


def distance(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_is_the_distance():
    rng = np.random.default_rng(2)
    for _ in range(80):
        a, b = [list(map(str, rng.integers(0, 4, n))) for n in (rng.integers(1, 12), rng.integers(0, 20))]
        assert decontaminate.myers(decontaminate.masks_of(a), len(a), b)[0] == distance(a, b)


def test_decontamination_finds_what_brute_force_finds(spark, odd, none):
    rng = np.random.default_rng(3)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 200, n)]
    items = [say(n) for n in (6, 14, 20, 33, 50)]
    docs = []
    for k in range(60):
        text = say(40)
        if k % 2:
            part = list(items[k % 5])
            for _ in range(k % 8):
                at = int(rng.integers(0, max(1, len(part))))
                part[at : at + 1] = [[], ["new"], [*part[at : at + 1], "more"]][k % 3]
            text[20:20] = part
        docs.append((k, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame, bench).collect()}
    want = {(d, i): distance(w, t.split()) for d, t in docs for i, w in enumerate(items)}
    assert got == {k: v for k, v in want.items() if v <= int(decontaminate.RATE * len(items[k[1]]))}
    clean = decontaminate.without_contaminated(frame, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(odd, bench).count() == 0 == decontaminate.contaminated(none, bench).count()
    assert decontaminate.without_contaminated(odd, bench.limit(0)).columns == odd.columns


def test_decontamination_reports_the_best_passage(spark):
    """Three words only, so that pieces hit everywhere: least distance, its first end, the shortest passage."""
    rng = np.random.default_rng(15)
    say = lambda n: rng.choice(list("abc"), n).tolist()
    items = [say(n) for n in (5, 9, 14, 24, 24, 30)]
    docs = [(0, "cacaccbbbcbbbcbbcacbbbcacabbbbbcbabcacbcbccbaaacabacaba")] + [(i, "".join([*say(20), *items[i % 6][: 4 + i % 30], *say(15)])) for i in range(1, 120)] + [(200, "abc" * 2000)]
    items.append(list("bbbcbbcacbbbcacabbbbbcbab"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.first_word, r.end_word) for r in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, t in docs:
        for i, w in enumerate(items):
            k = int(decontaminate.RATE * len(w))
            row = [(0, 0)] * (len(t) + 1)  # distance, then length, of the best passage that ends here
            for x in w:
                new = [(row[0][0] + 1, 0)]
                for y in range(1, len(t) + 1):
                    new.append(min((row[y - 1][0] + (x != t[y - 1]), row[y - 1][1] + 1), (row[y][0] + 1, row[y][1]), (new[-1][0] + 1, new[-1][1] + 1)))
                row = new
            best, end = min((row[e][0], e) for e in range(1, len(t) + 1))
            if best <= k:
                want[d, i] = (best, end - row[end][1], end)
    assert got == want and got[0, 6][0] == 0


def test_decontamination_with_items_without_id(spark):
    text = "some twelve words that stand in a test item and its document"
    bench = spark.createDataFrame([(None, text), (3, "other words")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of it")], "doc_id bigint, text string")
    assert [tuple(r)[:3] for r in decontaminate.contaminated(docs, bench).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()] == [2]


# 3


WHITE = " \t\r\x0b\x0c"


def brute_text_left(text, gone):
    """Lines of text but for those at places ``gone`` of its filled lines, and blank lines right after such."""
    out, at, cut = [], -1, False
    for x in text.split("\n"):
        if x.strip(WHITE):
            at += 1
            cut = at in gone
        if not cut:
            out.append(x)
    return "\n".join(out)


def brute_line_dedup(docs, least):
    """Deleted (document, line): later windows of at least ``least`` words, shortest from either end, outside the first."""
    lines = {i: [x.strip(WHITE) for x in t.split("\n") if x.strip(WHITE)] for i, t in docs}
    windows = collections.defaultdict(list)
    for d, ls in lines.items():
        w = [len(x.split()) for x in ls]
        spans = set()
        for s in range(len(ls)):
            e = next((e for e in range(s, len(ls)) if sum(w[s : e + 1]) >= least), None)
            if e is not None:
                spans.add((s, e))
        for e in range(len(ls)):
            s = next((s for s in range(e, -1, -1) if sum(w[s : e + 1]) >= least), None)
            if s is not None:
                spans.add((s, e))
        for s, e in spans:
            windows[tuple(ls[s : e + 1])].append((d, s, e))
    gone = set()
    for found in windows.values():
        found.sort()
        fd, _, fe = found[0]
        gone |= {(d, i) for d, s, e in found[1:] for i in range(max(s, fe + 1) if d == fd else s, e + 1)}
    return lines, gone


def test_line_dedup_is_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"v{x}" for x in rng.integers(0, 1000, int(n))) for n in rng.integers(1, 9, 12)]
    docs = [(i, "\n".join([pool[j] if rng.random() < 0.85 else f"own {i} {rng.integers(0, 99)}" for j in rng.integers(0, 12, int(rng.integers(0, 14)))])) for i in range(30)]
    docs += [(90, "\n".join([pool[0]] * 40)), (91, "a b c d\n\n a b c d \nx"), (92, docs[3][1].replace("\n", "\r\n\t\n"))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    lines, gone = brute_line_dedup(docs, 8)
    for r in line_dedup.dedup_lines(frame, 8).collect():
        lost = {i for d, i in gone if d == r.doc_id}
        assert r.n_lines == len(lines[r.doc_id]) and r.n_deleted == len(lost)
        assert r.text == brute_text_left(dict(docs)[r.doc_id], lost)


@pytest.mark.parametrize("least", [3, 8, 20])
def test_line_dedup_deletes_whole_runs(spark, monkeypatch, least):
    """The definition by maximal runs, on documents that repeat no line of their own."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rng = np.random.default_rng(least)
    pool = [" ".join(f"v{x}" for x in rng.integers(0, 1000, int(n))) for n in rng.integers(1, 9, 14)]
    docs = []
    for i in range(25):
        a, b = sorted(rng.integers(0, 15, 2))
        docs.append((i, "\n\t\n".join([*pool[a:b], f"own {i}", "\t" + pool[int(rng.integers(0, a + 1)) - 1] + "\r"])))
    docs = [(i, t) for i, t in docs if len({x.strip(WHITE) for x in t.split("\n") if x.strip(WHITE)}) == len([x for x in t.split("\n") if x.strip(WHITE)])]
    docs += [(50 + i, t) for i, t in docs[:4]]
    lines = {i: [x.strip(WHITE) for x in t.split("\n") if x.strip(WHITE)] for i, t in docs}
    gone = collections.defaultdict(set)
    for d, _ in docs:
        for e, _ in docs:
            for s in range(len(lines[e])) if e < d else ():
                for t in range(len(lines[d])):
                    n = 0
                    while s + n < len(lines[e]) and t + n < len(lines[d]) and lines[e][s + n] == lines[d][t + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[d][t : t + n]) >= least:
                        gone[d] |= set(range(t, t + n))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), least).collect()}
    assert got == {i: brute_text_left(t, gone[i]) for i, t in docs} and any(gone.values())


def test_line_dedup_of_a_very_long_text(spark):
    docs = [(1, "\n".join(f"line {i} of the text" for i in range(20_000))), (2, "\n".join(f"line {i} of the text" if i % 100 else "" for i in range(20_000)))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1].n_deleted == 0 and got[1].text == docs[0][1] and got[2].n_deleted == got[2].n_lines == 19_800


def test_line_dedup_odd(odd, none):
    out = line_dedup.dedup_lines(odd, 4, counts=("a", "b"))
    assert out.columns == [*odd.columns, "a", "b"] and out.count() == len(ODD)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert got.count((1, ODD[0][1])) == 2 and (2, None) in got and (3, "") in got
    assert line_dedup.dedup_lines(none).count() == 0


# 4


def good_turing(counts, k=5):
    """Discount of each count up to k, from the counts themselves: Katz's formula, or (c - b) / c where that is no discount."""
    of = collections.Counter(counts)
    out = {}
    for c in range(1, k + 1):
        try:
            a = (k + 1) * of[k + 1] / of[1]
            d = ((c + 1) * of[c + 1] / (c * of[c]) - a) / (1 - a)
        except ZeroDivisionError:
            d = 0
        b = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        out[c] = d if 0 < d < 1 else (c - b) / c
    return out


def test_discounts_sum():
    """With Katz's formula for all counts, what is freed is the share of words that occur once."""
    counts = [1] * 1000 + [2] * 400 + [3] * 220 + [4] * 140 + [5] * 100 + [6] * 70 + [50] * 9
    d = katz.discounts(katz.counts_of_counts(np.array(counts)))
    assert np.allclose(d[1:], list(good_turing(counts).values()))
    assert math.isclose(sum(c * (1 - d[c]) for c in counts if c <= katz.K), 1000, rel_tol=1e-9)


def test_katz(spark, odd, none):
    docs = documents()
    frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in katz.score(frame).collect()}
    token = lambda t: [*words(t), b""]
    uni, ctx = collections.Counter(), collections.defaultdict(collections.Counter)
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2:
            x = token(d["text"])
            uni.update(x)
            for u, w in zip([b"", *x], x):
                ctx[u][w] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d = good_turing(uni.values()), good_turing([c for x in ctx.values() for c in x.values()])
    p1 = {w: c * d1.get(c, 1) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    assert 0 < unknown < 1

    def model(u):
        seen, all_ = ctx[u], sum(ctx[u].values())
        p = {w: c * d.get(c, 1) for w, c in seen.items()}
        freed, whole = (all_ - sum(p.values()), all_) if all_ - sum(p.values()) > 1e-12 else (1, all_ + 1)
        alpha = freed / whole / (1 - sum(p1[w] for w in seen))
        return lambda w: p[w] / whole if w in p else alpha * p1.get(w, unknown)

    of = {u: model(u) for u in list(ctx)}
    for u in list(ctx)[:3]:
        assert math.isclose(sum(of[u](w) for w in uni) + of[u](b"never seen"), 1, rel_tol=1e-9)
    for x in docs[:60]:
        t, r = token(x["text"]), rows[x["doc_id"]]
        want = sum(math.log10(of[u](w) if u in of else p1.get(w, unknown)) for u, w in zip([b"", *t], t))
        assert math.isclose(r.score, want, rel_tol=1e-9) and (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in uni for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    odd_rows = katz.score(odd).collect()
    assert len(odd_rows) == len(ODD) and {r.n_tokens for r in odd_rows if r.doc_id in (2, 3, 7)} == {1} and all(math.isfinite(r.score) for r in odd_rows)
    assert katz.score(none).count() == 0


# 5


def test_token_store(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = vocab.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    assert token_store._encoder(path, 1).apart
    extra = documents()
    frame = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + d["doc_id"], d["text"]) for d in extra] + [(None, None)], "doc_id bigint, text string"))
    store = token_store.write(frame, f"file://{tmp_path}/store", path)
    rows = token_store.read(store.placed, store).collect()
    texts = sorted([(i, t or "") for i, t in ODD] + [(1000 + d["doc_id"], d["text"] or "") for d in extra] + [(None, "")], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.occurrence)), texts, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    unknown = spark.createDataFrame([(10**9 + i, 0) for i in range(50)], "doc_id bigint, occurrence bigint")
    assert token_store.read(unknown, store).count() == 0
    empty = token_store.write(none, f"file://{tmp_path}/store2", path)
    assert empty.placed.count() == 0 == token_store.read(empty.placed, empty).count()


def test_other_tokenizers_get_whole_texts(tmp_path):
    """With another normaliser, words can't be encoded apart."""
    import json

    from tokenizers import Tokenizer

    made = json.load(open(vocab.path("word_bpe_49k.json")))
    made["normalizer"] = {"type": "Replace", "pattern": {"String": " "}, "content": "_"}
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(made, f)
    texts = ["two words", "", "One, two  three"]
    got, width = token_store.encode_texts(texts, path, 1)
    tok = Tokenizer.from_file(path)
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 1000, 5001):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        at = token_store.slots_of(keys, token_store.build_mph(keys), len(keys))
        assert sorted(at.tolist()) == list(range(len(keys)))


# 6


def brute_marginals(u, pair):
    n = len(u)
    z, good = 0.0, np.zeros(n)
    for s in np.ndindex(*[2] * n):
        p = math.exp(sum(u[i] for i in range(n) if s[i]) + sum(pair[a, b] for a, b in zip(s, s[1:])))
        z += p
        good += p * np.array(s)
    return good / z


def test_forward_backward():
    rng = np.random.default_rng(6)
    u, pair = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    there = crf_quality.present([5, 3, 1])
    good, joint = crf_quality.forward_backward(u * there, pair, there, pairs=True)
    for i, n in enumerate((5, 3, 1)):
        assert np.allclose(good[i, :n], brute_marginals(u[i, :n], pair))
    assert math.isclose(joint.sum(), 4 + 2)
    long, _ = crf_quality.forward_backward(np.full((1, 50_000), -3.0), pair, np.ones((1, 50_000), bool))
    assert np.isfinite(long).all()


def test_scores_are_brute_force():
    """Scores of texts of mixed lengths, of the whole texts, against marginals summed over all labellings."""
    rng = np.random.default_rng(16)
    texts = ["\n".join(rng.choice(["Plain line of words.", "### $$$ |||", "12 34 56", "another line, with words", "!!!! AAA BBB"], int(n))) for n in rng.integers(1, 9, 40)] + ["", None]
    docs = [crf_quality.line_features(t) for t in texts]
    labels = np.array([float("#" not in (t or "#")) for t in texts])
    m = crf_quality.fit(docs, labels)
    for t, got in zip(texts, m.scores(docs)):
        x, w = crf_quality.line_features(t)
        p = brute_marginals(m.unary(crf_quality.with_neighbours(x)), m.pair)
        want = 1 / (1 + math.exp(-(m.a * ((p * w).sum() / w.sum() - 0.5) + m.b)))
        assert math.isclose(got, want, rel_tol=1e-6)


def test_fit_reads_whole_texts(spark):
    """A document is bad for its last lines only, far beyond the first hundred."""
    good = "\n".join(["Plain line of words, as they come."] * 300)
    docs = [(i, good if i % 2 else good + "\n" + "\n".join(["$$ ## || %%"] * 200)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = crf_quality.train(frame, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id bigint, quality int"))
    assert all((r.q >= 0.7) == bool(r.doc_id % 2) for r in crf_quality.score(frame, model, "q").collect())


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in QUERIES["op6_crf_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, None), (None, 1)], "doc_id bigint, quality int")
    model = crf_quality.train(odd, labels)
    out = crf_quality.score(odd, model, "q").collect()
    assert len(out) == len(ODD) and {r.q for r in out} == {0.5}
    assert crf_quality.score(none, model, "q").count() == 0
    for t in (None, "", " \n", "a\n\nb", "x" * 10_000):
        f, w = crf_quality.line_features(t)
        assert len(f) == len(w) >= 1 and np.isfinite(f).all()


# 7


def test_byte_bpe_is_the_library(odd, none):
    import tiktoken

    path = vocab.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoder(path, vocab.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = np.random.default_rng(7)
    texts = [d["text"] for d in documents()[:80]] + [t or "" for _, t in ODD] + ["a" * 3000, "ab" * 999 + "=-" * 500, "".join(map(chr, range(1, 2000)))] + ["".join(rng.choice(list("aeinst -'"), 60)) for _ in range(300)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == lib.encode_ordinary(t) and enc.decode(ids) == t.encode()
    rows = byte_bpe.encode(odd, path, vocab.PATTERN).collect()
    assert len(rows) == len(ODD) and all(len(r.ids) == r.n_tokens for r in rows)
    assert byte_bpe.encode(none, path, vocab.PATTERN).count() == 0


# 8


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("Example.NET", "/en/", "allow"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    urls = [(1, "http://A.Example.NET/en/x"), (2, "https://notexample.net/en/x"), (3, "http://net/"), (4, None), (5, "no scheme"), (6, "http://x.org/fr/?q"), (7, "http://www.Bad.example/p/index.html?x#y"), (7, "http://www.Bad.example/p/index.html?x#y"), (8, "http://example.net"), (9, "")]
    listed = spark.createDataFrame([("https://bad.example/p/",), (None,)], "url string")
    pages = spark.createDataFrame([(*u, "z", "z") for u in urls], "page_id bigint, url string, rule string, key string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules, listed).orderBy("page_id").collect()]
    bad = (7, "www.bad.example", "/p/index.html", None, "block")
    assert got == [(1, "a.example.net", "/en/x", "Example.NET/en/", "allow"), (2, "notexample.net", "/en/x", "net/", "block"), (3, "net", "/", "net/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "x.org", "/fr/", "org/fr/", "allow"), bad, bad, (8, "example.net", "", None, "allow"), (9, "", "", None, "allow")]
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_bloom_filter(spark):
    """All keys pass, few others do, and the exact join removes those; rules of many path lengths make no large plan."""
    F = url_filter.F
    keys, others = (spark.range(20_000).select(F.concat(F.lit(k), F.col("id").cast("string")).alias("key")) for k in ("in", "out"))
    filt, blocks = url_filter.bloom(keys, 20_000)
    probe = lambda df: df.withColumns({"block": url_filter._block(F.col("key"), blocks), "want": url_filter._mask(F.col("key"))}).join(filt, "block").where("bits & want = want").count()
    assert filt.count() <= blocks and probe(keys) == 20_000 and 0 < probe(others) < 400
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit("/"), "id").alias("url"))
    rules = spark.range(1, 800).select(F.lit("example").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit("/")).alias("path"), F.lit("block").alias("verdict"))
    listed = spark.range(1000, 2000).select(F.concat(F.lit("https://WWW.H.Example/"), F.repeat(F.lit("x"), F.col("id").cast("int")), F.lit("/"), "id", F.lit("/index.html#top")).alias("url"))
    got = collections.Counter((r.rule is not None, r.verdict) for r in url_filter.url_filter(pages, rules, listed).collect())
    assert got == {(True, "block"): 799, (False, "block"): 1000, (False, "allow"): 1201}


# 9


def test_top_k(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 12)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, []), (302, [float("nan")] * 12), (303, [None] + [0.0] * 11), (304, v[0].tolist()), (304, v[0].tolist()), (400, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    use = frame.where(topk.usable(frame.embedding)).select("vec_id", topk.integers(frame.embedding).alias("v"))
    got = collections.defaultdict(list)
    for r in topk.top_k(use, use.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = [(i, np.floor(1024 * np.array(x, np.float32).astype(float)).astype(np.int64)) for i, x in rows if x and None not in x and np.isfinite(x).all()]
    for q in (0, 100, 200):
        best = sorted((-int(x @ ints[q][1]), i) for i, x in ints if i != q and len(x) == 12)[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 100, 200} and topk.top_k(use.limit(0), use.limit(0)).count() == 0


def test_top_k_in_blocks_and_of_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 12)
    v = np.random.default_rng(17).integers(-9, 9, (60, 4))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, frame.where("vec_id % 5 = 0"), 3).collect())
    best = {q: sorted((-int(v[i] @ v[q]), i) for i in range(60) if i != q)[:3] for q in range(0, 60, 5)}
    assert got == [(q, k + 1, i, -s) for q in best for k, (s, i) in enumerate(best[q])]
    large = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [3e12, 0.0])], "vec_id bigint, v array<double>")
    ints = large.select("vec_id", topk.integers(large.v).alias("v"))
    got = [(r.vec_id, r.score) for r in topk.top_k(ints, ints.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


# 10


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [64, 1])
def test_simhash_links(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    rng = np.random.default_rng(10)
    fp = [int(x) for x in rng.integers(0, 2**63, 20)]
    for _ in range(150):
        x = fp[int(rng.integers(0, len(fp)))]
        for b in rng.integers(0, 64, int(rng.integers(0, 4))):
            x ^= 1 << int(b)
        fp.append(x)
    fp += fp[:5] + [0, 0]
    ids = list(range(len(fp)))
    frame = spark.createDataFrame([(i, x - (1 << 64) * (x >> 63)) for i, x in zip(ids, fp)], "doc_id bigint, fp bigint")
    want = brute_components(ids, [(a, b) for a in ids for b in ids[:a] if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == want


def test_fingerprints(odd, none):
    for text in [d["text"] for d in documents()[:60]] + [t for _, t in ODD] + ["a b c d", "w " * 300_000]:
        w = words(text)
        shingled = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        counted = collections.Counter(shingled)
        bits = [sum(n for s, n in counted.items() if xxhash.xxh64_intdigest(s, 42) >> b & 1) for b in range(64)]
        assert simhash.fingerprint(simhash.shingle_hashes(text, 3, 42)) == sum(1 << b for b in range(64) if 2 * bits[b] > len(shingled))
    rows = simhash.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and {r.fp for r in rows if r.doc_id in (2, 3, 7)} == {0}
    assert simhash.near_duplicates(simhash.fingerprints(odd)).count() == len(ODD)
    assert simhash.near_duplicates(simhash.fingerprints(none)).count() == 0


def shingles(text, size=5):
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near_pairs(docs, least=0.8):
    s = {i: shingles(t) for i, t in docs}
    return [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= least * len(s[a] | s[b])]


def test_near_copies(spark, odd, none):
    rng = np.random.default_rng(11)
    docs = []
    for g in range(8):
        text = [f"t{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(6):
            edited = list(text)
            for at in rng.integers(0, 300, 3):
                edited[at] = f"e{rng.integers(0, 10**6)}"
            docs.append((len(docs), " ".join(edited)))
    docs += [(100 + i, " ".join(f"t{x}" for x in rng.integers(0, 5000, 60))) for i in range(20)]
    docs += [(200, docs[0][1]), (200, docs[0][1]), (201, None), (202, "")]
    out = [r.doc_id for r in near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    roots = brute_components([i for i, _ in docs], near_pairs(dict(docs).items()))
    assert sorted(out) == sorted(set(roots.values()))
    clash = odd.withColumn("kid", odd.doc_id).withColumn("ld_d", odd.doc_id)
    assert near_copies.without_near_copies(clash).columns == clash.columns == line_dedup.dedup_lines(clash, counts=("a", "b")).columns[:-2]
    assert near_copies.without_near_copies(odd).columns == odd.columns and near_copies.without_near_copies(none).count() == 0


def test_near_copies_of_few_shingles(spark):
    """Four of five shingles are 0.8: such texts link whatever their bits."""
    rng = np.random.default_rng(12)
    docs = []
    for g in range(100):
        text = [f"g{g}w{x}" for x in rng.integers(0, 10**6, 9)]
        for part in (text, text[:-1]):
            docs.append((len(docs), " ".join(part)))
    out = [r.doc_id for r in near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    assert sorted(out) == sorted(set(brute_components([i for i, _ in docs], near_pairs(docs)).values()))


def test_short_texts_of_equal_simhash_stay(spark):
    """One of two shingles is 0.5: no copies, though half of these texts have equal SimHashes."""
    rng = np.random.default_rng(14)
    docs = []
    for g in range(100):
        text = [f"g{g}w{x}" for x in rng.integers(0, 10**6, 6)]
        for part in (text, text[:-1]):
            docs.append((len(docs), " ".join(part)))
    out = [r.doc_id for r in near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    assert sorted(out) == sorted(set(brute_components([i for i, _ in docs], near_pairs(docs)).values()))


def test_near_copies_around_a_hub(spark):
    """Copies that are near the original but not one another, far more than a list's limit, among them chains of two."""
    rng = np.random.default_rng(13)
    text = [f"t{x}" for x in rng.integers(0, 10**6, 404)]

    def edited(of):
        out = list(of)
        for at in rng.choice(len(of) - 20, 8, replace=False) + 10:
            out[at] = f"e{rng.integers(0, 10**9)}"
        return out

    near = [edited(text) for _ in range(160)]
    docs = [(i, " ".join(t)) for i, t in enumerate([*near, text, *(edited(t) for t in near[:40])])]
    pairs = near_pairs(docs)
    want = brute_components([i for i, _ in docs], pairs)
    assert len(pairs) < 2000 and len(set(want.values())) < 80
    out = [r.doc_id for r in near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    assert sorted(out) == sorted(set(want.values()))
