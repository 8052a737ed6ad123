"""The pipeline's stages against brute force on the small table."""

import collections

import pyarrow.parquet as pq
from test_operators import brute_components, brute_line_dedup, brute_text_left, distance, near_pairs

import corpus_pipeline
from tidemark.llm import decontaminate
from tidemark.session import keep

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        columns = docs.columns
        docs = keep(stage(spark, docs, SF), name.replace(" ", "_"))
        seen[name] = (before, {r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    before, after = seen["quality"]
    assert sum((i in after) == bool(labels[i]) for i, _ in before if i in labels) >= 0.95 * sum(i in labels for i, _ in before)

    before, after = seen["line dedup"]
    lines, gone = brute_line_dedup(before, 50)
    left = {i: [x for k, x in enumerate(ls) if (i, k) not in gone] for i, ls in lines.items()}
    assert set(after) == {i for i, ls in lines.items() if left[i] or not ls}
    assert all(len(after[i].text) == after[i].n_chars and after[i].text == brute_text_left(dict(before)[i], {k for d, k in gone if d == i}) for i in after)

    before, after = seen["near copies"]
    assert set(after) == set(brute_components([i for i, _ in before], near_pairs(before)).values())

    before, after = seen["decontamination"]
    items = [decontaminate.words_of(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    bad = {i for i, t in before for w in items if len(set(w) & set(decontaminate.words_of(t))) > len(w) / 3 and distance(w, decontaminate.words_of(t)) <= int(decontaminate.RATE * len(w))}
    assert set(after) == {i for i, _ in before} - bad

    before, after = seen["byte-level BPE"]
    assert len(after) == len(before) and collections.Counter(len(r.ids) == r.n_tokens for r in after.values()) == {True: len(before)}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_tables(spark):
    """Null ids and texts, repeated rows, a very long text, columns named as those that operators add; and an empty table."""
    rows = [(1, "one two three four"), (1, "one two three four"), (2, None), (3, ""), (None, "lost id"), (6, "word " * 60_000), (7, " \n\n \t"), (8, "\n".join(f"line {i}" for i in range(9000)))]
    docs = spark.createDataFrame([(i, t, 1.5, 7, i, t, 0, i) for i, t in rows], "doc_id bigint, text string, quality double, n_lines int, kid bigint, ld_t string, n_deleted int, bucket bigint")
    for (name, stage), n in zip(corpus_pipeline.STAGES[1:4], (7, 5, 7)):  # texts without words are near copies
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert len({tuple(r) for r in got.collect()}) == n, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).columns == docs.columns
    assert len(corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()) == len(rows)
