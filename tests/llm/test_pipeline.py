"""The pipeline's stages against brute force, each on what its predecessor kept."""

import os
from collections import defaultdict

import pytest

from tests.llm.test_operators import SPACE, components, words

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # rows that repeat, an id with two texts, nulls
    odd = spark.createDataFrame([(0, "another text", "en", "s", 1), (9001, None, None, None, None), (9002, "", "en", "s", 0), (None, "no id", "en", "s", 1)], docs.schema)
    docs = docs.unionByName(docs.limit(3)).unionByName(odd)
    columns = docs.columns
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held.append([r.asDict() for r in docs.collect()])
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = {r["doc_id"] for r in held[0]}
    assert all((i in clean) != bool(t) for i, t in labels.items())

    groups = defaultdict(list)
    for r in held[0]:
        groups[SPACE.sub("", r["text"] or "")].append(r)
    low = 2**62
    want = {min((-len(r["text"] or ""), low if r["doc_id"] is None else r["doc_id"]) for r in g) for g in groups.values()}
    assert sorted((-len(r["text"] or ""), low if r["doc_id"] is None else r["doc_id"]) for r in held[1]) == sorted(want)

    rows = sorted((r for r in held[1] if r["doc_id"] not in (None, 0)), key=lambda r: r["doc_id"])
    sets = []
    for r in rows:
        w = words(r["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    kept = {rows[i]["doc_id"] for i, c in enumerate(components(len(rows), links)) if i == c}
    assert {r["doc_id"] for r in held[2]} - {None, 0} == kept
    assert {r["doc_id"] for r in held[3]} == {r["doc_id"] for r in held[2]}
