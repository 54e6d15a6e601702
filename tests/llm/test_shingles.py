"""Near copies by word shingles against brute force."""

from itertools import combinations

import pytest

import corpus_pipeline
from tests.llm.helpers import SCHEMA, documents, prose
from vecforge.llm import shingles, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def brute(sets):
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if label[a] != label[b] and similar(sets[a], sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if r == high else r for i, r in label.items()}
    return label


@pytest.mark.parametrize("block", [1024, 6])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "PACK", block)
    words = prose(9, 400).split()
    texts = [" ".join(words[:i] + ["new"] + words[i + 1 :]) for i in range(0, 400, 20)]  # one word: five shingles
    texts += [" ".join(words[i : i + 250]) for i in range(0, 150, 15)]  # a chain of windows
    texts += [" ".join(words[: 60 + i] + prose(i, 25).split()) for i in range(0, 60, 6)]  # one opening, many ends
    texts += [prose(70 + i, 40) for i in range(5)] + [None, "", "one", "one", "one two"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *"uvwxyz") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = brute({i: shingle_set(t) for i, t in enumerate(texts)})
    got = {r.id: r.root for r in shingles.components(docs).collect()}
    assert {i: got.get(i, i) for i in want} == want
    assert shingles.deduplicated(docs).columns == docs.columns


def test_pipeline_leaves_no_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, sf).collect()
    sets = {r.doc_id: shingle_set(r.text) for r in kept}
    assert not [p for p in combinations(sorted(sets), 2) if similar(sets[p[0]], sets[p[1]])]
    once = {r.doc_id: shingle_set(r.text) for r in simhash.deduplicated(docs).collect()}
    label = brute(once)
    assert sorted(sets) == sorted(set(label.values())) and len(sets) < len(once)


def test_odd_documents(spark):
    out = shingles.deduplicated(documents(spark))
    assert {r.doc_id for r in out.collect()} >= {None, 3, 4, 5, 6}
