"""Operators on embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.llm import ann, embedding_dedup, itq

SCHEMA = "vec_id long, embedding array<float>, id string, digest string, code string, score string"


def table(spark, vectors, ids=None):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], *"wxyz") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def cloud(n=400, dims=64, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    groups = [x[0] + rng.normal(size=(80, dims)) * 0.12, x[1] + rng.normal(size=(30, dims)) * 0.2, np.repeat(x[2:3], 60, axis=0)]
    return np.concatenate([x, *groups]).astype(np.float32).astype(float)


def brute(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label, len(x)).min(axis=1))
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("block", [1024, 16])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    x = cloud()
    links, label = brute(x)
    got = sorted(embedding_dedup.near_duplicates(table(spark, x)).collect())
    found = np.array([r.n_links for r in got])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    same = [r.component_id == c for r, c in zip(got, label, strict=True)]
    assert np.mean(same) > 0.99


def test_odd_vectors(spark):
    v = [1.0] * 64
    odd = [v, v, None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [None] * 64, [2.0] * 64, [1.0] * 8, [-1.0] * 64]
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table(spark, odd)).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 8: (2, 0)} | {i: (0, i) for i in (2, 3, 4, 5, 6, 7, 9, 10)}
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0
    again = embedding_dedup.near_duplicates(table(spark, [v, v, v], [4, 4, 7])).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in again) == [(4, 2, 4), (4, 2, 4), (7, 2, 4)]


def test_codes_are_balanced_and_rotation_is_orthogonal():
    x = itq.unit(np.random.default_rng(2).normal(size=(3000, 32)))
    mean, projection = itq.learn(x, 32, 1)
    assert np.allclose(projection.T @ projection, np.eye(32), atol=1e-8)
    bits = np.unpackbits(itq.codes(x, (mean, projection)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :32]
    assert (np.abs(bits.mean(axis=0) - 0.5) < 0.08).all()


def nearest(x, ids, q, k):
    s = (x * x[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_recall(spark):
    x = itq.unit(np.random.default_rng(4).normal(size=(5000, 64))).astype(np.float32).astype(float)
    ids = np.arange(5000)
    got = {}
    for r in ann.nearest(table(spark, x), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    hits = sum(len({i for i, _ in nearest(x, ids, q, 20)} & {i for i, _ in got[q]}) for q in range(0, 5000, 20))
    assert hits / (250 * 20) > 0.93
    assert all(s == pytest.approx(x[i] @ x[q], abs=1e-12) for q, own in got.items() for i, s in own)


def test_ties_lengths_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 90, axis=0), rng.normal(size=(60, 16)) * rng.uniform(0.1, 5, (60, 1))]).astype(np.float32).astype(float)
    ids = np.arange(len(x))
    got = {}
    for r in ann.nearest(table(spark, x), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in (0, 20, 40, 60, 80):
        best = nearest(x, ids, q, 20)
        tied = [i for i, s in best if s == best[-1][1]]
        if len(tied) > 1 and len(got[q]) == 20:
            assert tied == sorted(tied) and got[q] == [i for i, _ in best]
    few = ann.nearest(table(spark, [[1.0, 2.0], [2.0, 1.0], [0.0, 0.0], None, [1.0, None], [3.0, 3.0]], [0, 5, 7, 8, 9, 20]), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in few] == [(0, 1, 20), (0, 2, 5), (20, 1, 0), (20, 2, 5)]
    assert ann.nearest(table(spark, []), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("mean, norms", [(0.71, False), (0.89, True)])
def test_recall_with_a_common_direction(spark, mean, norms):
    rng = np.random.default_rng(8)
    x = itq.unit(rng.normal(size=(4000, 64)) * np.sqrt((1 - mean**2) / 64) + mean * np.eye(64)[0])
    x = (x * rng.uniform(0.3, 3, (4000, 1)) if norms else x).astype(np.float32).astype(float)
    got = {}
    for r in ann.nearest(table(spark, x), F.col("id") % 40 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert {len(own) for own in got.values()} == {20} and len(got) == 100
    hits = sum(len({i for i, _ in nearest(x, np.arange(4000), q, 20)} & own) for q, own in got.items())
    assert hits / (100 * 20) > 0.95


@pytest.mark.parametrize("mean", [0.01, 0.71, 0.89])
def test_separate_pairs_with_a_common_direction(spark, mean):
    rng = np.random.default_rng(12)
    a = itq.unit(rng.normal(size=(1500, 64)) * np.sqrt((1 - mean**2) / 64) + mean * np.eye(64)[0])
    side = rng.normal(size=a.shape)
    side = itq.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    x = np.concatenate([a, 0.951 * a + np.sqrt(1 - 0.951**2) * side]).astype(np.float32).astype(float)
    links, _ = brute(x)
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(table(spark, x)).collect())
    print(f"links found at mean {mean}: {found / links.sum():.4f}")
    assert 0.98 * links.sum() <= found <= links.sum()
