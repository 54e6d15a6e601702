"""The learnt operators, orders and grammars against plain versions of the same rule."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import crc, documents, prose
from vecforge.llm import calibration, common, embedding_dedup, mixing, quality, repair, sharding, toxicity


def test_isotonic_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(1, 9, 12).astype(float)
        p = rng.binomial(n.astype(int), 0.4).astype(float)
        mean = lambda a, b: p[a:b].sum() / n[a:b].sum()  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(calibration.pool_adjacent(n, p), want)


def _labelled(spark, n=240):
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, int(rng.integers(5, 60))) + (" !!! ### " * int(rng.integers(1, 9)) if i % 3 else "."), "en", "s", 1, *"abcdef") for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0), "x", 1.0) for i in range(n)], "doc_id long, quality int, toxic int, text string, label double")
    return documents(spark, rows), labels


def test_quality_against_plain_normal_equations(spark):
    docs, labels = _labelled(spark)
    got = {r.id: r.score for r in quality.scored(docs, labels).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    held = {r.id for r in spark.range(len(rows)).where(quality._calibrates()).collect()}
    x = np.array([quality.statistics(rows[i].encode()) for i in range(len(rows))])
    y = np.array([float(i % 3 == 0) for i in range(len(rows))])
    w, phase = quality.waves(x.shape[1])
    z = quality.features(x, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), w, phase)
    learn = np.array([i not in held for i in range(len(rows))])
    beta = np.linalg.solve(z[learn].T @ z[learn] + quality.RIDGE * np.eye(z.shape[1]), z[learn].T @ y[learn])
    raw = z @ beta
    bins = collections.defaultdict(lambda: [0.0, 0.0])
    for i in sorted(held):
        at = min(max(math.floor((round(raw[i], 9) - quality.LOW) / (quality.HIGH - quality.LOW) * calibration.BINS), 0), calibration.BINS - 1)
        bins[at][0] += 1
        bins[at][1] += y[i]
    at = sorted(bins)
    step = (quality.HIGH - quality.LOW) / calibration.BINS
    curve = [quality.LOW, *(quality.LOW + (b + 0.5) * step for b in at), quality.HIGH], calibration.pool_adjacent(np.array([1.0, *(bins[b][0] for b in at), 1.0]), np.array([0.5, *(bins[b][1] for b in at), 0.5]))
    assert np.allclose([got[i] for i in range(len(rows))], np.interp(raw, *curve), atol=2e-3)
    # the kernel that the waves stand for
    a, b = np.random.default_rng(3).normal(size=(2, 5))
    w, phase = quality.waves(5, 20_000)
    wave = lambda v: np.sqrt(2 / 20_000) * np.cos(v @ w + phase)
    assert wave(a) @ wave(b) == pytest.approx(math.exp(-((a - b) ** 2).sum() / (2 * quality.WIDTH**2)), abs=0.03)


def test_toxic_scores_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    rng = np.random.default_rng(4)
    bad, good = ["grubble", "snorkt", "vilefex"], ["harvest", "meadow", "lantern"]
    rows = []
    for i in range(300):
        own = prose(i, int(rng.integers(8, 30))).split()
        for w in bad if i % 4 == 0 else good:
            own.insert(int(rng.integers(0, len(own))), w)
        rows.append((i, " ".join(own), "en", "s", 1, *"abcdef"))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(300)], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    held = {r._id for r in spark.range(300).withColumnRenamed("id", "_id").where(toxicity.calibrates()).collect()}
    counts = [collections.Counter(), collections.Counter()]
    n = [0, 0]
    for i, text, *_ in rows:
        if i not in held:
            n[i % 4 == 0] += 1
            counts[i % 4 == 0].update({b for w in text.encode().split() for b in toxicity.buckets(w)})
    rate = toxicity.PRIOR / min(n)
    delta = {k: math.log(counts[1][k] / n[1] + rate) - math.log(counts[0][k] / n[0] + rate) for k in counts[0] | counts[1]}
    want = {k: v for k, v in delta.items() if abs(v) >= toxicity.LEAST}
    assert dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want, abs=1e-5)
    assert min(want.values()) < 0 < max(want.values())  # words of clean documents count against

    def plain(text):
        scores = []
        for w in text.encode().split():
            own = [want.get(b, 0.0) for b in toxicity.buckets(w)]
            scores.append(max(own, key=lambda v: (abs(v), v)) - toxicity.DRIFT)
        found = toxicity.segments(np.array(scores))
        return np.interp(toxicity.evidence([s[2] for s in found], len(scores), model.lam, model.k), *model.curve)

    got = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    assert all(abs(got[i] - plain(text)) < 1e-3 for i, text, *_ in rows)
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in got)
    assert sorted(r.doc_id for r in toxicity.filtered(docs, model, 0.7).collect()) == [i for i in range(300) if i % 4]


def test_evidence_of_segments():
    lam, k = 0.8, 1e-3
    assert toxicity.evidence([9.0], 500, lam, k) == pytest.approx(-math.log(k * 500 * math.exp(-lam * 9.0)))
    # every segment counts, beyond any number
    few, many = ([100.0] * n for n in (64, 70))
    assert toxicity.evidence([], 5, lam, k) == toxicity.LOW < toxicity.evidence([0.1], 5, lam, k) < toxicity.evidence([6.0, 5.0], 5, lam, k)
    monkey = toxicity.HIGH
    toxicity.HIGH = 1e9
    try:
        assert toxicity.evidence(many, 5, lam, k) > toxicity.evidence(few, 5, lam, k)
    finally:
        toxicity.HIGH = monkey


def test_shards_follow_the_curve(spark):
    """Two string columns that differ only beyond their first letters, in plain order."""
    rng = np.random.default_rng(5)
    rows = [(int(i), f"text {i % 5}", f"https://site-{int(rng.integers(0, 40)):03d}.example/a", f"prefix-{'z' * int(rng.integers(0, 30))}", 1, *"abcdef") for i in rng.permutation(500)]
    rows.append((500, None, None, None, None, *"abcdef"))

    def cells(values):
        order, out = sorted(v for v in values if v is not None), []
        cuts = {order[i] for i in range(1, len(order)) if i * 64 // len(order) > (i - 1) * 64 // len(order)}
        for v in values:
            out.append(0 if v is None else sum(c <= v for c in cuts))
        return np.array(out)

    curve = sharding.hilbert_index(np.stack([cells([r[2] for r in rows]), cells([r[3] for r in rows])]), 6)
    order = sorted(range(len(rows)), key=lambda i: (curve[i], rows[i][0], crc((rows[i][1] or "").encode())))
    want = {rows[i][0]: p * 7 // len(rows) for p, i in enumerate(order)}
    got = {r.id: r.shard for r in sharding.hilbert_shards(documents(spark, rows), 7, ["lang", "source"]).collect()}
    assert got == want and len(set(curve.tolist())) > 100


def test_poisson_tables_of_small_and_huge_rates(spark):
    rates = [0.01, 1.0, 31.5, 300.0, 50_000.0]
    got = mixing.distributions(spark.createDataFrame([(str(x), x) for x in rates], "source string, rate double")).collect()
    for r in got:
        k = np.arange(0, int(r.low) + len(r.cdf))
        want = np.cumsum(np.exp(k * math.log(r.rate) - r.rate - np.array([math.lgamma(i + 1) for i in k])))[int(r.low) :]
        assert np.allclose(r.cdf, want, atol=1e-8) and len(r.cdf) < 24 * math.sqrt(r.rate) + 90
    docs = documents(spark, [(0, "tiny", "en", "rare", 1, *"abcdef")] + [(i, "x" * 90_000, "en", "big", 1, *"abcdef") for i in range(1, 40)])
    copies = {r.source: r.n for r in mixing.positions(docs, {"rare": 1.0, "big": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert copies["rare"] > 300_000 and abs(copies["rare"] * 5 / (39 * 90_001 / 2) - 1) < 0.02


def plain_repair(ids, ends, base, least):
    """Re-Pair one pair at a time, every count anew: (symbols, rules)."""
    own, last, rules = list(ids), list(ends), 0
    while True:
        counts, seen = collections.Counter(), {}
        for i in range(len(own) - 1):
            pair = own[i], own[i + 1]
            if not last[i] and not (pair[0] == pair[1] and seen.get(pair) == i - 1):
                counts[pair], seen[pair] = counts[pair] + 1, i
        if not counts or (best := min(counts, key=lambda p: (-counts[p], p))) and counts[best] < least:
            return own, last, rules
        out, ends_, i = [], [], 0
        while i < len(own):
            both = i + 1 < len(own) and (own[i], own[i + 1]) == best and not last[i]
            out.append(base + rules if both else own[i])
            ends_.append(last[i + both])
            i += 1 + both
        own, last, rules = out, ends_, rules + 1


@pytest.mark.parametrize("base", [40, 65_530, 70_000])
def test_grammar_against_plain_repair(base):
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 40, rng.integers(1, 6)) for _ in range(60)]
    ids = np.concatenate([words[int(i)] for i in np.minimum(rng.zipf(1.3, 1500) - 1, 59)] + [np.full(100, 3)])
    ends = np.zeros(len(ids), bool)
    ends[[100, 101, 1700, len(ids) - 1]] = True
    want = plain_repair(ids.tolist(), ends.tolist(), base, 8)
    symbols, last, rules = repair.compress(ids.astype(np.uint32), ends, base, 8)
    assert abs(len(symbols) - len(want[0])) < 0.02 * len(want[0]) and abs(len(rules) - want[2]) < 0.2 * want[2]
    assert plain_repair(symbols.tolist(), last.tolist(), 10**6, 8)[2] == 0  # no pair is left that occurs so often
    assert last.sum() == ends.sum()


def test_vectors_of_extreme_length(spark):
    v = np.random.default_rng(7).normal(size=64)
    x = [v, v * 1e200, v * 1e-200, -v]
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3)}


def test_links_inside_wide_clusters(spark):
    """Clusters whose members lie near each other without linking, with planted pairs and one group that links as a whole."""
    rng = np.random.default_rng(8)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = np.concatenate([unit(np.sqrt(0.7) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.3) * unit(rng.normal(size=(2500, 64)))) for _ in range(8)])
    pick = x[::20]
    side = rng.normal(size=pick.shape)
    side = unit(side - (side * pick).sum(axis=1, keepdims=True) * pick)
    x = np.concatenate([x, 0.951 * pick + np.sqrt(1 - 0.951**2) * side, x[:1] + rng.normal(size=(200, 64)) * 0.02]).astype(np.float32).astype(float)
    u = unit(x)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    links = near.sum(axis=1)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = np.zeros(len(x), int)
    for r in embedding_dedup.near_duplicates(table).collect():
        found[r.id] = r.n_links
    assert len(x) > 20_000 and (found <= links).all()
    planted = links[20_000:21_000]
    assert found.sum() >= 0.98 * links.sum() and found[20_000:21_000].sum() >= 0.97 * planted.sum()


def test_tables_need_a_shared_folder():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "spark://head:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert common.shared_dir(Session()) == "hdfs://x/y"
