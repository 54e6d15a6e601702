"""Operators on documents against brute-force versions and on odd rows."""

import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import crc, documents, empty, prose, rows
from vecforge.llm import mixing, packing, quality, repair, sharding, simhash, substring_dedup, suffix_array, tokens, toxicity
from vecforge.llm.common import connected_components, record_batch, stored, with_position

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
OWN = [r for r in rows() if r[0] is not None]


def components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- shared steps


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    want = components(edges, {x for e in edges if e[0] != e[1] for x in e})
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_with_position(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("k"), "id")
    got = {(r.k, r.id): r.position for r in with_position(df, ["k", "id"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got) and sorted(got.values()) == list(range(500))


# --- sharding


def test_hilbert_curve_is_a_walk():
    side = 8
    cells = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(side)] * 3, indexing="ij")])
    order = np.argsort(sharding.hilbert_index(cells, 3))
    assert sorted(sharding.hilbert_index(cells, 3).tolist()) == list(range(side**3))
    assert (np.abs(np.diff(cells[:, order], axis=1)).sum(axis=0) == 1).all()


def test_hilbert_shards(spark, tmp_path):
    got = sharding.hilbert_shards(documents(spark), 5, keep=["lang"]).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(OWN) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    raw = {r[0]: (r[1] or "").encode() for r in OWN}
    assert all((r.size, r.text_crc32) == (len(raw[r.id]) + 16, crc(raw[r.id])) for r in got)
    assert sharding.hilbert_shards(empty(spark), 5).count() == 0
    sharding.write_shards(sharding.hilbert_shards(documents(spark), 3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(OWN)


def test_shards_are_compact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.hilbert_shards(docs, 40, keep=["source"]).collect()
    kinds = collections.defaultdict(set)
    for r in out:
        kinds[r.shard].add(r.source)
    assert np.mean([len(v) for v in kinds.values()]) < 4  # of 20 sources, five rows a shard


# --- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    ids = [i for i, _ in fps]
    links = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3]
    return components(links, ids)


def test_simhash(spark):
    fps = [(r[0], brute_fingerprint(r[1])) for r in OWN]
    want = brute_groups(fps)
    got = simhash.near_duplicates(documents(spark)).select("id", simhash.as_hex("fp").alias("hex"), "component_id").collect()
    assert sorted((r.id, int(r.hex, 16), r.component_id) for r in got) == sorted((i, f, want[i]) for i, f in fps)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.deduplicated(documents(spark))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == documents(spark).columns
    data = [(1, prose(1, 40)), (1, prose(2, 40)), (1, prose(2, 40)), (2, prose(1, 40)), (3, prose(3, 40))]
    kept = simhash.deduplicated(documents(spark, [(i, t, "en", "s", 1, *"abcdef") for i, t in data])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({data[0], data[1], data[4]})


def test_simhash_blocks_of_one_key(spark, monkeypatch):
    """A chain of fingerprints in one bucket, cut into blocks of eight."""
    from vecforge.llm import hamming

    monkeypatch.setattr(hamming, "BLOCK", 8)
    monkeypatch.setattr(hamming, "PACK", 16)
    rng = np.random.default_rng(1)
    base = [0]
    for _ in range(60):
        base.append(base[-1] ^ (1 << int(rng.integers(0, 32))) ^ (1 << int(rng.integers(0, 32))))
    far = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    codes = list(dict.fromkeys(base + far))
    want = brute_groups([(c, c) for c in codes])
    found = {r.id: r.root for r in hamming.components(spark.createDataFrame([(c,) for c in codes], "code long"), simhash.variants, 3).collect()}
    assert {c: found.get(c, c) for c in codes} == want


def test_simhash_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_groups(fps)
    assert {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want


# --- quality and toxicity


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = quality.scored(docs, labels.where(fold != 0)).join(labels.where(fold == 0).withColumnRenamed("doc_id", "id"), "id")
    right, n = out.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 500 and right > 0.98


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (7, None), (7, 1), (4, 0)], "doc_id long, quality int")
    got = quality.scored(documents(spark), labels).collect()
    assert len(got) == len(OWN) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.scored(documents(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.scored(empty(spark), labels).count() == 0
    assert quality.statistics(b"") == [0.0] * len(quality.STATISTICS)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = toxicity.fit(docs, labels.where(fold != 1))
    out = toxicity.scored(docs, model).join(labels.where(fold == 1).withColumnRenamed("doc_id", "id"), "id")
    sums = {r.toxic: (r.right, r.n) for r in out.groupBy("toxic").agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("toxic")).cast("double")).alias("right"), F.count("*").alias("n")).collect()}
    assert sums[1][0] > 0.8 and sums[0][0] > 0.995  # some documents of this table are labelled toxic without a toxic word
    kept = toxicity.filtered(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == toxicity.scored(docs, model).where("score < 0.7").count()


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 0), (3, 0), (None, 1), (7, None), (8, 1), (11, 1), (2, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark), labels)
    got = toxicity.scored(documents(spark), model).collect()
    assert len(got) == len(OWN) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(documents(spark), labels.limit(0))
    assert {r.score for r in toxicity.scored(documents(spark), none).collect()} == {0.5}
    assert toxicity.scored(empty(spark), model).count() == 0


def test_maximal_segments():
    """Every segment is the best within its part: the recursive definition."""

    def brute(scores, offset=0):
        best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        s, _, a, b = best
        return brute(scores[:a], offset) + [(a + offset, b + offset, s)] + brute(scores[b:], offset + b)

    rng = np.random.default_rng(3)
    for _ in range(150):
        scores = rng.normal(size=rng.integers(1, 14)).round(3)
        got = toxicity.segments(scores)
        want = brute(scores.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


# --- mixing


def test_mixing_hits_its_weights(spark):
    data = [(i, prose(i % 7, 20), "en", "big" if i % 3 else "small", 1, *"abcdef") for i in range(3000)]
    docs = documents(spark, data)
    out = mixing.positions(docs, {"big": 1.0, "small": 1.0}).cache()
    counts = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["big"] / counts["small"] - 1) < 0.12
    rate = {r.source: r.rate for r in mixing.rates(docs, {"big": 1.0, "small": 1.0}).collect()}
    by = collections.Counter(r.doc_id for r in out.collect())
    share = sum(1 for r in docs.where("source = 'small'").collect() if by[r.doc_id] == 0) / 1000
    assert abs(share - math.exp(-rate["small"])) < 0.05
    assert sorted(r.position for r in out.collect()) == list(range(out.count()))
    assert mixing.positions(docs, {"big": 1.0}).where("source = 'small'").count() == 0


def test_mixing_odd_rows(spark):
    docs = documents(spark)
    out = mixing.shuffled(docs)
    assert out.columns == docs.columns and out.where("doc_id is null").count() == 0
    per = {(r.doc_id, r.text): r.n for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert all(n % 2 == 0 for (i, _), n in per.items() if i in (0, 7))  # repeated rows are drawn alike
    assert mixing.positions(empty(spark)).count() == 0


# --- suffix sorting


def test_suffix_order(spark):
    rng = np.random.default_rng(5)
    strings = [rng.integers(0, 3, rng.integers(1, 25)).tolist() for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(strings)), "sid long, letters array<long>")
    ranks = {r.sid: r.ranks for r in suffix_array.suffix_order(df, 25).collect()}
    all_ = sorted(tuple(s[i:]) for s in strings for i in range(len(s)))
    first = {}
    for i, s in enumerate(all_):
        first.setdefault(s, i)
    assert {i: [first[tuple(s[j:])] for j in range(len(s))] for i, s in enumerate(strings)} == ranks


def brute_cut(texts):
    n = substring_dedup.LENGTH
    seen = collections.Counter(t[s : s + n] for t in texts for s in range(len(t) - n + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                mark[s : s + n] = b"\1" * n
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out


def cut(df):
    got = substring_dedup.removed(df).collect()
    return sorted((r.id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), r.kept_sha256) for r in got)


def test_repeats_of_odd_rows(spark):
    want = brute_cut([(r[1] or "").encode() for r in OWN])
    assert cut(documents(spark)) == sorted((r[0], *w) for r, w in zip(OWN, want, strict=True))
    assert substring_dedup.removed(empty(spark)).count() == 0


def test_repeats_of_every_kind(spark):
    """Passages at odd edges, runs of one letter, overlaps within a text, lengths about the limit."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefgh"))

    def noise(n):
        return "".join(rng.choice(letters, n))

    passage, exact = noise(350), noise(200)
    texts = [noise(100) + passage + noise(50), passage[20:330] + noise(10), noise(3) + passage[149:], passage[:199], exact, "é" + exact, exact[:199] + "é", "a" * 900, "b" * 200, "b" * 201, "ab" * 300, (noise(90)) * 7, noise(5000), ""]
    edited = list(noise(3000))
    for i in range(60):
        copy = edited.copy()
        copy[int(rng.integers(0, 3000))] = "z"
        copy[int(rng.integers(0, 3000))] = "y"
        if i % 3 == 0:
            texts.append("".join(copy))
    data = [(i, t, "en", "s", 1, *"abcdef") for i, t in enumerate(texts)]
    assert cut(documents(spark, data)) == [(i, *w) for i, w in enumerate(brute_cut([t.encode() for t in texts]))]


def test_repeats_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 1000)
    text = prose(9, 900)
    h, p, a, z = substring_dedup.runs(text.encode())
    assert sorted(s for x, y in zip(a.tolist(), z.tolist(), strict=True) for s in range(x, y + 1)) == list(range(len(text.encode()) - 199))
    assert (p >= z).all() and (p - a <= substring_dedup.LENGTH - substring_dedup.K).all()


def test_cleaned_text_is_valid(spark):
    text = "Größe ñandú été " * 30
    data = [(i, text[i:] + prose(i, 60), "en", "s", 1, *"abcdef") for i in range(3)]
    docs = documents(spark, data)
    out = substring_dedup.cleaned(docs)
    assert out.columns == docs.columns and all(len(r.text) < len(text) for r in out.collect())
    assert substring_dedup.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)] and substring_dedup.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]


# --- tokens


ODD = ["", " ", "  ", " a", "a ", " a  b\n c \n\n d's  ", "\n x", "\x1c x \x1c y", "<|endoftext|> a<|startoftext|>", "x <|ENDOFTEXT|>y <|endoftext|>", "<|endoftext|>", "ΑΣ ΣΑΣ Σ", "é ́e", " \t x", "日本 語 🙂 🙂🙂  x", "don't we'll I'M  ''s", "123 4567 12a a12", "x" * 3000, "İ ǅ ŉ", "Word.\nNext,\n\nThird", "A b  c"]


@pytest.mark.parametrize(("path", "keep"), [(BYTE, True), (WORD, False)])
def test_encoder_is_exact(spark, sf, path, keep, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(path, keep).encode(texts)] == want
    monkeypatch.setattr(tokens, "PIECES", 50)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 700)
    assert [x.tolist() for x in tokens.Encoder(path, keep).encode(texts)] == want


def encoded(path, end):
    library = Tokenizer.from_file(path)
    return [(r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [end], "<u4")) for r in OWN]


def test_repair_grammar_is_exact():
    rng = np.random.default_rng(7)
    docs = [rng.choice([1, 2, 3, 500], n, p=[0.5, 0.3, 0.15, 0.05]).astype(np.uint16) for n in (1, 5000, 20_000, 2, 700)]
    docs[3][:] = 1
    for base in (600, 70_000):
        payload = repair.write_shard([5, 6, 7, 8, 9], [d.astype(np.uint32) if base > 65_535 else d for d in docs], base)
        shard = repair.Shard(payload, base)
        assert len(shard.left) and all((a == b).all() for a, b in zip(docs, shard.documents(), strict=True))
        assert all((docs[i] == shard.document(i)).all() for i in range(5)) and shard.doc_ids.tolist() == [5, 6, 7, 8, 9]
        assert len(payload) < sum(map(len, docs)) * 2
    with pytest.raises(ValueError):
        repair.Shard(bytes(100), 600)


def test_token_shards(spark):
    path = repair.stored_tokens(documents(spark), WORD, 49_408, shard_tokens=500)
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in repair.read_checksums(spark, path, 49_408).collect())
    want = sorted(encoded(WORD, 2), key=lambda x: x[0])
    assert [i for _, i, _, _ in got] == [i for i, _ in want]
    assert [s for s, *_ in got] == np.cumsum([0, *(n for _, _, n, _ in got[:-1])]).tolist()
    assert sorted((i, n, c) for _, i, n, c in got) == sorted((i, len(x), crc(x.tobytes())) for i, x in want)
    ids = {r.id: np.frombuffer(r.ids, "<u4") for r in repair.read(spark, path, 49_408).collect()}
    assert all((ids[i] == x).all() for i, x in want)
    none = repair.stored_tokens(empty(spark), WORD, 49_408)
    assert repair.read_checksums(spark, none, 49_408).count() == 0


def test_packing(spark):
    got = packing.packed(documents(spark), BYTE, with_ids=True).collect()
    want = collections.Counter((i, x.tobytes()) for i, x in encoded(BYTE, 1))
    whole, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == crc(r.ids) and r.length * 4 == len(r.ids)
        whole[r.id, r.row].append(r)
        windows[r.sequence_id].append(r)
    assert collections.Counter((i, b"".join(p.ids for p in sorted(ps, key=lambda p: p.start))) for (i, _), ps in whole.items()) == want
    assert sorted(windows) == list(range(len(windows)))
    for ps in windows.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0, *(p.length for p in ps[:-1])]).tolist() and sum(p.length for p in ps) <= 2048
    assert packing.packed(empty(spark), BYTE).count() == 0


def test_sum_of_squares_rule():
    """The level chosen leaves the least sum of squares, among all levels and a new window."""
    rng = np.random.default_rng(8)
    packer = packing.Packer(window=20, max_open=1000)
    for row in range(400):
        size = int(rng.integers(1, 20))

        def after(h, size=size):
            n = packer.levels.copy()
            if h:
                n[h] -= 1
            if h + size < 20:
                n[h + size] += 1
            return int((n[1:20] ** 2).sum())

        options = [0, *(h for h in range(1, 21 - size) if packer.levels[h])]
        assert after(packer.level_for(size)) == min(map(after, options))
        list(packer.add(row, np.full(size, row, np.uint16)))
    closed = list(packer.finish())
    assert sum(sum(len(p[2]) for p in w) < 20 for w in closed) <= 1 and packer.levels.sum() == 0


def test_packing_pads_little(spark, sf):
    got = packing.packed(spark.read.parquet(f"{sf}/documents.parquet").coalesce(1), BYTE)
    n, used = got.agg(F.max("sequence_id") + 1, F.sum("length")).first()
    assert n - used / 2048 < 1


@pytest.mark.parametrize(("name", "keep"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_words_share_their_parts(name, keep):
    """A word is merged once for a batch, whatever its case, its punctuation and the line it stands on."""
    path = public_tokenizers.path(name)
    enc, library = tokens.Encoder(path, keep), Tokenizer.from_file(path)
    calls = []

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return library.model.tokenize(text)

    enc.model = Counted()
    texts = ["xqvord xqvord, xqvord. (xqvord)", "a xqvord\nxqvord! étéqq étéqq;", "a  xqvord,\t中文 xqvord,", "", None, "Xqvord, XQVORD xqvord"]
    for _ in range(2):
        got = [x.tolist() for x in enc.encode(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(calls) == len(set(calls))
    if not keep:
        assert len([c for c in calls if "xqvord" in c]) == 1


def test_suffix_sort_takes_few_passes(spark, monkeypatch):
    """Nine letters are two rounds of one sort each; the difference cover took four."""
    sorts = []
    plain = suffix_array.counts_below
    monkeypatch.setattr(suffix_array, "counts_below", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    df = spark.createDataFrame([(0, [5, 5, 5, 1]), (1, [5, 1])], "sid long, letters array<long>")
    assert {r.sid: r.ranks for r in suffix_array.suffix_order(df, 9).collect()} == {0: [5, 4, 2, 0], 1: [2, 0]}
    assert len(sorts) == 2


def test_the_suffix_sort_decides_every_repeat(spark, monkeypatch):
    """Copies of a text, repeated runs and windows of runs that differ: nothing is marked that the sort has not found.
    Counts of texts and runs marked most of it before."""
    base, kinds = prose(21, 200), collections.Counter()
    texts = [base, base, base[:700] + prose(22, 40), base[:300] + "#" + base[301:], prose(23, 90)]
    docs = documents(spark, [(i, t, "en", "s", 1, *"abcdef") for i, t in enumerate(texts)]).repartition(2)
    plain = substring_dedup.adjacent
    monkeypatch.setattr(substring_dedup, "adjacent", lambda *a: plain(*a).withColumns({"repeated": F.lit(False), "more": F.lit(False)}))
    assert substring_dedup.repeated_windows(docs).count() == 0

    def counted(*a):
        for r in plain(*a).where("repeated or more").selectExpr("sid % 4 kind").groupBy("kind").count().collect():
            kinds[r.kind] += r["count"]
        return plain(*a)

    monkeypatch.setattr(substring_dedup, "adjacent", counted)
    assert cut(docs) == [(i, *w) for i, w in enumerate(brute_cut([t.encode() for t in texts]))] and all(kinds[k] > 0 for k in range(3))


def test_runs_of_joined_texts():
    """Texts searched in one block have the runs that each has by itself."""
    texts = [prose(i, 60 + 40 * i).encode() for i in range(4)] + [b"ab" * 200, b"x" * 200]
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    text, h, p, a, z = substring_dedup._runs(b"".join(texts), begins, sizes)
    got = sorted(zip(text.tolist(), h.tolist(), (p - begins[text]).tolist(), (a - begins[text]).tolist(), (z - begins[text]).tolist(), strict=True))
    assert got == sorted((i, *r) for i, t in enumerate(texts) for r in zip(*(c.tolist() for c in substring_dedup.runs(t)), strict=True))


def test_spans_of_a_batch():
    windows = pa.array([[(3 << 32) | 5, 0, (205 << 32) | 205], None, [], [(7 << 32) | 7]], pa.list_(pa.int64()))
    offsets, begins, ends = substring_dedup.spans(windows)
    assert offsets.tolist() == [0, 1, 1, 1, 2] and begins.tolist() == [0, 7] and ends.tolist() == [405, 207]


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield record_batch(n=pa.array([b.nbytes], pa.int64()))

    long = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    seen = [r.n for r in stored(long.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert len(seen) > 4 and max(seen) < 3 << 20


def test_plain_words_are_taken_apart_by_arrow(monkeypatch):
    """Only pieces that are no ASCII word with punctuation are taken apart one by one."""
    alone = []
    plain = tokens.Encoder._words
    monkeypatch.setattr(tokens.Encoder, "_words", lambda self, new, atoms: alone.extend(new) or plain(self, new, atoms))
    texts = ["Word word, WORD... don't a\nb été x1 (y) !", "word! Word,", ""]
    got = [ids.tolist() for ids in tokens.Encoder(WORD, False).encode(texts)]
    assert got == [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert set(alone) == {"don't", "a\nb", "été", "x1", "(y)", "!", ""}
