import hashlib
import json
import math
import struct
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecforge.operators import cache, pooling, stats, text
from vecforge.operators.codec import d4
from vecforge.plans.oracle import oracle_sql
from vecforge.plans.queries import queries
from vecforge.sources import tables
from vecforge.streaming import cache as streaming


def test_records_and_golden(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"model": "m", "per_passage": [{"ctx_len": 4096, "depth": 0.5, "channel": "bf16", "n_correct": 2, "n_trials": 3}]}, indent=2))
    rows = tables.records(spark, str(tmp_path / "a.json"), tables.RETRIEVAL).collect()
    assert [(r.ctx_len, r.n_correct, r.accuracy) for r in rows] == [(4096, 2, None)]
    (tmp_path / "g.json").write_text(json.dumps({"d4_q4": {"sha256": "ab", "bits": 416}, "_meta": {"note": "x"}}))
    assert [tuple(r) for r in tables.golden(spark, str(tmp_path / "g.json")).collect()] == [("d4_q4", "ab", 416)]
    tables.write_records(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_trace(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp, power.draw [W], memory.used [MiB]\n2026/01/01 00:00:00, 45.30 W, 12 MiB\n")
    row = tables.trace(spark, str(tmp_path / "t.csv"), ["power_draw", "memory_used"]).first()
    assert (row.power_draw, row.memory_used) == (45.3, 12.0)


def test_tensors_and_shards(spark, tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    x = np.random.default_rng(1).normal(size=(300, 5)).astype("<f4")
    parts = {"w": ("F32", x), "b": ("BF16", (x[:2].view("<u4") >> 16).astype("<u2")), "s": ("F8_E8M0", np.array([126, 127, 130], "u1")), "e": ("F8_E4M3", np.array([[1, 56, 184, 126]], "u1"))}
    header, at = {"__metadata__": {}}, 0
    for name, (kind, v) in parts.items():
        header[name] = {"dtype": kind, "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    raw = json.dumps(header).encode()
    (folder / "model-00003-of-00046.safetensors").write_bytes(struct.pack("<Q", len(raw)) + raw + b"".join(v.tobytes() for _, v in parts.values()))
    found = tables.tensors(spark, f"{folder}/*.safetensors")
    assert {r.name: (r.dtype, r.shape) for r in found.collect()} == {n: (k, list(v.shape)) for n, (k, v) in parts.items()}
    got = {(r.name, r.row): r["values"] for r in tables.tensor_values(found, chunk=64).collect()}
    assert np.array_equal(np.array([got["w", i] for i in range(300)]), x.astype(float)) and len(got) == 300 + 2 + 1 + 1
    assert np.allclose([got["b", i] for i in range(2)], x[:2], rtol=0.01)
    assert got["s", 0] == [0.5, 1.0, 8.0] and got["e", 0] == [2.0**-9, 1.0, -1.0, 448.0]
    assert [(r.snapshot, r.shard) for r in tables.shards(spark, str(tmp_path)).collect()] == [("snap", 3)]
    vec = spark.createDataFrame([(x[0].tolist(),), (None,)], "v array<float>").select(tables.byte_digest(F.col("v")).alias("d"), tables.byte_digest(F.col("v"), "<f8").alias("e")).collect()
    assert vec[0].d == hashlib.sha256(x[0].tobytes()).hexdigest() and vec[0].e == hashlib.sha256(x[0].astype("<f8").tobytes()).hexdigest() and vec[1].d is None


def test_gaussian(spark):
    df = tables.gaussian(spark, 200, 4, 16)
    x = np.array([r.vec for r in df.collect()])
    assert abs(x.std() - 0.3) < 0.01 and abs(x.mean()) < 0.01
    assert df.agg(F.sum(F.xxhash64("vec").cast("decimal(38,0)"))).first() == df.repartition(7).agg(F.sum(F.xxhash64("vec").cast("decimal(38,0)"))).first()
    gain = tables.with_head_gain(df, 4).where("head_idx = 3").first()
    assert gain.vec[0] == pytest.approx(2 * df.where(f"head_idx = 3 and token_idx = {gain.token_idx}").first().vec[0], rel=1e-6)
    assert tables.passages(spark, [("a", "x"), ("b", "y")], 8).where("topic = 'b'").first().text == "y" * 8


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").alias("layer_id"), "vec_id", F.col("embedding").alias("vec"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streaming.source(spark, str(tmp_path / "in"), "layer_id int, vec_id long, vec array<float>", files=2)
    streaming.append(streaming.coded(stream, d4(64, 38), 10, 2), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = cache.write(rows, d4(64, 38), 10, 2)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == rows.count() and got.exceptAll(batch.select(got.columns)).count() == 0
    assert cache.write(rows, None, 10, 2).where("fired").count() == 0


def test_capture_is_repeatable(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema.simpleString()[7:-1].replace(":", " ")
    for state in ("s1", "s2"):
        streaming.capture(streaming.source(spark, str(tmp_path / "in"), schema, files=100), str(tmp_path / "tap"), str(tmp_path / state)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tap")).count() == spark.read.parquet(str(tmp_path / "in")).count()
    windows = streaming.event_counts(streaming.source(spark, str(tmp_path / "in"), schema))
    run = windows.writeStream.format("memory").queryName("windows_test").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("windows_test").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()


def test_layer_names(spark):
    cases = {"decoder.layers.13.mlp.down_proj": 13, "layers.900": 900, "mtp.25": 10025, "a.layers.3.mtp.4.b": 3, "mtp.4.layers.3": 10004, "layers..5": 0, "players.5.x": 0, "layers.x7": 0, "layers.": 0, None: 0, "layers.99999999999": 0}
    rows = spark.createDataFrame(list(cases.items()), "name string, want int")
    assert all(r.got == r.want for r in rows.select(text.module_layer_id(F.col("name")).alias("got"), "want").collect())
    plain = rows.select("name", text.layer_id(F.col("name")).alias("got")).where("name like 'mtp%'").collect()
    assert {r.name: r.got for r in plain} == {"mtp.25": 0, "mtp.4.layers.3": 3}
    with pytest.raises(Exception, match="not a variant"):
        spark.createDataFrame([("e8-38",)], "v string").select(text.parse_variant(F.col("v"))).collect()


def test_passages_are_folded_over_batches(spark):
    """Against a plain loop; batches of seven rows, so that unfinished passages go from one to the next."""
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], " ".join(["w"] * int(rng.integers(0, 40))) + " ") for i in range(300)]
    want = []
    for g in "ab":
        whole, estimate, made = "", 0, 0
        for _, t in [(i, t) for i, own, t in rows if own == g and t.split()]:
            whole, estimate = whole + t, estimate + int(len(t.split()) * 1.3)
            if estimate >= 100:
                if len(whole.split()) >= 100:
                    want.append((g, made, len(whole.split()), whole))
                    made += 1
                whole, estimate = "", 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = text.assemble_passages(spark.createDataFrame(rows, "i long, g string, t string"), "g", "i", "t", 100, 1000).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert want and sorted((r.g, r.passage, r.words, r.text) for r in got) == want


def test_order_statistics_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(stats, "ACCURACY", 100)
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 5 == 0, F.lit(7.0)).otherwise((F.col("id") * 7919 % 10_007).cast("double")).alias("v"))
    got = {r.g: r for r in stats.order_statistics(rows, "v", ["g"], {"half": (0.5, lambda n: F.floor(n / 2)), "last": (1.0, lambda n: n - 1)}).collect()}
    for g in (0, 1):
        own = sorted(7.0 if i % 5 == 0 else float(i * 7919 % 10_007) for i in range(20_000) if i % 2 == g)
        assert (got[g].half, got[g].last, got[g].n) == (own[len(own) // 2], own[-1], len(own))


def test_streams_of_hidden_states(spark):
    shape = pooling.Shape(hidden=32, head=128, rope=64)
    x = np.random.default_rng(5).normal(size=(128, 32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "pos int, hidden array<double>")
    rows = pooling.streams(df, 128, shape).collect()
    assert {s: sum(r.stream == s for r in rows) for s in ("sliding", "pool4", "pool128")} == {"sliding": 128, "pool4": 32, "pool128": 1}
    assert all(len(r.kv) == 128 and np.isfinite(r.kv).all() for r in rows)
    first = next(r.kv for r in rows if r.stream == "sliding" and r.pos == 0)
    y = x[0] @ pooling.projection_matrix(128, 32, 0).T
    assert np.allclose(first[64:], (y / np.sqrt((y * y).mean() + 1e-6))[64:])
    with pytest.raises(ValueError):
        pooling.streams(df, 100, shape)
    with pytest.raises(ValueError):
        pooling.check_length(3, 4)


def test_streams_of_a_long_sequence_equal_their_sql(spark, sf, tmp_path):
    """Positions past 65,536: the query slowed its frequencies from there on, its SQL does not."""
    first = tables.table(spark, sf, "embeddings").where("vec_id < 256")
    first.withColumn("vec_id", F.col("vec_id") + 131_072).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r)[:3]: r.value for r in queries()["three_streams"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert len(got) == (256 + 64 + 2) * 128 and got == {r[:3]: r[3] for r in con.sql(oracle_sql()["three_streams"]).fetchall()}


def test_frequencies_to_the_last_digit():
    """Four of these were a last digit off as a power of a whole array: rows of long sequences were rounded otherwise."""
    assert pooling.frequencies(64, 10_000.0) == [10_000.0 ** (-i / 32) for i in range(32)]
    assert pooling.frequencies(64, 10_000.0, 2048, 0, 16.0) == pooling.frequencies(64, 10_000.0)
    assert pooling.frequencies(64, 10_000.0, 2048, 1024, 16.0)[31] == pytest.approx(10_000.0 ** (-31 / 32) / 16)


def test_rotary_inverse(spark):
    freqs = pooling.frequencies(8, 10_000.0)
    x = np.random.default_rng(6).normal(size=16)
    v = F.array(*[F.lit(float(a)) for a in x])
    back = pooling.rotary(pooling.rotary(v, F.lit(5), freqs, 16), F.lit(5), freqs, 16, inverse=True)
    assert np.allclose(spark.range(1).select(back).first()[0], x)


def test_pools_by_partial_sums(spark):
    """Blocks spread over batches and tasks, unfinished ends, nulls and arrays of two lengths, against plain sums."""
    rng = np.random.default_rng(8)
    rows = [(g, i, rng.normal(size=6).tolist(), (rng.normal(size=6) * 300).tolist()) for g in ("a", "b") for i in range(3000 if g == "a" else 37)]
    rows[5][2][1] = None
    rows[17][3][2] = None
    rows[40] = ("a", 40, None, rows[40][3])
    rows[64] = ("a", 64, rows[64][2][:4], rows[64][3])
    df = spark.createDataFrame(rows, "g string, pos int, value array<double>, score array<double>").repartition(7)
    got = {(r.g, r.block): r.pooled for r in pooling.pool(df, 16, ["g"]).collect()}

    def plain(own: list[tuple], at: int) -> float:
        pairs = [(v[at] if at < len(v) else None, s[at]) for v, s in own if s[at] is not None]
        top = max(s for _, s in pairs)
        return sum(v * np.exp(s - top) for v, s in pairs if v is not None) / sum(np.exp(s - top) for _, s in pairs)

    want = {}
    for g in ("a", "b"):
        for block in range(188):
            own = [(v, s) for k, pos, v, s in rows if k == g and pos // 16 == block and v is not None]
            if len(own) == 16:
                want[g, block] = [plain(own, at) for at in range(6)]
    assert got.keys() == want.keys() and ("a", 2) not in want and ("b", 2) not in want
    assert all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)


def test_vectors_are_normed_and_turned_once(spark):
    """The work for a vector grows with its width: wide vectors took the square of it for the norm, and more to turn."""
    rows = spark.range(1600).select("id", F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda i: F.sin(F.col("id") + i)).alias("x"))
    begun = time.monotonic()
    got = rows.select("id", pooling.rotary(pooling.rms_norm(F.col("x"), 1024), F.col("id"), pooling.frequencies(512, 10_000.0), 1024).alias("y")).collect()
    assert time.monotonic() - begun < 25
    x = np.sin(7 + np.arange(1, 1025))
    u = x / np.sqrt((x * x).mean() + 1e-6)
    angle = 7 * np.array(pooling.frequencies(512, 10_000.0))
    a, b = u[512::2], u[513::2]
    turned = np.stack([a * np.cos(angle) - b * np.sin(angle), a * np.sin(angle) + b * np.cos(angle)], 1).reshape(-1)
    assert np.allclose(next(r.y for r in got if r.id == 7), np.concatenate([u[:512], turned]), rtol=1e-12, atol=1e-12)


def test_passages_reach_over_pieces(spark, monkeypatch):
    """Groups cut in pieces of eight rows, passages over several of them, words that meet between rows, short ends."""
    monkeypatch.setattr(text, "PIECE", 3)
    rng = np.random.default_rng(12)
    rows, want = [], []
    for g in ("a", "b", "c"):
        whole, n, estimate, made = "", 0, 0, 0
        for i in range({"a": 700, "b": 9, "c": 150}[g]):
            size = int(rng.integers(1, 40 if g == "a" else 6))
            own = rng.choice(["", " "]) + " ".join(["w"] * size) + rng.choice(["", "\n"])
            rows.append((i, g, own))
            whole, n, estimate = whole + own, n + 1, estimate + math.floor(size * 1.3)
            if estimate >= 100:
                if len(whole.split()) >= 100:
                    want.append((g, made, n, len(whole.split()), whole))
                    made += 1
                whole, n, estimate = "", 0, 0
    got = text.assemble_passages(spark.createDataFrame(rows, "i long, g string, t string").repartition(5), "g", "i", "t", 100, 1000)
    assert want and sorted(tuple(r) for r in got.select("g", "passage", "rows", "words", "text").collect()) == sorted(want)


def test_passages_keep_texts_out_of_group_windows(spark):
    """No task gets the texts of a group: they are dealt out by row, then by passage."""
    docs = spark.range(50).select("id", F.lit("en").alias("g"), F.lit("a b c").alias("t"))
    plan = text.assemble_passages(docs, "g", "id", "t", 4, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
