"""Near-duplicate embeddings: rotated binary codes, multi-index Hamming tables, exact rerank.

Equal vectors are one class. Each class gets a 64-bit code by iterative quantisation in each of some tables; a code is
cut into three substrings, and each substring and its one-bit neighbours are index keys, so two classes meet if their
codes differ by at most two bits in some substring of some table (certain for up to eight bits in a table). Codes are
centred, so the angle that the threshold means there depends on the vectors: pairs exactly at the threshold are made
from sampled vectors, and tables are added until ``MET`` of them meet. If ``MOST`` tables are too few, as with vectors
that nearly all link, all classes are compared in blocks.

A pair that meets under several keys belongs to the first of them. Under each key, classes that have a pair of their
own there within the radius go on with their vectors (all of a key with more than ``BLOCK``), and the original vectors
decide. So links are verified before components are formed, each link counts once, and what a key gives are counts
for each class and a spanning forest, never a list of pairs. Keys with more than ``BLOCK`` classes are cut into
blocks, and pairs of blocks are rows of their own, dealt out by (key, block, block).

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing;
vectors of different lengths never link (the most frequent length is fitted, others get random projections of their
own); rows with a null id are left out; repeated rows are copies that link with each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm import hamming, itq
from vecforge.llm.common import connected_components, discard, n_partitions, popcount, record_batch, sorted_runs, stored

THRESHOLD = 0.95
BITS = 64
#: First bit and width of each substring.
SUBSTRINGS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 12
BLOCK = 1024
SEED = 11
MET = 0.99
MOST = 24
PROBES = 4000


def _part(codes: np.ndarray, j: int) -> np.ndarray:
    first, width = SUBSTRINGS[j]
    return codes >> np.uint64(first) & np.uint64((1 << width) - 1)


def keys(codes: np.ndarray, table: int = 0) -> list[np.ndarray]:
    """Each substring and its one-bit neighbours, with the number of table and substring above them."""
    out = []
    for j, (_, width) in enumerate(SUBSTRINGS):
        own = _part(codes, j) | np.uint64((table * len(SUBSTRINGS) + j) << 32)
        out += [own, *(own ^ np.uint64(1 << i) for i in range(width))]
    return out


def own_pairs(key: int, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, radii: list[int]) -> np.ndarray:
    """Which pairs (row i of codes ``a``, row j of ``b``) belong to this key: they meet in no earlier table or
    substring, and under no smaller key of this one. The codes have one column for each table."""
    at, value = int(key) >> 32, np.uint64(int(key) & 0xFFFFFFFF)
    table, own = divmod(at, len(SUBSTRINGS))
    mine = np.ones(len(i), bool)
    for t in range(table + 1):
        x = a[i, t] ^ b[j, t]
        parts = range(len(SUBSTRINGS) if t < table else own)
        some = np.any([popcount(_part(x, p)) <= 2 for p in parts], axis=0) if parts else np.zeros(len(i), bool)
        within = popcount(x) <= radii[t]
        mine &= ~(some & within) if t < table else ~some & within
    apart, y, z = _part(x, own), _part(a[i, table], own), _part(b[j, table], own)
    near, low = popcount(apart), apart & (~apart + np.uint64(1))
    # the keys that both have: one's own if they are equal, both if one bit apart, the two between if two bits apart
    first = np.where(near == 0, y, np.where(near == 1, np.minimum(y, z), np.minimum(y ^ low, z ^ low)))
    return mine & (near <= 2) & (first == value)


def plan(x: np.ndarray, threshold: float) -> list[tuple[tuple[np.ndarray, np.ndarray], int]] | None:
    """(code table, radius) for as many tables as let ``MET`` of the pairs at the threshold meet; none if ``MOST`` do not.

    ``x`` holds sampled unit vectors; each probe is one of them, turned by the threshold's angle in a random direction."""
    rng = np.random.default_rng(SEED)
    a = x[np.linspace(0, len(x) - 1, PROBES).astype(int)]
    side = rng.normal(size=a.shape)
    side = itq.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = threshold * a + np.sqrt(max(1 - threshold**2, 0.0)) * side
    met, out = np.zeros(len(a), bool), []
    for seed in range(SEED, SEED + MOST):
        table = itq.learn(x, min(BITS, x.shape[1]), seed)
        bits = itq.codes(a, table) ^ itq.codes(b, table)
        apart = popcount(bits)
        radius = max(MAX_BITS, int(np.ceil(apart.mean() + 2 * apart.std())))
        some = np.any([popcount(_part(bits, j)) <= 2 for j in range(len(SUBSTRINGS))], axis=0)
        met |= some & (apart <= radius)
        out.append((table, radius))
        if met.mean() >= MET:
            return out
    return None


@functools.lru_cache(maxsize=8)
def _plain(length: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """A random projection for vectors of a length that no table is fitted to."""
    return np.zeros(length), np.random.default_rng([SEED, length, table]).normal(size=(length, BITS))


def _coded(classes: DataFrame, tables: list[tuple[tuple[np.ndarray, np.ndarray], int]], dims: int) -> DataFrame:
    """(id, codes): the codes of all tables as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            out = np.zeros((len(raw), len(tables)), np.uint64)
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                x = itq.unit(itq.matrix([raw[i] for i in own]))
                out[own] = np.stack([itq.codes(x, table if size == dims else _plain(size, t)) for t, (table, _) in enumerate(tables)], axis=1)
            yield record_batch(id=b.column(0), codes=pa.array([r.tobytes() for r in out], pa.binary()))

    return classes.select("id", "vec").mapInArrow(run, "id long, codes binary")


def _codes(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)


def _met(coded: DataFrame, table: int, radius: int) -> DataFrame:
    """(key, id) of the classes that have a pair of their own, for this table, under a key; of a long run all."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                part = b.slice(at, 1 << 12)
                codes = _codes(part.column(1).to_pylist())[:, table]
                own = keys(codes, table)
                yield record_batch(key=np.concatenate(own).view(np.int64), id=pa.concat_arrays([part.column(0)] * len(own)), code=np.tile(codes, len(own)).view(np.int64))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii = [-1] * table + [radius]
        for key, block, c in sorted_runs(batches, "key", BLOCK):
            ids = c["id"]
            if not block and len(ids) < BLOCK:
                codes = c["code"].view(np.uint64)
                i, j = np.nonzero(np.triu(popcount(codes[:, None] ^ codes[None, :]) <= radius, 1))
                if not len(i):
                    continue
                wide = np.zeros((len(ids), table + 1), np.uint64)
                wide[:, table] = codes
                own = own_pairs(key, wide, wide, i, j, radii)
                ids = ids[np.unique(np.concatenate([i[own], j[own]]))]
            if len(ids):
                yield record_batch(key=np.full(len(ids), key, np.int64), id=ids)

    n = n_partitions(coded.sparkSession)
    indexed = coded.repartition(n, "id").mapInArrow(index, "key long, id long, code long")
    return stored(indexed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(members, "key long, id long"), "vector-met")


def _compare(threshold: float, radii: list[int]):
    """Counts and forests of the links of each (key, block, block); without codes all pairs are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, c in sorted_runs(batches, "pair", 1 << 62):
            ids, first, mult, raw = c["id"], c["first"].astype(bool), c["mult"], list(c["vec"])
            codes = None if c["codes"][0] is None else _codes(list(c["codes"]))
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):  # another length is another space
                g = np.flatnonzero(sizes == size)
                x = itq.unit(itq.matrix([raw[i] for i in g]))
                inside = bool(c["inside"][0])
                a, b = (g, g) if inside else (g[first[g]], g[~first[g]])
                xa, xb = (x, x) if inside else (x[first[g]], x[~first[g]])
                if not len(a) or not len(b):
                    continue
                near = xa @ xb.T >= threshold
                if inside:
                    np.fill_diagonal(near, False)
                if codes is not None and near.any():
                    i, j = np.nonzero(near)
                    near[i, j] = own_pairs(c["key"][0], codes[a], codes[b], i, j, radii)
                if not near.any():
                    continue
                if inside:
                    square, order, counts = near, a, near @ mult[a]
                else:
                    square = np.zeros((len(g), len(g)), bool)
                    square[: len(a), len(a) :] = near
                    square |= square.T
                    order, counts = np.concatenate([a, b]), np.concatenate([near @ mult[b], near.T @ mult[a]])
                member, root = hamming.forest(square)
                own, some = ids[order], np.flatnonzero(counts)
                yield record_batch(id=own[some], links=counts[some].astype(np.int64), u=pa.nulls(len(some), pa.int64()), v=pa.nulls(len(some), pa.int64()))
                yield record_batch(id=pa.nulls(len(member), pa.int64()), links=pa.nulls(len(member), pa.int64()), u=own[member], v=own[root])

    return run


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id) for each row with an id."""
    n = n_partitions(df.sparkSession)
    vecs = stored(itq.vectors(df, id_col, vec_col), "vectors")
    classes = stored(vecs.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("vec").alias("vec")), "vector-classes")
    dims = itq.usual_length(classes)
    fitted = itq.sample(classes.where(F.octet_length("vec") == dims * 8)) if dims else np.zeros((0, 1))
    tables = plan(itq.unit(fitted), threshold) if dims else []
    if tables:
        coded = stored(_coded(classes, tables, dims), "vector-codes")
        each_met = [_met(coded, t, radius) for t, (_, radius) in enumerate(tables)]
        met = functools.reduce(DataFrame.union, each_met)
        members = met.join(coded, "id").join(classes.select("id", "mult", "vec"), "id")
    else:  # nearly all vectors link, or there are none
        members = met = classes.select(F.octet_length("vec").cast("long").alias("key"), "id", F.lit(None).cast("binary").alias("codes"), "mult", "vec")
    sizes = met.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    pairs = each.select(pair.alias("pair"), "key", (F.col("block") == F.col("other")).alias("inside"), (F.col("block") <= F.col("other")).alias("first"), "id", "mult", "codes", "vec")
    compared = stored(pairs.repartition(n, "pair").sortWithinPartitions("pair", F.desc("first")).mapInArrow(_compare(threshold, [r for _, r in tables or []]), "id long, links long, u long, v long"), "vector-links")
    if tables:
        discard(coded, *each_met)
    roots = connected_components(compared.where("u is not null").select("u", "v"))
    linked = compared.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    done = classes.select("digest", "id", "mult").join(linked, "id", "left").join(roots, "id", "left")
    done = done.select("digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return vecs.select("id", "digest").join(done, "digest", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
