"""Nearest neighbours by inner product through multi-index hashing.

A centre is taken from the rows, which shifts all inner products with a query alike. What is left is scaled into one
ball and given one more coordinate that makes the lengths equal, which turns the largest inner product into the
smallest angle; the codes and the radius both take that angle, and no further mean is subtracted. Two learned rotations give codes of up to 128 bits, cut into
substrings of eight. Rows are indexed in blocks of ``BLOCK``: for each substring, a bitmap of rows for each value.
A query probes values at a growing distance; with m substrings, probing distance s finds every code within
m(s+1)-1 bits (pigeonhole). Codes within the radius are reranked with the original vectors in double precision. The
search of a block ends when the radius covers the angle of the k-th best so far by a margin in standard deviations:
``MARGIN``, or what holds the share ``HELD`` of the true neighbours of sampled queries, if that is more.
The ``FIRST`` closest codes are always reranked, so a block gives k neighbours wherever it has as many.

Queries meet blocks as rows (block of vectors, block of queries); each such row gives k neighbours a query at most.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither do
those whose length differs from the fitted one; rows with a null id are left out; a row with the query's id is never
its neighbour; repeated rows are separate candidates; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.llm import itq
from vecforge.llm.common import popcount, record_batch, stored

K = 20
BITS = 64
SEEDS = (3, 5)
BLOCK = 16_384
QUERIES = 512
FIRST = 256
MARGIN = 1.6
HELD = 0.98
ASKED = 256
#: For each distance, the values that differ from zero by so many of eight bits.
_MASKS = [np.array([sum(1 << i for i in c) for c in combinations(range(8), s)], np.int64) for s in range(9)]


class Index:
    """Bitmaps of the rows of one block by substring value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # rows x words
        parts = codes.view(np.uint8).reshape(len(codes), -1)
        self.bits = parts.shape[1] * 8
        self.first = np.arange(parts.shape[1])[:, None] * 256
        maps = np.zeros((parts.shape[1] * 256, -(-len(codes) // 8) * 8), bool)
        maps[parts + self.first[:, 0], np.arange(len(codes))[:, None]] = True
        self.maps = np.packbits(maps, axis=1, bitorder="little")

    def within(self, code: np.ndarray):
        """For s = 0, 1, ...: the radius covered, the rows within it, and their distances."""
        parts = code.view(np.uint8).astype(np.int64)[:, None]
        found = np.zeros(self.maps.shape[1], np.uint8)
        for s, masks in enumerate(_MASKS):
            found |= np.bitwise_or.reduce(self.maps[((parts ^ masks) + self.first).ravel()], axis=0)
            rows = np.flatnonzero(np.unpackbits(found, bitorder="little"))
            near = self.codes[rows]
            distance = np.zeros(len(rows), np.int64)
            for word in range(self.codes.shape[1]):
                distance += popcount(near[:, word] ^ code[word])
            radius = min(len(parts) * (s + 1) - 1, self.bits)
            inside = distance <= radius
            yield radius, rows[inside], distance[inside]


def needed(cosine: float | np.ndarray, bits: int, margin: float):
    """The radius that holds a neighbour at this angle, but for a chance given by ``margin``."""
    p = np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    return bits * p + margin * np.sqrt(bits * p * (1 - p))


def _pack(size: int):
    """Rows in packs of ``size``: ids as int64, vectors as doubles, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vecs: list[bytes] = []

        def pack():
            return record_batch(ids=pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), vecs=pa.array([b"".join(vecs)], pa.binary()))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield pack()
                    ids, vecs = [], []
        if ids:
            yield pack()

    return run


def lifted(x: np.ndarray, centre: np.ndarray, longest: float) -> np.ndarray:
    """Rows in the ball, with the coordinate that makes their lengths one."""
    z = (x - centre) / longest
    return np.hstack([z, np.sqrt(np.maximum(1 - (z * z).sum(axis=1, keepdims=True), 0))])


def _coder(tables, centre: np.ndarray, longest: float):
    def coded(x: np.ndarray, row_side: bool) -> np.ndarray:
        z = lifted(x, centre, longest) if row_side else np.hstack([itq.unit(x), np.zeros((len(x), 1))])
        return np.stack([itq.codes(z, t) for t in tables], axis=1)

    return coded


def measured_margin(x: np.ndarray, tables, centre: np.ndarray, longest: float, k: int) -> float:
    """The margin that the codes of sampled rows ``x`` ask for: rotations fit the rows, and queries may lie along few axes."""
    if len(x) < 2:
        return MARGIN
    coded = _coder(tables, centre, longest)
    rows, bits, ratios = coded(x, True), len(tables) * 64, []
    asked = np.unique(np.linspace(0, len(x) - 1, ASKED).astype(int))
    for q, code in zip(asked, coded(x[asked], False), strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score)[: min(k, len(x) - 1)]
        cosine = (score[best] - centre @ x[q]) / (np.linalg.norm(x[q]) * longest)
        middle = needed(cosine, bits, 0.0)
        ratios.append((popcount(rows[best] ^ code).sum(axis=1) - middle) / np.maximum(needed(cosine, bits, 1.0) - middle, 1e-9))
    return max(MARGIN, float(np.quantile(np.concatenate(ratios), HELD)))


def _search(tables, dims: int, centre: np.ndarray, longest: float, k: int, margin: float):
    first, coded = max(FIRST, k), _coder(tables, centre, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, x, ids = None, None, None, None
        for b in batches:
            for block, raw_ids, raw_x, query_ids, raw_q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != last:
                    ids, x = np.frombuffer(raw_ids, "<i8"), np.frombuffer(raw_x, "<f8").reshape(-1, dims)
                    index, last = Index(coded(x, True)), block
                qids, q = np.frombuffer(query_ids, "<i8"), np.frombuffer(raw_q, "<f8").reshape(-1, dims)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for qid, vector, code in zip(qids, q, coded(q, False), strict=True):
                    scale, shift = np.linalg.norm(vector) * longest, centre @ vector
                    for radius, rows, distance in index.within(code):
                        other = ids[rows] != qid
                        rows, distance = rows[other], distance[other]
                        if len(rows) < k and radius < index.bits:
                            continue
                        if len(rows) > first:  # the closest codes tell how far it is worth looking
                            close = np.argpartition(distance, first)[:first]
                            bound = np.partition((x[rows[close]] * vector).sum(axis=1), first - k)[first - k]
                            worth = distance <= needed((bound - shift) / scale, index.bits, margin)
                            worth[close] = True
                            rows = rows[worth]
                        score = (x[rows] * vector).sum(axis=1)
                        best = np.lexsort((ids[rows], -score))[:k]
                        if radius >= index.bits or radius >= needed((score[best[-1]] - shift) / scale, index.bits, margin):
                            break
                    out.append((np.full(len(best), qid), ids[rows[best]], score[best]))
                yield record_batch(**{n: np.concatenate(c) for n, c in zip(("query_id", "id", "score"), zip(*out, strict=True), strict=True)})

    return run


def nearest(df: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, id, score): the k rows of largest inner product for each row that ``queries`` selects.

    ``queries`` is a condition on the column ``id``."""
    spark = df.sparkSession
    vecs = stored(itq.vectors(df, id_col, vec_col).where("digest is not null"), "ann-vectors")
    sizes = vecs.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["n"] // 8
    own = vecs.where(F.octet_length("vec") == dims * 8)

    fitted = itq.sample(own)
    centre = fitted.mean(axis=0) if len(fitted) else np.zeros(dims)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield record_batch(n=np.linalg.norm(itq.matrix(b.column(0).to_pylist()) - centre, axis=1))

    longest = max(own.select("vec").mapInArrow(lengths, "n double").agg(F.max("n")).first()[0], 1e-300)
    lift = lifted(fitted, centre, longest) if len(fitted) else np.eye(dims + 1)
    tables = [itq.learn(lift, min(BITS, dims), seed, centred=False) for seed in SEEDS]
    margin = measured_margin(fitted, tables, centre, longest, k)
    blocks = stored(own.select("id", "vec").mapInArrow(_pack(BLOCK), "ids binary, vecs binary").withColumn("block", F.monotonically_increasing_id()), "ann-blocks")
    asked = own.where(queries).select("id", "vec").mapInArrow(_pack(QUERIES), "ids binary, vecs binary")
    numbers = [r[0] for r in blocks.select("block").collect()]
    each = asked.select(F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"), F.explode(F.lit(numbers).cast("array<long>")).alias("block"))
    met = blocks.join(each, "block").select("block", "ids", "vecs", "query_ids", "query_vecs")
    found = met.mapInArrow(_search(tables, dims, centre, longest, k, margin), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
