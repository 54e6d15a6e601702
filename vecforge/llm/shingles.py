"""Near copies by exact Jaccard similarity of word shingles; MinHash bands find the candidates.

A text is the set of its distinct runs of ``SHINGLE`` words. Its sketch is the ``BANDS`` x ``ROWS`` smallest values
under as many hash functions, 16 bits of each; texts that agree on a whole band meet. A pair at similarity s meets in
some band with chance 1 - (1 - s^ROWS)^BANDS: 0.9998 at 0.8. Of the pairs that meet, those go on that agree on at
least ``AGREE`` of the 64 values, which a pair at 0.8 misses with a chance of 1e-6. Every link is then decided on the
sets themselves.

A pair belongs to the first band that it shares. In a band's group of at most ``BLOCK`` texts, the texts that have a
pair of their own there go on with their sets, and the sets of a group are compared in one task until its texts are
joined or all its pairs are decided. Larger groups are counted beforehand: their texts are compared with the one of
smallest id, which settles groups of copies; then blocks of sketches, dealt out by (key, block, block), give the pairs
that agree and are not joined, and those are decided one by one. So no pair that meets is left out unless other links
join it already, and no task holds a large group.

Defined results: words and their folding are those of the fingerprints; a text of fewer words than a shingle is one
shingle, a text without words links with nothing; rows with a null id are left out; of rows that share an id each
text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import connected_components, discard, each_text, n_partitions, record_batch, sorted_runs, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
AGREE = 36
BLOCK = 1024
#: Texts of a large group in one row, about.
PACK = 1024
#: Bytes of sets in one batch.
BATCH = 4 << 20
SEED = 42
_FACTORS, _SHIFTS = np.random.default_rng(SEED).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in rows), np.uint64))


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each hash function."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1 << 12):
        low = np.minimum(low, (hashes[i : i + (1 << 12), None] * _FACTORS + _SHIFTS).min(axis=0))
    return low


def sketch(hashes: np.ndarray) -> np.ndarray:
    return (smallest(hashes) >> np.uint64(20)).astype("<u2")


def band_keys(own: np.ndarray) -> list[int]:
    """One key for each band of a sketch, signed."""
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), n) for n, b in enumerate(own.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of each text with words."""
    for b in batches:
        ids, out = [], []
        for i, t in zip(b.column(0).to_pylist(), each_text(b.column(1)), strict=True):
            if len(h := shingle_hashes(t)):
                ids.append(i)
                out.append(sketch(h).tobytes())
        yield record_batch(id=pa.array(ids, pa.int64()), sketch=pa.array(out, pa.binary()))


def _sketches(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<u2").reshape(-1, BANDS * ROWS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1 << 12):
            part = b.slice(at, 1 << 12)
            keys = np.array([band_keys(x) for x in _sketches(part.column(1).to_pylist())], np.int64).reshape(-1, BANDS)
            for band in range(BANDS):
                yield record_batch(key=keys[:, band].copy(), band=np.full(len(keys), band, np.int32), id=part.column(0), sketch=part.column(1))


def own_pairs(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of a group's sketches that agree and share no band before this one."""
    pairs = [np.zeros((0, 2), np.int64)]
    for i in range(len(x) - 1):
        same = x[i + 1 :] == x[i]
        j = np.flatnonzero(same.sum(axis=1) >= AGREE)
        earlier = same[j].reshape(len(j), BANDS, ROWS)[:, :band].all(axis=2).any(axis=1)
        j = j[~earlier] + i + 1
        pairs.append(np.stack([np.full(len(j), i), j], axis=1))
    return tuple(np.concatenate(pairs).T)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, the texts that have a pair of their own."""
    for key, _, c in sorted_runs(batches, "key", BLOCK):
        if len(c["id"]) > 1:
            i, j = own_pairs(_sketches(list(c["sketch"])), int(c["band"][0]))
            if len(i):
                ids = c["id"][np.unique(np.concatenate([i, j]))]
                yield record_batch(key=np.full(len(ids), key, np.int64), band=np.full(len(ids), c["band"][0], np.int32), id=ids)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Do two sets share ``SIMILARITY`` of all that is in either?"""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that join the texts of each group."""
    for _, _, c in sorted_runs(batches, "key", BLOCK):
        i, j = own_pairs(_sketches(list(c["sketch"])), int(c["band"][0]))
        sets = [np.frombuffer(h, np.uint64) for h in c["hashes"]]
        root, out = list(range(len(sets))), []

        def find(k: int, root: list[int] = root) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if (p := find(a)) != (q := find(b)) and alike(sets[a], sets[b]):
                root[max(p, q)] = min(p, q)
                out.append((c["id"][a], c["id"][b]))
        u, v = zip(*out, strict=True) if out else ((), ())
        yield record_batch(u=pa.array(u, pa.int64()), v=pa.array(v, pa.int64()))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (_sketches(c.to_pylist()) for c in b.columns[2:4])
        own = b.filter(pa.array((x == y).sum(axis=1) >= AGREE, pa.bool_()))
        yield record_batch(u=own.column(0), v=own.column(1))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sets, size = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), each_text(b.column(1)), strict=True):
            ids.append(i)
            sets.append(shingle_hashes(t).tobytes())
            size += len(sets[-1])
            if size > BATCH:
                yield record_batch(id=pa.array(ids, pa.int64()), hashes=pa.array(sets, pa.binary()))
                ids, sets, size = [], [], 0
        yield record_batch(id=pa.array(ids, pa.int64()), hashes=pa.array(sets, pa.binary()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [alike(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair)) for pair in zip(b.column(2), b.column(3), strict=True)]
        own = b.filter(pa.array(same, pa.bool_()))
        yield record_batch(u=own.column(0), v=own.column(1))


def _links(texts: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def beside(own: DataFrame, table: DataFrame, column: str) -> DataFrame:
        u, v = (table.select(F.col("id").alias(i), F.col(column).alias(c)) for i, c in (("u", "x"), ("v", "y")))
        return own.join(u, "u").join(v, "v").select("u", "v", "x", "y")

    close = stored(beside(pairs, sketches, "sketch").mapInArrow(_agreeing, "u long, v long").distinct(), "shingle-close")
    sets = _set_table(texts, close.select(F.explode(F.array("u", "v")).alias("id")))
    out = stored(beside(close, sets, "hashes").mapInArrow(_similar, "u long, v long").distinct(), "shingle-links")
    discard(sets, close)
    return out


def _set_table(texts: DataFrame, ids: DataFrame) -> DataFrame:
    return stored(texts.join(ids.distinct(), "id", "left_semi").mapInArrow(_sets, "id long, hashes binary"), "shingle-sets")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root) for each id with a link: the smallest id reachable over pairs of at least ``SIMILARITY``."""
    n = n_partitions(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    sketches = stored(texts.mapInArrow(_indexed, "id long, sketch binary"), "shingle-sketches")
    rows = sketches.mapInArrow(_banded, "key long, band int, id long, sketch binary")
    hot = stored(rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key"), "shingle-hot")
    crowded = not hot.isEmpty()
    cool = rows.join(hot, "key", "left_anti") if crowded else rows
    met = stored(cool.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_members, "key long, band int, id long"), "shingle-met")
    sets = _set_table(texts, met.select("id"))
    whole = met.join(sketches, "id").join(sets, "id").select("key", "band", "id", "sketch", "hashes")
    links = stored(whole.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_joined, "u long, v long"), "shingle-links")
    discard(met, sets)
    if not crowded:
        return connected_components(links)
    large = stored(rows.join(hot, "key").distinct(), "shingle-large")
    return connected_components(links.union(_large_links(large, texts, sketches, links)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, c in sorted_runs(batches, "dealt", 1 << 62):
        binary = {n: pa.array([v], pa.binary()) for n, v in (("ids", c["id"].tobytes()), ("roots", c["root"].tobytes()), ("sketches", b"".join(c["sketch"])))}
        yield record_batch(key=c["key"][:1], band=c["band"][:1], block=c["block"][:1], blocks=c["blocks"][:1], **binary)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a block, or of two, that agree and are not joined."""
    for _, _, c in sorted_runs(batches, "dealt", 1 << 62):
        ids, roots = (np.frombuffer(b"".join(c[n]), np.int64) for n in ("ids", "roots"))
        i, j = own_pairs(_sketches(list(c["sketches"])), int(c["band"][0]))
        new = roots[i] != roots[j]
        i, j = ids[i[new]], ids[j[new]]
        yield record_batch(u=np.minimum(i, j), v=np.maximum(i, j))


def _large_links(rows: DataFrame, texts: DataFrame, sketches: DataFrame, known: DataFrame) -> DataFrame:
    """Links that join, with the known ones, all linked texts of large groups: rows (key, band, id, sketch)."""
    n = n_partitions(rows.sparkSession)
    first = rows.groupBy("key").agg(F.min("id").alias("u"), F.count("*").alias("n"))
    star = stored(rows.join(first, "key").where("u < id").select("u", F.col("id").alias("v")).distinct(), "shingle-star")
    links = _links(texts, sketches, star)
    roots = connected_components(links.union(known))
    placed = rows.join(first.select("key", F.ceil(F.col("n") / PACK).cast("int").alias("blocks")), "key").join(roots, "id", "left")
    placed = placed.select("key", "band", "id", "sketch", F.coalesce("root", "id").alias("root"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    dealt = placed.withColumn("dealt", F.xxhash64("key", "block")).repartition(n, "dealt").sortWithinPartitions("dealt")
    packed = stored(dealt.mapInArrow(_packed, "key long, band int, block int, blocks int, ids binary, roots binary, sketches binary"), "shingle-packed")
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = each.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("dealt"), "band", "ids", "roots", "sketches")
    close = stored(pair.repartition(n, "dealt").sortWithinPartitions("dealt").mapInArrow(_apart, "u long, v long").distinct(), "shingle-apart")
    out = links.union(_links(texts, sketches, close))
    discard(star, packed)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of linked texts, the one with the smallest id; all columns stay."""
    gone = components(docs, id_col, text_col).where("id <> root").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
