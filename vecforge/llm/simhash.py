"""SimHash near-duplicates by deletion-variant signatures.

The 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints at most three bits apart
differ by at most one bit in one of them, so they share a segment in which one bit is a wildcard. Every
distinct fingerprint is indexed under its 64 one-wildcard variants, equal keys meet in a shuffle, and each
meeting is verified on all 64 bits.

Skew: copies share a fingerprint and are one row before the index is built. Keys with more than ``hamming.BLOCK``
distinct fingerprints are cut into blocks, and pairs of blocks are dealt out to tasks of their own.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other;
rows with a null id are left out; repeated rows come back as often as they came; columns other than the id and
the text are ignored; an empty table gives an empty result. ``deduplicated`` keeps of each group the row with the
smallest id, of rows with that id the one with the smallest hash of the row; of equal rows one stays, and rows that
share an id but are not linked stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.llm import hamming
from vecforge.llm.common import each_text, record_batch, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENT = 32
#: For each byte value its eight bits, one in each byte of a 64-bit word.
_LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8).view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        lanes = _LANES[part.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, unsigned."""
    words = text.lower().split()  # for bytes, both know A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in rows), np.uint64)
    return int(np.packbits(2 * _bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(id, fp) for each row with an id, and ``row`` if given, a long; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in each_text(b.column(0))], np.uint64).view(np.int64)
            yield record_batch(fp=fps, id=b.column(1), row=b.column(2))

    own = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), (F.lit(0).cast("long") if row is None else row).alias("row"))
    out = own.where("id is not null").mapInArrow(run, "fp long, id long, row long")
    return out.select("id", "fp", "row") if row is not None else out.select("id", "fp")


def variants(fps: np.ndarray) -> list[np.ndarray]:
    """The index keys of fingerprints: each segment with each of its bits as a wildcard."""
    low = np.uint64((1 << SEGMENT) - 1)
    return [(fps >> np.uint64(s * SEGMENT)) & low & ~np.uint64(1 << i) | np.uint64((s * SEGMENT + i) << 32) for s in range(64 // SEGMENT) for i in range(SEGMENT)]


def _roots(fps: DataFrame) -> DataFrame:
    """(fp, root) of each fingerprint; ``root`` names the group."""
    roots = hamming.components(fps.select(F.col("fp").alias("code")), variants, MAX_BITS).select(F.col("id").alias("fp"), "root")
    return fps.select("fp").distinct().join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id) for each row with an id: the smallest id reachable over links, itself included."""
    fps = stored(fingerprints(docs, id_col, text_col), "simhash")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("low")).join(_roots(fps), "fp"), "simhash-classes")
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(classes.join(lows, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def as_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group; all columns stay."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    fps = stored(fingerprints(docs, id_col, text_col, row), "simhash")
    first = fps.groupBy("fp").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("n"))
    keep = stored(first.join(_roots(fps), "fp").groupBy("root").agg(F.min("first").alias("k"), F.max("n").alias("n")).select("k.*", "n"), "simhash-kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).cast("long").alias("id"), row.alias("row"))
    kept = own.join(keep, ["id", "row"], "left_semi")
    # equal rows carry the same id and hash
    again = stored(fps.groupBy("id", "row").count().where("count > 1").join(keep, ["id", "row"], "left_semi").select("id", "row"), "simhash-repeated")
    if again.isEmpty():
        return kept.select("whole.*")
    single = kept.join(again, ["id", "row"], "left_anti")
    return single.union(kept.join(again, ["id", "row"], "left_semi").dropDuplicates(["id", "row"])).select("whole.*")
