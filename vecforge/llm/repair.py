"""Token-id shards compressed by Re-Pair grammars, with random access.

Documents are sorted by id, encoded, and cut into shards of about ``SHARD_TOKENS`` ids. In each shard the most
frequent neighbouring pairs are replaced by nonterminals, round after round, until no pair occurs ``LEAST`` times
without overlapping itself; a pair never reaches across the end of a document. One round replaces every pair where no
more frequent one overlaps it, so the most frequent pair always goes first where pairs compete. A shard stores its
rules, the expansion length of each rule, the symbols, and where each document starts, so one document is decoded
without touching the others. ``LEAST`` is a parameter of the grammar: a rule takes twelve bytes, an occurrence saves
two or four.

File format: Parquet rows (shard, first id, documents, tokens, payload). The payload is little-endian: five uint32
(magic, documents, rules, symbols, bytes in a symbol), then document ids int64, first symbol of each document uint32
and one past the last, ids in each document uint32, left and right side of each rule uint32, expansion length of each
rule uint32, and the symbols. Symbols below ``base`` are token ids, ``base + r`` is rule r.

Defined results: a null text counts as empty and holds just the end id; rows with a null id are left out; repeated
rows are stored as often as they come, ties of the id in the order of the text's hash; an empty table gives an empty
table of shards; a document longer than a shard fills one by itself; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecforge.llm.common import n_partitions, record_batch, table_path
from vecforge.llm.tokens import encoder, gather

SHARD_TOKENS = 1 << 20
MAGIC = 0x52505231
END = 2
LEAST = 48


def _among(code: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``code`` of the values ``wanted``, which are sorted; their places in ``wanted``)."""
    bits = code.dtype.itemsize * 8

    def bucket(x: np.ndarray) -> np.ndarray:
        return ((x * x.dtype.type(0x9E3779B1)) >> x.dtype.type(bits - 17)).astype(np.intp)

    maybe = np.zeros(1 << 17, bool)
    maybe[bucket(wanted)] = True
    at = np.flatnonzero(maybe[bucket(code)])
    place = np.searchsorted(wanted, code[at])
    same = wanted[np.minimum(place, len(wanted) - 1)] == code[at]
    return at[same], place[same]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document end after each symbol, rules) of one shard; ``ends`` marks the last id of each document.

    Counts only fall, but for pairs with a new symbol: after the first round, only those and the occurrences that a
    more frequent pair kept from being replaced are counted again, exactly."""
    symbols, last, top = ids.astype(np.uint32), ends.copy(), base
    rules: list[np.ndarray] = []
    open_ = np.flatnonzero(~last[:-1])  # where a pair begins that may be frequent
    while len(open_) >= least:
        kind, half = (np.uint32, 16) if top <= 1 << 16 else (np.uint64, 32)
        code = (symbols[open_].astype(kind) << kind(half)) | symbols[open_ + 1].astype(kind)
        values, counts = np.unique(code, return_counts=True)
        values = values[counts >= least]
        if not len(values):
            break
        hit, which = _among(code, values)
        at = open_[hit]
        beside = np.diff(at) == 1
        # a pair of equal symbols overlaps itself: of neighbouring occurrences every other one counts
        begins = np.concatenate([[True], ~beside | (which[1:] != which[:-1])])
        place = np.arange(len(at))
        apart = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        counts = np.bincount(which[apart], minlength=len(values))
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        own = np.where(counts >= least, rank, len(values))[which]
        takes = apart & (own < len(values))
        takes[1:] &= ~beside | (own[1:] <= own[:-1])
        takes[:-1] &= ~beside | (own[:-1] <= own[1:])
        made = np.bincount(which[takes], minlength=len(values)) >= least
        takes &= made[which]
        if not takes.any():  # what is left overlaps itself
            break
        new = np.flatnonzero(made)
        number = np.zeros(len(values), np.uint32)
        number[new[np.argsort(rank[new])]] = top + np.arange(len(new), dtype=np.uint32)
        pairs = values[new[np.argsort(rank[new])]]
        rules.append(np.stack([pairs >> kind(half), pairs & kind((1 << half) - 1)], 1).astype(np.uint32))
        where = at[takes]
        symbols[where] = number[which[takes]]
        last[where] = last[where + 1]
        stay = np.ones(len(symbols), bool)
        stay[where + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[where] = True
        again = at[(own < len(values)) & ~takes]
        moved = np.cumsum(stay) - 1
        again = moved[again[stay[again] & stay[again + 1] & ~fresh[again] & ~fresh[again + 1]]]
        symbols, last, top = symbols[stay], last[stay], top + len(new)
        where = moved[where]
        fresh = np.zeros(len(symbols), bool)
        fresh[again] = fresh[where] = fresh[where[where > 0] - 1] = True
        open_ = np.flatnonzero(fresh[:-1] & ~last[:-1])
    return symbols, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def write_shard(doc_ids: list[int], docs: list[np.ndarray], base: int) -> bytes:
    n = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(n) - 1] = True
    symbols, last, rules = compress(ids, ends, base)
    first = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u4")
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = struct.pack("<5I", MAGIC, len(docs), len(rules), len(symbols), width)
    parts = [np.array(doc_ids, "<i8"), first, n.astype("<u4"), rules[:, 0].astype("<u4"), rules[:, 1].astype("<u4"), expansion_lengths(rules, base).astype("<u4"), symbols.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads a payload; ``document(i)`` decodes one document, ``documents()`` all of them."""

    def __init__(self, payload: bytes, base: int):
        magic, n_docs, n_rules, n_symbols, width = struct.unpack_from("<5I", payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 20
        out = []
        for dtype, n in (("<i8", n_docs), ("<u4", n_docs + 1), ("<u4", n_docs), ("<u4", n_rules), ("<u4", n_rules), ("<u4", n_rules), (f"<u{width}", n_symbols)):
            out.append(np.frombuffer(payload, dtype, n, at))
            at += out[-1].nbytes
        self.doc_ids, self.first, self.sizes, self.left, self.right, self.expanded, self.symbols = out
        self.base = base
        self._table()

    def _table(self) -> None:
        """The expansion of every rule: earlier rules are whole when later ones need them."""
        parts: list[np.ndarray] = []
        for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
            parts.append(np.concatenate([parts[s - self.base] if s >= self.base else np.array([s], np.uint32) for s in (a, b)]))
        self.flat = np.concatenate([np.arange(self.base, dtype=np.uint32), *parts])
        self.lengths = np.concatenate([np.ones(self.base, np.int64), self.expanded.astype(np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[symbols], self.lengths[symbols])

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.first[i] : self.first[i + 1]])

    def documents(self) -> Iterator[np.ndarray]:
        ids = self._expand(self.symbols)
        at = 0
        for n in self.sizes.tolist():
            yield ids[at : at + n]
            at += n


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, keep_blank: bool = False, end: int = END, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all rows with an id and write their shards under ``path``; shard numbers rise with the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keep_blank)
        ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def shard():
            return record_batch(first_id=pa.array([ids[0]], pa.int64()), documents=pa.array([len(ids)], pa.int64()), tokens=pa.array([size], pa.int64()), payload=pa.array([write_shard(ids, held, vocabulary)], pa.binary()))

        for b in batches:
            for i, own in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                if held and size + len(own) + 1 > shard_tokens:
                    yield shard()
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(np.append(own, own.dtype.type(end)))
                size += len(own) + 1
        if held:
            yield shard()

    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows = own.repartitionByRange(n_partitions(spark), "id").sortWithinPartitions("id", F.xxhash64("text"))
    shards = rows.mapInArrow(run, "first_id long, documents long, tokens long, payload binary")
    shards.withColumn("shard", F.monotonically_increasing_id()).write.parquet(path)


def read(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """(id, start, n_tokens, ids): every stored document with the ids of all documents before it counted."""
    return _read(spark, path, vocabulary, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_checksums(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """As ``read``, with the unsigned crc32 of the ids as little-endian 32-bit integers in their place."""
    return _read(spark, path, vocabulary, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, vocabulary: int, column: str, value, kind: pa.DataType) -> DataFrame:
    schema = "first_id long, documents long, tokens long, payload binary, shard long"
    shards = spark.read.schema(schema).parquet(path)
    meta = shards.select("shard", "tokens", F.shiftright("shard", 33).alias("part"))
    # ids before each partition: one number for each partition on the driver; before each shard within it: a window
    sums = sorted((r[0], r[1]) for r in meta.groupBy("part").agg(F.sum("tokens")).collect())
    before = list(zip([p for p, _ in sums], accumulate([n for _, n in sums], initial=0), strict=False))
    small = F.broadcast(spark.createDataFrame(before, "part long, base long"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = meta.withColumn("within", within).join(small, "part").select("shard", (F.col("base") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(payload, vocabulary)
                n = shard.sizes.astype(np.int64)
                yield record_batch(
                    shard=np.full(len(n), number, np.int64), id=shard.doc_ids, at=np.cumsum(n) - n, n_tokens=n, value=pa.array([value(ids) for ids in shard.documents()], kind)
                )

    name, type_ = column.split()
    out = shards.select("shard", "payload").mapInArrow(run, f"shard long, id long, at long, n_tokens long, value {type_}")
    return out.join(starts, "shard").select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.col("value").alias(name))


def stored_tokens(docs: DataFrame, tokenizer: str, vocabulary: int, **options) -> str:
    """Write the shards of ``docs`` to a new folder among the shared ones; returns its path."""
    path = table_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, vocabulary, **options)
    return path
