"""Packing documents into training sequences by the sum-of-squares rule.

Each task packs the documents of its partition as they come. Whole windows are cut off long documents; what is left
goes to the fill level h, a new window included, for which the sum over levels of N(h) squared grows least, where
N(h) counts the partly filled windows at level h in one array. That keeps the levels even, so most documents find a
window that they fill exactly. At the end of a partition, or when ``MAX_OPEN`` windows are open, the windows still
open are closed by cutting: the emptiest are poured into the gaps of the fullest, and at most one stays padded.

No row is shuffled; sequence numbers become global by adding up one count for each partition.

Defined results: a null text counts as empty and holds just the end id; rows with a null id are left out; repeated
rows are packed as often as they come, told apart by ``row``; an empty table gives an empty result; a document of
any length is cut into windows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import record_batch, stored
from vecforge.llm.tokens import encoder

WINDOW = 2048
END = 1
MAX_OPEN = 4096

#: A piece: row number, start in its document, ids.
Piece = tuple[int, int, np.ndarray]


class Packer:
    """Online packing of one stream; ``add`` and ``finish`` give windows (lists of pieces) as they close."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` on; 0 opens a window. Ties go to the fullest level."""
        last = self.window - size
        growth = self.levels[size : self.window + 1] - self.levels[: last + 1]  # at h: N(h + size) - N(h)
        growth = np.where(self.levels[: last + 1] > 0, growth, np.iinfo(np.int64).max)
        if self.levels[last] > 0:
            growth[last] = -self.levels[last]  # a full window leaves the array
        h = last - int(np.argmin(growth[::-1]))
        # opening one adds 2 N(size) + 1, moving one adds 2 growth + 2
        if growth[h] == np.iinfo(np.int64).max or 2 * growth[h] + 2 > 2 * self.levels[size] + 1:
            return 0
        return h

    def add(self, row: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        whole = len(ids) // self.window * self.window
        for i in range(0, whole, self.window):
            yield [(row, i, ids[i : i + self.window])]
        size = len(ids) - whole
        if not size:
            return
        h = self.level_for(size)
        pieces = []
        if h:
            pieces = self.at[h].pop()
            self.levels[h] -= 1
            self.open -= 1
        pieces.append((row, whole, ids[whole:].copy()))
        if h + size == self.window:
            yield pieces
            return
        self.at[h + size].append(pieces)
        self.levels[h + size] += 1
        self.open += 1
        if self.open >= self.max_open:
            yield from self.finish()

    def finish(self) -> Iterator[list[Piece]]:
        """Close all open windows by pouring the emptiest into the gaps of the fullest."""
        left = [(h, pieces) for h in range(self.window, 0, -1) for pieces in self.at[h]]
        loose: list[Piece] = []  # pieces of the window being poured out
        low = len(left) - 1
        i = 0
        while i <= low or loose:
            fill, pieces = left[i] if i <= low else (0, [])
            i += 1
            while fill < self.window and (loose or i <= low):
                if not loose:
                    loose = left[low][1][::-1]
                    low -= 1
                row, start, ids = loose.pop()
                room = self.window - fill
                pieces.append((row, start, ids[:room]))
                fill += min(room, len(ids))
                if len(ids) > room:
                    loose.append((row, start + room, ids[room:]))
            yield pieces
        self.levels[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.open = 0


def _pieces(windows: Iterable[list[Piece]], doc_ids: list[int], sizes: list[int], with_ids: bool, begin: int = 0) -> tuple[pa.RecordBatch, int]:
    out: dict[str, list] = {n: [] for n in ("id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids")}
    n = begin
    for window in windows:
        at = 0
        for row, start, ids in window:
            raw = ids.astype("<u4").tobytes()
            for name, value in zip(out, (doc_ids[row], row, start, len(ids), zlib.crc32(raw), sizes[row], n, at, raw if with_ids else None), strict=True):
                out[name].append(value)
            at += len(ids)
        n += 1
    kinds = {name: pa.binary() if name == "ids" else pa.int64() for name in out}
    return record_batch(**{k: pa.array(v, kinds[k]) for k, v in out.items()}), n


def packed(docs: DataFrame, tokenizer: str, keep_blank: bool = True, end: int = END, window: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``row`` numbers the documents, so that repeated ids stay apart; ids are little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keep_blank)
        packer = Packer(window)
        doc_ids: list[int] = []
        sizes: list[int] = []
        done: list[list[Piece]] = []
        n = 0
        for b in batches:
            for i, own in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                ids = np.append(own, own.dtype.type(end))
                doc_ids.append(i)
                sizes.append(len(ids))
                done.extend(packer.add(len(sizes) - 1, ids))
                if len(done) >= 1024:
                    batch, n = _pieces(done, doc_ids, sizes, with_ids, n)
                    yield batch
                    done = []
        batch, n = _pieces([*done, *packer.finish()], doc_ids, sizes, with_ids, n)
        yield batch

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    pieces = own.mapInArrow(run, "id long, row long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, ids binary")
    kept = stored(pieces.withColumn("part", F.spark_partition_id()), "packed")
    tops = sorted((r[0], r[1], r[2]) for r in kept.groupBy("part").agg(F.max("sequence") + 1, F.max("row") + 1).collect())
    firsts = zip(accumulate([s for _, s, _ in tops], initial=0), accumulate([r for *_, r in tops], initial=0), strict=True)
    table = [(p, s, r) for (p, *_), (s, r) in zip(tops, firsts, strict=False)]
    small = F.broadcast(docs.sparkSession.createDataFrame(table, "part int, first_sequence long, first_row long"))
    out = kept.join(small, "part")
    columns = ["id", (F.col("row") + F.col("first_row")).alias("row"), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("first_sequence")).alias("sequence_id"), "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))
