"""Exact removal of substrings of ``LENGTH`` bytes that occur more than once, by suffix sorting.

Sorting every suffix of a corpus moves many times its size, so text that cannot repeat is set aside first, without
losing any repeat:

1. Each window of ``LENGTH`` bytes has a minimizer: the ``K``-byte stretch in it with the smallest hash, leftmost on
   ties. Equal windows have equal minimizers at equal offsets. Neighbouring windows with one minimizer are a run; a
   run whose minimizer occurs once is unique.
2. The runs that are left, and whole texts, are strings of two names; equal ones of a task are one string with a
   count. Their windows repeat if the suffix from the first name does: where a suffix repeats for L bytes, the one i
   bytes further on repeats for L - i.
3. Runs with a text of their own whose minimizer has other texts are cut, with these, into units of ``UNIT`` windows at
   fixed offsets from the minimizer. The windows of a unit share a core of ``LENGTH - UNIT + 1`` bytes; a core that
   occurs once is unique. Units are strings of letters, left bytes, minimizer, core, right bytes, so that a window is
   ``UNIT + 1`` letters; if a core has just one string, its two names are enough.
4. The suffixes of all these strings are sorted by the prefix tripling of ``suffix_array``: by the names of triples,
   then by three names. What occurs elsewhere has an equal neighbour in that order, or a count; nothing else marks it.

Skew: copies of one text or run within a task are sent once with a count, so that a hot one has a row for each task;
counting is pre-aggregated; joins on minimizers are ordinary joins that Spark splits when a key is hot. Documents are
known by a 128-bit digest and their length, runs by two 64-bit hashes, cores by 63 bits beside their minimizer (the sort
takes 62 bits of a first name and 63 of a second); equality by them is taken for equality of the text.

Defined results: a null text counts as empty; a text shorter than ``LENGTH`` loses nothing; rows with a null id are
left out; repeated rows are copies of each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import discard, each_text, record_batch, stored
from vecforge.llm.suffix_array import adjacent, suffix_order

LENGTH = 200
K = 64
UNIT = 8
#: Digests of texts that a task remembers, to send copies once.
REMEMBER = 1 << 18
STRETCH = 1 << 18
#: Texts are searched for runs in blocks of about as many bytes.
BLOCK = 1 << 16
#: Runs in one batch.
BATCH = 1 << 16
#: Bytes of texts that are cut into units at once.
UNPACKED = 1 << 21
#: What a text is known by: a digest and its bytes.
DOC = ("doc", "doc2", "size")
#: Kinds of strings that are sorted, and flags in a string's id: it comes more than once, it is two names.
_TEXTS, _RUNS, _UNITS = range(3)
_MORE, _WHOLE = 8, 128
_FACTOR = 0x9E3779B1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _sliding(a: np.ndarray, width: int, of: np.ufunc = np.minimum) -> np.ndarray:
    """The smallest (or largest) of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        a = of(a[:-span], a[span:])
        span *= 2
    rest = width - span
    return of(a[: len(a) - rest], a[rest:]) if rest else a


def _hashes(text: np.ndarray) -> np.ndarray:
    """32 bits of the ``K`` (a power of two) bytes from each position, built by doubling: they choose minimizers."""
    h, factor, span = text.astype(np.uint32) + np.uint32(1), _FACTOR, 1
    while span < K:
        h = h[:-span] * np.uint32(factor) + h[span:]
        factor, span = factor * factor % (1 << 32), span * 2
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def _names(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``K`` bytes from each of some positions: minimizers are known by it."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, K)[at]).view("<u8")
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _MIX
        h ^= h >> np.uint64(31)
    return h


def _runs(joined: bytes, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, minimizer hash, minimizer position, first window, last window) of each run of windows with one minimizer
    in texts of ``LENGTH`` bytes at least that are joined; positions are those in ``joined``."""
    width = LENGTH - K + 1
    own = np.frombuffer(joined, np.uint8)
    h = _hashes(own)
    low = _sliding(h, width)
    edge = np.ones(len(low) + 1, bool)
    edge[1:-1] = low[1:] != low[:-1]
    edge[begins] = edge[begins + sizes - LENGTH + 1] = True  # windows over the end of a text are runs of their own
    edges = np.flatnonzero(edge)
    first, last = edges[:-1], edges[1:] - 1
    text = np.searchsorted(begins, first, "right") - 1
    whole = last + LENGTH <= (begins + sizes)[text]
    text, first, last = text[whole], first[whole], last[whole]
    # a run's minimizer is the first position from the run's start on with its hash
    pad = np.zeros(width - 1, low.dtype)
    where = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    value, wanted = h[where], low[first]
    i = np.searchsorted(where, first)
    while (wrong := value[i] != wanted).any():
        i = i + wrong
    at = where[i]
    done = at >= last
    out = [[text[done]], [at[done]], [first[done]], [last[done]]]
    # the same hash again within a run: the run is split where its leftmost minimizer leaves the window
    for d, j, v, a, b in zip(text[~done].tolist(), i[~done].tolist(), wanted[~done].tolist(), first[~done].tolist(), last[~done].tolist(), strict=True):
        while a <= b:
            while value[j] != v or where[j] < a:
                j += 1
            p = int(where[j])
            for column, x in zip(out, (d, p, a, min(b, p)), strict=True):
                column.append(np.array([x]))
            a = p + 1
    text, at, first, last = (np.concatenate(c) for c in out)
    return text, _names(own, at), at, first, last


def _stretches(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in stretches, each with its place, so that memory stays bounded; a stretch's edge may split a run."""
    if len(text) <= STRETCH:
        yield 0, text
        return
    for at in range(0, len(text) - LENGTH + 1, STRETCH - LENGTH + 1):
        yield at, text[at : at + STRETCH]


def runs(text: bytes) -> tuple[np.ndarray, ...]:
    """(minimizer hash, minimizer position, first window, last window) of the runs of one text."""
    parts = []
    for at, own in _stretches(text):
        _, h, p, a, z = _runs(own, np.array([0]), np.array([len(own)]))
        parts.append((h, p + at, a + at, z + at))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _digest(text: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(text)
    return both >> 64, both & (1 << 64) - 1


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two kinds of rows: the runs (h, c, text, at) of each distinct text of a task, and (text, doc, doc2, size, copies).

    ``text`` numbers the texts of a task; a text that comes again in the task is only counted."""
    names = ("h", "c", "text", "at", "doc", "doc2", "size", "copies")
    number, known = 0, {}

    def rows(**columns: np.ndarray) -> pa.RecordBatch:
        gap = pa.nulls(len(columns["text"]), pa.int64())
        return record_batch(**{n: _signed(columns[n]) if n in columns else gap for n in names})

    def found(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return rows(**dict(zip(names[:4], map(np.concatenate, out), strict=True)))

    def counted() -> pa.RecordBatch:
        doc, doc2, size, text, copies = (np.array(x, np.uint64) for x in zip(*((*key, *n) for key, n in known.items()), strict=True))
        return rows(doc=doc, doc2=doc2, size=size, text=text, copies=copies)

    def search(block: list[tuple[int, int, bytes]], out: list[list[np.ndarray]]) -> None:
        numbers, places, sizes = (np.array(x, np.int64) for x in zip(*((n, at, len(t)) for n, at, t in block), strict=True))
        joined, begins = b"".join(t for *_, t in block), np.cumsum(sizes) - sizes
        which, h, p, a, z = _runs(joined, begins, sizes)
        whole = np.fromiter((xxhash.xxh64_intdigest(joined[x:y]) for x, y in zip(a.tolist(), (z + LENGTH).tolist(), strict=True)), np.uint64, len(a))
        for column, x in zip(out, (h, whole, numbers[which], ((a + (places - begins)[which]) << 16) | ((z - a) << 8) | (p - a)), strict=True):
            column.append(x.astype(np.uint64))

    for b in batches:
        out: list[list[np.ndarray]] = [[] for _ in range(4)]
        block: list[tuple[int, int, bytes]] = []
        held = 0
        for text in each_text(b.column(0)):
            if len(text) < LENGTH:
                continue
            key = (*_digest(text), len(text))
            if key in known:
                known[key] = (known[key][0], known[key][1] + 1)
                continue
            known[key] = (number, 1)
            for at, own in _stretches(text):
                block.append((number, at, own))
                held += len(own)
                if held >= BLOCK:
                    search(block, out)
                    block, held = [], 0
            number += 1
            if sum(map(len, out[0])) > BATCH:
                yield found(out)
                out = [[] for _ in range(4)]
        if block:
            search(block, out)
        if out[0]:
            yield found(out)
        if len(known) > REMEMBER:
            yield counted()
            known = {}
    if known:
        yield counted()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a task once."""
    seen: set[bytes] = set()
    for b in batches:
        keys = [xxhash.xxh3_128_digest(t) for t in each_text(b.column(0))]
        fresh = []
        for k in keys:
            fresh.append(k not in seen)
            seen.add(k)
        if len(seen) > REMEMBER:
            seen.clear()
        yield b.filter(pa.array(fresh, pa.bool_()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes digest, bytes, and compressed text."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = b.column(b.num_columns - 1)
        found = [(*_digest(t), len(t), pack.compress(t)) for t in each_text(texts)]
        doc, doc2, sizes, packed = zip(*found, strict=True) if found else ((), (), (), ())
        new = {"doc": _signed(np.array(doc, np.uint64)), "doc2": _signed(np.array(doc2, np.uint64)), "size": pa.array(sizes, pa.int64()), "packed": pa.array(packed, pa.binary())}
        yield record_batch(**dict(zip(b.schema.names[:-1], b.columns[:-1], strict=True)), **new)


def _distinct_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _digests(_once(batches))


def _packed_bytes(text: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Up to seven bytes from each position, with their number in the eighth."""
    out = n << 56
    for i in range(UNIT - 1):
        out |= np.where(i < n, text[np.minimum(begin + i, len(text) - 1)].astype(np.int64) << (8 * i), 0)
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of each wanted run: minimizer, run text, unit number, core, bytes left and right of the core."""
    unpack = zstandard.ZstdDecompressor()

    def cut(texts: list[bytes], runs_of: np.ndarray, h: np.ndarray, c: np.ndarray, at: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        joined = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        a = (at >> 16) + np.repeat(np.cumsum(sizes) - sizes, runs_of)
        z, p = a + ((at >> 8) & 255), a + (at & 255)
        least, n = (p - z) // UNIT, (p - a) // UNIT - (p - z) // UNIT + 1
        run = np.repeat(np.arange(len(at)), n)
        unit = least[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        # windows begin - t, t in [0, UNIT), all hold the core [begin, end)
        begin = p[run] - unit * UNIT
        end = begin - UNIT + 1 + LENGTH
        low, high = np.maximum(a[run], begin - UNIT + 1), np.minimum(z[run], begin)
        core = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], u) >> 1 for x, y, u in zip(begin.tolist(), end.tolist(), unit.tolist(), strict=True)), np.int64, len(run))
        own = np.frombuffer(joined, np.uint8)
        return record_batch(h=h[run], c=c[run], unit=unit, core=core, left=_packed_bytes(own, low, begin - low), right=_packed_bytes(own, end, high + LENGTH - end), n=times[run])

    for b in batches:
        lists, packed = b.column(1), b.column(0)
        edges = lists.offsets.to_numpy()
        edges = edges - edges[0]
        fields = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
        texts: list[bytes] = []
        first, held = 0, 0
        for i in range(b.num_rows):
            texts.append(unpack.decompress(packed[i].as_py()))
            held += len(texts[-1])
            if held >= UNPACKED or i == b.num_rows - 1:
                yield cut(texts, np.diff(edges[first : i + 2]), *(x[edges[first] : edges[i + 1]] for x in fields))
                texts, first, held = [], i + 1, 0


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units as strings: left bytes, minimizer (without its sign), core, right bytes; bytes are below 256. A string that
    is not ``fine`` is its two names. The numbers of bytes on both sides and both flags go into the string's id."""
    places = 8 * np.arange(UNIT - 1)
    for b in batches:
        sid, h, core, left, right = (b.column(n).to_numpy() for n in ("sid", "h", "core", "left", "right"))
        more, fine = (b.column(n).to_numpy(zero_copy_only=False) for n in ("more", "fine"))
        n_left, n_right = np.where(fine, left >> 56, 0), np.where(fine, right >> 56, 0)
        middle = np.stack([(h & ((1 << 62) - 1)) + 256, np.where(core < 2**63 - 256, core + 256, core)], 1)
        table = np.concatenate([(left[:, None] >> places) & 255, middle, (right[:, None] >> places) & 255], 1)
        there = np.concatenate([np.arange(UNIT - 1) < n_left[:, None], np.ones((len(sid), 2), bool), np.arange(UNIT - 1) < n_right[:, None]], 1)
        offsets = np.concatenate([[0], np.cumsum(n_left + n_right + 2)])
        flags = np.where(fine, 0, _WHOLE) | np.where(more, _MORE, 0)
        yield record_batch(sid=(sid << 8) | (n_left << 4) | n_right | flags, letters=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(table[there])))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes that are whole windows: t bytes left of the core, and the names of their three triples. Of two names,
    the suffix from the first one."""
    for b in batches:
        sid, lists = b.column("sid").to_numpy(), b.column("ranks")
        begins = lists.offsets.to_numpy()[:-1].astype(np.int64)
        names = lists.values.to_numpy()
        n_left, n_right, fine = (sid >> 4) & 7, sid & 7, sid & _WHOLE == 0
        n = np.where(fine, np.maximum(0, np.minimum(n_left, n_left + n_right - UNIT + 1) + 1), 1)
        row = np.repeat(np.arange(len(sid)), n)
        begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begins[row] + begin
        second, third = (np.where(fine[row], names[np.minimum(at + i, len(names) - 1)] if len(names) else at, -1) for i in (3, 6))
        yield record_batch(sid=sid[row] >> 8, t=(n_left[row] - begin).astype(np.int32), more=sid[row] & _MORE > 0, a=names[at], b=second, c=third)


def repeated_windows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, doc2, size, first, last): runs of window starts in texts (digest, bytes) that occur more than once; rows may
    repeat."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    seen = texts.mapInArrow(_found, "h long, c long, text long, at long, doc long, doc2 long, size long, copies long")
    # a text's number is made unique by its task's number
    seen = stored(seen.withColumn("text", F.col("text") + F.shiftleft(F.spark_partition_id().cast("long"), 40)), "runs")
    known = stored(seen.where("doc is not null").select("text", *DOC, "copies").withColumn("sid", F.monotonically_increasing_id()), "texts")
    own = seen.where("h is not null").select("h", "c", "text", "at")
    # stored first, so that the join below has a shuffle of its own on either side and Spark can split a hot key
    minimizers = stored(own.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "minimizers")
    again = stored(own.join(minimizers.hint("shuffle_hash"), "h"), "runs-again")
    discard(seen)
    # equal runs of a task are one string, so a hot run has a row for each task
    grouped = again.groupBy("h", "c", F.shiftright("text", 40).alias("task")).agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("at").alias("at"))
    run_strings = stored(grouped.drop("task").withColumn("sid", F.monotonically_increasing_id()), "run-strings")
    contexts = stored(run_strings.groupBy("h", "c").agg(F.sum("n").alias("n"), F.first("text").alias("text"), F.first("at").alias("at")), "contexts")
    # minimizers with several texts, at least one of them single
    several = contexts.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h")
    wanted = contexts.join(several, "h").join(known, "text").groupBy(*DOC).agg(F.collect_list(F.struct("h", "c", "at", "n")).alias("wanted"))
    packed = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_distinct_digests, "doc long, doc2 long, size long, packed binary")
    units = packed.join(wanted.hint("shuffle_hash"), list(DOC)).select("packed", "wanted").mapInArrow(_units, "h long, c long, unit long, core long, left long, right long, n long")
    units = stored(units, "units")
    # equal units of different runs are one string; a text that two tasks sent gives its units twice, which changes none
    # of these sums
    several_runs = (F.min("c") < F.max("c")).cast("long")
    strings = stored(units.groupBy("h", "core", "unit", "left", "right").agg((F.max("n") + several_runs).alias("n"), (F.min("n") == 1).alias("single")).withColumn("sid", F.monotonically_increasing_id()), "unit-strings")
    # a core of single runs that has one string, once, is unique; bytes matter where it has several strings
    cores = strings.groupBy("h", "core", "unit").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.bool_or("single").alias("open")).where("open and (k > 1 or least > 1)").select("h", "core", "unit", (F.col("k") > 1).alias("fine"))
    unit_strings = stored(strings.join(cores.hint("shuffle_hash"), ["h", "core", "unit"]), "unit-sorted")
    # texts, runs and units share one sort; names of triples, then the order of three names: that of the UNIT + 1 letters
    # of a window
    more = (F.col("n") > 1).alias("more")
    sorted_ = _two_names(known, _TEXTS, "doc", "doc2", "copies").union(_two_names(run_strings, _RUNS, "h", "c", "n"))
    sorted_ = sorted_.union(unit_strings.select((F.col("sid") * 4 + _UNITS).alias("sid"), "h", "core", "left", "right", more, "fine"))
    named = suffix_order(sorted_.mapInArrow(_letters, "sid long, letters array<long>"), 3)
    suffixes = stored(named.mapInArrow(_windows, "sid long, t int, more boolean, a long, b long, c long"), "suffix-windows")
    found = adjacent(suffixes, ["a", "b", "c"]).where("repeated or more").groupBy("sid").agg(F.bit_or(F.expr("shiftleft(1, t)")).alias("mask"))
    hits = stored(found.select((F.col("sid") % 4).alias("kind"), F.shiftright("sid", 2).alias("sid"), "mask"), "hits")
    copied = known.join(hits.where(F.col("kind") == _TEXTS), "sid").select("text", F.lit(0).cast("long").alias("first"), (F.col("size") - LENGTH).alias("last"))
    ends = (F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("last")
    repeated = run_strings.join(hits.where(F.col("kind") == _RUNS), "sid").select("h", "c").distinct()
    whole = stored(again.join(stored(repeated, "run-hits").hint("shuffle_hash"), ["h", "c"]).select("text", F.shiftright("at", 16).alias("first"), ends), "repeated-runs")
    masks = unit_strings.join(hits.where(F.col("kind") == _UNITS), "sid").select("h", "core", "unit", "left", "right", F.when(F.col("fine"), F.col("mask")).otherwise(F.lit((1 << UNIT) - 1)).alias("mask"))
    single = units.where("n = 1").join(masks.hint("shuffle_hash"), ["h", "core", "unit", "left", "right"]).groupBy("h", "c").agg(F.collect_list(F.col("unit") * 256 + F.col("mask")).alias("masks"))
    single = single.join(contexts.where("n = 1"), ["h", "c"]).select("text", "at", "masks")
    partly = stored(single.mapInArrow(_starts, "text long, first long, last long"), "unit-windows")
    discard(again, run_strings, units, strings, unit_strings)
    return copied.union(whole).union(partly).join(known.drop("sid"), "text").select(*DOC, "first", "last")


def _two_names(df: DataFrame, kind: int, first: str, second: str, n: str) -> DataFrame:
    """Texts or runs as strings of two names: all their windows repeat if the first suffix does."""
    none = F.lit(0).cast("long")
    return df.select((F.col("sid") * 4 + kind).alias("sid"), F.col(first).alias("h"), F.shiftrightunsigned(second, 1).alias("core"), none.alias("left"), none.alias("right"), (F.col(n) > 1).alias("more"), F.lit(False).alias("fine"))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of window starts from the masks of a run's units; a mask is the low byte beside its unit's number."""
    for b in batches:
        number, place, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        row = np.repeat(np.arange(len(number)), np.diff(lists.offsets.to_numpy()))
        masks = lists.flatten().to_numpy()
        i, t = np.nonzero((masks[:, None] >> np.arange(UNIT)) & 1)
        row, unit = row[i], masks[i] >> 8
        a = place[row] >> 16
        z, s = a + ((place[row] >> 8) & 255), a + (place[row] & 255) - unit * UNIT - t
        inside = (a <= s) & (s <= z)
        row, s = row[inside], s[inside]
        order = np.lexsort((s, row))
        row, s = row[order], s[order]
        new = np.ones(len(s), bool)
        new[1:] = (row[1:] != row[:-1]) | (s[1:] > s[:-1] + 1)
        first = np.flatnonzero(new)
        yield record_batch(text=number[row[first]], first=s[first], last=s[np.append(first, len(s))[1:] - 1])


def spans(windows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, begins, ends): for each row the maximal stretches [begin, end) covered by windows, whose starts are given
    as runs (first in the upper half of a number, last in the lower one); null is none."""
    n = np.diff(windows.offsets.to_numpy())
    row, value = np.repeat(np.arange(len(n)), n), windows.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((value, row))
    row, value = row[order].astype(np.int64), value[order]
    begin, end = value >> 32, (value & ((1 << 32) - 1)) + LENGTH
    reach = np.maximum.accumulate((row << 33) + end)
    new = np.ones(len(row), bool)
    new[1:] = (row << 33)[1:] + begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(row))[1:] - 1
    return np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]), begin[first], reach[last] - (row[last] << 33)


def whole_characters(text: bytes, own: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches without the UTF-8 characters that they hold in part."""

    def start(i: int, step: int) -> int:
        while i < len(text) and text[i] & 0xC0 == 0x80:
            i += step
        return i

    return [(b, e) for a, z in own if (b := start(a, 1)) < (e := start(z, -1))]


def _with_windows(docs: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """The columns to keep, size, packed text and windows of each row with an id."""
    own = docs.where(F.col(id_col).isNotNull())
    # stored first, so that Spark can split the join below where a text has very many copies
    grouped = stored(repeated_windows(own, text_col).groupBy(*DOC).agg(F.collect_set(F.shiftleft("first", 32).bitwiseOR(F.col("last"))).alias("windows")), "text-windows")
    columns = [F.col(c).alias(f"keep_{c}") for c in keep]
    fields = "".join(f"`keep_{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    packed = own.select(*columns, F.col(text_col).cast("string").alias("text")).mapInArrow(_digests, f"{fields}doc long, doc2 long, size long, packed binary")
    return packed.join(grouped.hint("shuffle_hash"), list(DOC), "left").select(*[f"`keep_{c}`" for c in keep], "size", "packed", "windows")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept, kept_sha256) for each row with an id; spans: [begin, end) removed; kept: what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rest, sums = [], []
            offsets, begins, ends = spans(b.column("windows"))
            for packed, own in zip(b.column("packed").to_pylist(), _by_row(offsets, begins, ends), strict=True):
                text = unpack.decompress(packed)
                rest.append(without(text, own) if own else text)
                sums.append(hashlib.sha256(rest[-1]).hexdigest())
            gone = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(begins), pa.array(ends)], ["begin", "end"]))
            yield record_batch(id=b.column(0).cast(pa.int64()), n_bytes=b.column("size"), spans=gone, kept=pa.array(rest, pa.binary()), kept_sha256=pa.array(sums, pa.string()))

    joined = _with_windows(docs, [id_col], id_col, text_col)
    return joined.mapInArrow(cut, "id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary, kept_sha256 string")


def _by_row(offsets: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[list[tuple[int, int]]]:
    own = list(zip(begins.tolist(), ends.tolist(), strict=True))
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield own[a:z]


def without(text: bytes, own: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in own for x in s), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with an id, repeated passages cut from the text at whole characters; a null text becomes empty."""
    keep = [c for c in docs.columns if c != text_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts = []
            for packed, own in zip(b.column("packed").to_pylist(), _by_row(*spans(b.column("windows"))), strict=True):
                text = unpack.decompress(packed)
                texts.append((without(text, whole_characters(text, own)) if own else text).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*b.schema.names[: len(keep)], "cut"])

    fields = "".join(f"`keep_{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    out = _with_windows(docs, keep, id_col, text_col).mapInArrow(cut, f"{fields}cut string")
    return out.select(*[F.col("cut").alias(c) if c == text_col else F.col(f"keep_{c}").alias(c) for c in docs.columns])
