"""Passages, needle prompts and name parsing over text and token columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecforge.sources.tables import work_dir

#: Question and needle of the retrieval test. Fixed values.
NEEDLE = "\nThe best thing to do in San Francisco is eat a sandwich and sit in Dolores Park on a sunny day.\n"
QUESTION = "\n\nAccording to the text above, what is the best thing to do in San Francisco?\n\nAnswer:"
#: Estimated tokens for each word, and the margin that a haystack is built with. Fixed values.
PER_WORD, MARGIN = 1.3, 2000
#: Where layer numbers of prediction modules begin. Fixed value.
MTP_BASE = 10_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * PER_WORD).cast("long")


#: Rows of a piece that is numbered at a time: two to this power.
PIECE = 17


class _Piece:
    """Rows of one group that follow each other, and where a passage ends that begins at any of them.

    A passage ends with the row whose running estimate reaches ``least``. Its words are those of its rows, less one for
    each two rows that meet within a word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, opens: np.ndarray, ends: np.ndarray, least: int):
        self.n, self.least, self.opens, self.ends = len(sizes), least, bool(opens[0]), bool(ends[-1])
        self.sizes, self.words = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(words)])
        meets = np.concatenate([[False], ends[:-1] & opens[1:], [False]])
        self.words[1:] -= np.cumsum(meets[:-1])
        self.stop = np.searchsorted(self.sizes, self.sizes[:-1] + least)  # one past the last row, n + 1 without an end
        # a passage does not meet the row before it
        self.long = self.words[np.minimum(self.stop, self.n)] - self.words[:-1] + meets[:-1] >= least
        self.meets = meets

    def held(self, begin: int) -> tuple[int, int]:
        """(estimate, words) of the rows from ``begin`` on."""
        return int(self.sizes[-1] - self.sizes[begin]), int(self.words[-1] - self.words[begin] + self.meets[begin]) if begin < self.n else 0

    def first_stop(self, held: int) -> int:
        return int(np.searchsorted(self.sizes, self.least - held))

    def outcomes(self) -> list[tuple[int, int, int, int, int, int]]:
        """(stop, estimate up to it, words up to it, long passages after it, estimate and words left at the end) for
        each row that may end a passage begun before the piece; at last those of the whole piece."""
        stop, long = self.stop.tolist(), self.long.tolist()
        after, tail = [0] * (self.n + 1), [*range(self.n + 1)]
        for i in range(self.n - 1, -1, -1):
            if stop[i] <= self.n:
                after[i], tail[i] = after[stop[i]] + long[i], tail[stop[i]]
        last = min(stop[0], self.n)
        out = [(i, int(self.sizes[i]), int(self.words[i]), after[i], *self.held(tail[i])) for i in range(1, last + 1)]
        return [*out, (self.n + 1, int(self.sizes[-1]), int(self.words[-1]), 0, 0, 0)]

    def numbers(self, first_stop: int, first: int, number: int, last: int) -> np.ndarray:
        """The passage of each row, -1 for none: the one begun before is ``first``, those in the piece are numbered from
        ``number`` on, and the one unfinished at the end is ``last``."""
        out = np.full(self.n, -1, np.int64)
        if first_stop > self.n:
            out[:] = last
            return out
        out[:first_stop] = first
        at, stop, long = first_stop, self.stop, self.long
        while at < self.n and (end := int(stop[at])) <= self.n:
            if long[at]:
                out[at:end] = number
                number += 1
            at = end
        out[at:] = last
        return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one piece and one group at a time; rows come in their order."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        codes = [b.column(n).dictionary_encode().indices.to_numpy() for n in ("piece", "g")]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1 if b.num_rows else []
        for begin, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            own = b.slice(begin, end - begin)
            if held and own.num_rows and any(held[0].column(n)[0] != own.column(n)[0] for n in ("piece", "g")):
                yield pa.concat_batches(held)
                held = []
            if own.num_rows:
                held.append(own)
    if held:
        yield pa.concat_batches(held)


def _piece(b: pa.RecordBatch, least: int) -> _Piece:
    return _Piece(*(b.column(n).to_numpy(zero_copy_only=False) for n in ("e", "w", "opens", "ends")), least)


_OUTCOME = ("stop", "size", "words", "after", "held", "held_words")


def _starts(outcomes: dict[tuple[int, object], list], least: int) -> list[tuple]:
    """(piece, g, first stop, number of the passage begun before, next number, number of the unfinished one) of each
    piece and group, from what each piece does for any beginning; pieces are in order."""
    states: dict[object, tuple[int, int, bool, int]] = {}
    found: dict[object, list[list]] = {}
    for (piece, g), rows in outcomes.items():
        held, words, open_, number = states.get(g, (0, 0, False, 0))
        opens, ends = rows[0][:2]
        meets = int(open_ and opens)
        stop = next((r for r in rows[:-1] if held + r[3] >= least), None)
        if stop is None:
            whole = rows[-1]
            found.setdefault(g, []).append([piece, whole[2], None, number])
            states[g] = held + whole[3], words + whole[4] - meets, ends, number
            continue
        long = words + stop[4] - meets >= least
        found.setdefault(g, []).append([piece, stop[2], number if long else -1, number + long])
        states[g] = stop[6], stop[7], ends and stop[6] > 0, number + long + stop[5]
    out = []
    for g, rows in found.items():
        last = -1
        for piece, stop, first, number in reversed(rows):
            out.append((piece, g, stop, last if first is None else first, number, last))
            last = last if first is None else first
    return out


def _passage_numbers(rows: DataFrame, least: int) -> DataFrame:
    """(g, o, at, passage) of the rows that passages of ``least`` words are made of; rows: (g, o, e, w, opens, ends).

    Rows are put in order by ranges and cut in pieces. A passage that reaches into a piece may end there at one of few
    rows; each piece tells what follows from each of them, the driver goes through these from piece to piece, and the
    pieces are then numbered by themselves."""
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    path = work_dir(spark)
    order = [F.asc("g"), F.asc_nulls_last("o")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.parquet(path).withColumn("piece", F.shiftright("at", PIECE))

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            piece = _piece(b, least)
            found = piece.outcomes()
            each = pa.array(np.zeros(len(found), int))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            flags = [pa.array([x] * len(found), pa.bool_()) for x in (piece.opens, piece.ends)]
            yield pa.RecordBatch.from_arrays([b.column("piece").take(each), b.column("g").take(each), *flags, *columns], names=["piece", "g", "opens", "ends", *_OUTCOME])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            start = (b.column(n)[0].as_py() for n in ("stop", "first", "number", "last"))
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("o"), b.column("at"), pa.array(_piece(b, least).numbers(*start))], names=["g", "o", "at", "passage"])

    told = kept.repartition("piece").sortWithinPartitions("at").mapInArrow(outcomes, f"piece long, g {kinds['g']}, opens boolean, ends boolean, " + ", ".join(f"{n} long" for n in _OUTCOME))
    by_piece: dict[tuple[int, object], list] = {}
    for piece, g, *rest in told.orderBy("piece", "g", "stop").collect():
        by_piece.setdefault((piece, g), []).append(rest)
    starts = spark.createDataFrame(_starts(by_piece, least), f"piece long, g {kinds['g']}, stop long, first long, number long, last long")
    ready = kept.join(F.broadcast(starts), ["piece", "g"]).repartition("piece").sortWithinPartitions("at")
    return ready.mapInArrow(numbers, f"g {kinds['g']}, o {kinds['o']}, at long, passage long").where("passage >= 0")


def assemble_passages(df: DataFrame, by: str, order: str, text: str, min_tokens: int, n: int) -> DataFrame:
    """(by, passage, rows, words, text): rows joined in order until the estimate reaches ``min_tokens``; what is then
    too short by its word count, and an unfinished end, are dropped; at most ``n`` for each group.

    Only counts go through a group's order; texts meet by passage. ``order`` is unique in a group."""
    own = df.where(F.col(by).isNotNull() & (F.size(words(F.col(text))) > 0)).select(F.col(by).alias("g"), F.col(order).alias("o"), F.col(text).alias("t"))
    narrow = own.select("g", "o", estimated_tokens(F.col("t")).alias("e"), F.size(words(F.col("t"))).cast("long").alias("w"), F.col("t").rlike(r"\A\S").alias("opens"), F.col("t").rlike(r"\S\z").alias("ends"))
    numbered = _passage_numbers(narrow, min_tokens).where(F.col("passage") < n).select(F.col("g").alias("_g"), F.col("o").alias("_o"), "at", "passage")
    met = own.join(numbered, (F.col("g") == F.col("_g")) & F.col("o").eqNullSafe(F.col("_o"))).groupBy("g", "passage")
    joined = met.agg(F.count("*").cast("int").alias("rows"), F.sort_array(F.collect_list(F.struct("at", "t"))).alias("parts"))
    whole = joined.select("g", "passage", "rows", F.concat_ws("", F.transform("parts", lambda p: p["t"])).alias("text"))
    return whole.select(F.col("g").alias(by), F.col("passage").cast("int").alias("passage"), "rows", F.size(words(F.col("text"))).alias("words"), "text")


def haystack(df: DataFrame, by: str, order: str, text: str, total: int) -> DataFrame:
    """(by, rows, estimate): the non-blank rows of each group, in order, up to the first that reaches total + margin.

    Each such row counts one token at least, so no more rows than tokens are needed: Spark keeps that many of each
    group and task before it shuffles."""
    room = total + MARGIN
    first = df.where(F.trim(text) != "").select(by, order, estimated_tokens(F.col(text)).alias("_e")).where("_e > 0")
    own = first.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_at") <= room)
    before = F.coalesce(F.sum("_e").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_before", before).where(F.col("_before") < room).groupBy(by).agg(F.count("*").alias("rows"), F.sum("_e").alias("estimate"))


def with_needle(hay: Column, needle: Column, depth: Column, total: Column) -> Column:
    """Token array cut to what the needle leaves room for, with the needle at ``depth`` of it."""
    cut = F.slice(hay, F.lit(1), F.greatest(total - F.size(needle), F.lit(0)).cast("int"))
    at = F.greatest(F.lit(0), F.least(F.size(cut), F.floor(F.size(cut) * depth).cast("int")))
    return F.concat(F.slice(cut, F.lit(1), at), needle, F.slice(cut, at + 1, F.size(cut)))


def prompt(hay: Column, needle: Column, question: Column, depth: Column, total: Column) -> Column:
    """STRUCT<ids, question_at>."""
    before = with_needle(hay, needle, depth, total)
    return F.struct(F.concat(before, question).alias("ids"), F.size(before).alias("question_at"))


def answered(output: Column) -> Column:
    """Does the answer name both, or the park in full?"""
    low = F.lower(output)
    return (low.contains("sandwich") & low.contains("dolores")) | low.contains("dolores park")


def cut_ids(df: DataFrame, ids: str, ctx: int, n_eval: int) -> DataFrame:
    """Rows with enough ids, cut to ctx + n_eval."""
    return df.where(F.size(ids) >= ctx + n_eval).withColumn(ids, F.slice(ids, 1, ctx + n_eval))


def layer_id(name: Column) -> Column:
    """The number after ``layers.`` in a dotted name, 0 without one."""
    dotted = F.concat(F.lit("."), F.coalesce(name, F.lit("")), F.lit("."))
    return F.coalesce(F.regexp_extract(dotted, r"[.]layers[.]([0-9]+)[.]", 1).try_cast("int"), F.lit(0))


def module_layer_id(name: Column) -> Column:
    """As ``layer_id``; ``mtp.N`` stands for N past ``MTP_BASE``. The first of either in the name counts."""
    dotted = F.concat(F.lit("."), F.coalesce(name, F.lit("")), F.lit("."))
    kind = F.regexp_extract(dotted, r"[.](layers|mtp)[.]([0-9]+)[.]", 1)
    number = F.regexp_extract(dotted, r"[.](layers|mtp)[.]([0-9]+)[.]", 2).try_cast("int")
    return F.coalesce(F.when(kind == "mtp", number + MTP_BASE).otherwise(number), F.lit(0))


def parse_variant(text: Column) -> Column:
    """STRUCT<variant, q> of names such as e8_q38; another form is an error."""
    ok = text.rlike(r"^[a-z0-9]+_q[0-9]+$")
    fail = F.raise_error(F.concat(F.lit("not a variant: "), text))
    value = F.struct(F.split(text, "_q")[0].alias("variant"), F.split(text, "_q")[1].cast("int").alias("q"))
    return F.when(ok, value).otherwise(fail.cast("struct<variant:string,q:int>"))


def parse_list(text: Column) -> Column:
    """Integers of a comma list; blanks are dropped."""
    return F.transform(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != ""), lambda p: p.cast("int"))


def left_chars(text: Column, ctx: int) -> Column:
    """Eight characters for each token of context."""
    return F.substring(text, 1, ctx * 8)


def codec_of_channel(name: Column) -> Column:
    """A channel's codec: its name without the K, V or KV mark at the end."""
    return F.regexp_replace(name, r"_(K|V|KV)$", "")
