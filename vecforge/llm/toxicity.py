"""Toxic passages by maximum-scoring segments.

Words and their first four to six bytes are features. Each has a log-odds of toxic against clean documents under a
Dirichlet prior that adds ``PRIOR`` documents of the smaller class, and as large a share of the other; so a feature
that was never seen has log-odds zero. A word scores the log-odds of its feature with the largest magnitude, positive
or negative, less ``DRIFT``. A linear-time scan finds every maximal segment of positive total in the whole text;
totals are put on one scale by extreme-value statistics fitted to clean documents (Gumbel tail, Karlin-Altschul sum
statistic over all segments), and an isotonic curve turns that into a probability.

Bounds: labels are joined as a broadcast of at most about ``MAX_LABELS`` rows, a hash sample when there are more, so
the features come from so many texts at most; of them the ``MOST_FEATURES`` with the largest magnitude above
``LEAST`` (what a few documents can give) make the model, eight bytes each. Corpus text is never shuffled. Repeated words
within a document count once, and training documents with the same smallest shingle hash (copies and most near
copies) share the weight of one, so that a large group of copies doesn't make its rare words look toxic.

Defined results: a null or empty text has no segment and gets the score of a clean document; a document labelled
twice counts as toxic if either says so; rows with a null id or label do not train; rows with a null id are left
out of the result; repeated rows come back as often as they came; without training rows of both classes every
score is the share of toxic labels (0.5 without any label); other columns are never inputs, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.llm import calibration
from vecforge.llm.common import as_bytes, each_text, record_batch, stored

SHINGLE = 3
FLUSH = 200_000
MAX_LABELS = 400_000
PREFIXES = (4, 5, 6)
PRIOR = 5.0
LEAST = 0.75
MOST_FEATURES = 1 << 20
DRIFT = 0.25
#: A segment is reported as a passage if fewer than so many as high are expected in a clean text of that length.
EXPECTED = 0.05
CACHE = 100_000
LOW, HIGH = -20.0, 80.0
#: ASCII capitals become small, ASCII punctuation, digits and controls become blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    """keys, weights: features in order and their log-odds; lam, k: tail of clean documents; curve: calibration."""

    keys: np.ndarray
    weights: np.ndarray
    lam: float = 1.0
    k: float = 1e-3
    curve: tuple[np.ndarray, np.ndarray] | None = None
    base: float = 0.5


def words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def buckets(word: bytes) -> tuple[int, ...]:
    """The word's own bucket and those of its prefixes."""
    parts = [b"=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(p) for p in parts)


class _Cached(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.clear()
        self[key] = value = self.make(key)
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, total) of a score sequence, in order (Ruzzo and Tompa, 1999).

    Runs of negative scores are skipped by cumulative sums; only positive positions are visited."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # start, end, sum before it, sum at its end
    jump: list[int] = []  # index of the nearest earlier entry whose left sum is smaller, or -1
    for i in at.tolist():
        own = [i, i + 1, float(sums[i]), float(sums[i + 1])]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= own[2]:
                j = jump[j]
            if j < 0 or stack[j][3] >= own[3]:
                stack.append(own)
                jump.append(j)
                break
            own = [stack[j][0], own[1], stack[j][2], own[3]]
            del stack[j:], jump[j:]
    return [(int(s), int(e), r - left) for s, e, left, r in stack]


def evidence(totals: list[float], n_words: int, lam: float, k: float) -> float:
    """Minus the logarithm of the chance that a clean text of this length has segments as high, best over their number."""
    if not totals:
        return LOW
    shift = math.log(max(k * max(n_words, 1), 1e-12))
    best, total = LOW, 0.0
    for r, s in enumerate(sorted(totals, reverse=True), 1):
        total += lam * s - shift
        if r > 1 and total <= r * (r + 1):  # the tail formula holds above that only
            break
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return float(min(max(best, LOW), HIGH))


def bounded_labels(labels: DataFrame, label: str, id_col: str = "doc_id", bound: int = MAX_LABELS) -> DataFrame:
    """(_id, label 0.0/1.0), one row for each labelled id; beyond ``bound`` rows a hash sample of about that size."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label).cast("double").alias("label"))
    n = own.count()
    if n > bound:
        own = own.where(F.pmod(F.xxhash64("_id", F.lit("labels")), F.lit(1_000_000)) < int(bound / n * 1_000_000))
    return own


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The training rows' text, found by a broadcast of the bounded labels: the text is not shuffled."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(labels), "_id")


def calibrates() -> Column:
    """A quarter of the training rows is kept for the calibration."""
    return F.pmod(F.xxhash64("_id", F.lit("calibrate")), F.lit(4)) == 0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = []
        for text in each_text(b.column(2)):
            own = words(text)
            low.append(min((xxhash.xxh64_intdigest(b" ".join(own[i : i + SHINGLE])) for i in range(max(len(own) - SHINGLE + 1, 1))), default=0))
        yield record_batch(_id=b.column(0), label=b.column(1), sketch=np.array(low, np.uint64).view(np.int64))


def weighted(rows: DataFrame) -> DataFrame:
    """(_id, label, weight): documents of one label with the same smallest shingle hash weigh one together."""
    sketched = stored(rows.select("_id", "label", "text").mapInArrow(_sketch, "_id long, label double, sketch long"), "toxic-sketch")
    n = sketched.groupBy("label", "sketch").agg((1 / F.count("*")).alias("weight"))
    return sketched.join(n, ["label", "sketch"]).groupBy("_id").agg(F.max("label").alias("label"), F.max("weight").alias("weight"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: tuple[dict[int, float], dict[int, float]] = ({}, {})
    cache = _Cached(buckets)

    def out():
        keys = list(sums[0].keys() | sums[1].keys())
        for i in range(0, len(keys), 1 << 16):
            part = keys[i : i + (1 << 16)]
            yield record_batch(bucket=pa.array(part, pa.int64()), clean=pa.array([sums[0].get(k, 0.0) for k in part], pa.float64()), toxic=pa.array([sums[1].get(k, 0.0) for k in part], pa.float64()))
        sums[0].clear()
        sums[1].clear()

    for b in batches:
        for text, label, weight in zip(each_text(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            own = sums[int(label > 0)]
            for k in {i for w in set(words(text)) for i in cache[w]}:
                own[k] = own.get(k, 0.0) + weight
            if len(own) > FLUSH:
                yield from out()
    yield from out()


def log_odds(counts: DataFrame, n_clean: float, n_toxic: float) -> DataFrame:
    """(bucket, delta): the log-odds of each feature, positive or negative, that may pass ``LEAST``.

    The prior adds the same rate to both classes: ``PRIOR`` documents of the smaller one."""
    rate = F.lit(PRIOR / min(n_clean, n_toxic))
    t, c = F.col("toxic") / n_toxic + rate, F.col("clean") / n_clean + rate
    return counts.select("bucket", (F.log(t) - F.log(c)).alias("delta")).where(F.abs("delta") >= LEAST)


class _Scorer:
    """The segments of texts; the scores of words are kept as long as they are few."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _learn(self, fresh: list[bytes]) -> None:
        keys, values = self.model.keys, self.model.weights
        best = np.zeros(len(fresh))
        if len(keys):
            own = [buckets(w) for w in fresh]
            n = np.fromiter(map(len, own), np.int64, len(own))
            flat = np.fromiter((i for x in own for i in x), np.uint32, int(n.sum()))
            at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
            delta = np.where(keys[at] == flat, values[at], 0.0)
            starts = np.cumsum(n) - n
            high, low = np.maximum.reduceat(delta, starts), np.minimum.reduceat(delta, starts)
            best = np.where(high >= -low, high, low)
        self.known.update(zip(fresh, (best - DRIFT).tolist(), strict=True))

    def __call__(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, float]]]]:
        split = [words(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        fresh = [w for w in {w for own in split for w in own} if w not in known]
        if fresh:
            self._learn(fresh)
        return [len(own) for own in split], [segments(np.fromiter(map(known.__getitem__, own), float, len(own))) for own in split]


#: Texts whose words are looked up together.
TOGETHER = 256


def _scored(texts: pa.Array, scorer: _Scorer) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    for i in range(0, len(texts), TOGETHER):
        yield from zip(*scorer(as_bytes(texts.slice(i, TOGETHER))), strict=True)


def _raw(found: list[tuple[int, list[tuple[int, int, float]]]], model: Model) -> np.ndarray:
    return np.array([evidence([s[2] for s in segs], n, model.lam, model.k) for n, segs in found], float)


def _value(raw: np.ndarray, model: Model) -> np.ndarray:
    return np.full(len(raw), model.base) if model.curve is None else calibration.apply(model.curve, raw)


def raw_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(_id, label, n_words, top, raw) of rows (_id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in batches:
            found = list(_scored(b.column(1), scorer))
            top = [max((s[2] for s in segs), default=0.0) for _, segs in found]
            yield record_batch(_id=b.column(0), label=b.column(2), n_words=pa.array([n for n, _ in found], pa.int64()), top=pa.array(top, pa.float64()), raw=_raw(found, model))

    return rows.select("_id", "text", "label").mapInArrow(run, "_id long, label double, n_words long, top double, raw double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = MAX_LABELS) -> Model:
    """Learn from the rows of ``labels``; hold rows out by not giving them."""
    given = stored(bounded_labels(labels, label, id_col, bound), "labels")
    rows = labelled(docs, given, id_col, text_col)
    learn = stored(weighted(rows.where(~calibrates())), "toxic-weights")
    n_toxic, n_clean = learn.agg(F.sum(F.col("label") * F.col("weight")), F.sum((1 - F.col("label")) * F.col("weight"))).first()
    n, toxic = given.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), base=toxic / n if n else 0.5)
    counts = labelled(docs, learn, id_col, text_col).select("text", "label", "weight").mapInArrow(_count, "bucket long, clean double, toxic double").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = log_odds(counts, n_clean, n_toxic).orderBy(F.desc(F.abs("delta")), "bucket").limit(MOST_FEATURES)
    kept = sorted((r.bucket, r.delta) for r in chosen.collect())
    keys, weights = np.array([k for k, _ in kept], np.uint32), np.array([v for _, v in kept], np.float32)
    clean = raw_scores(rows.where(calibrates()), Model(keys, weights)).where("label = 0")
    over, excess, exposed = clean.agg(F.sum((F.col("top") > 0).cast("double")), F.sum("top"), F.sum("n_words")).first()
    # above zero the tail of clean documents is exponential: the mean gives lambda, their share gives K
    lam = (over + 1) / ((excess or 0.0) + 1) if over is not None else 1.0
    k = ((over or 0.0) + 0.5) / max(exposed or 0, 1)
    model = Model(keys, weights, lam, k)
    again = raw_scores(rows.where(calibrates()), model)
    return Model(keys, weights, lam, k, calibration.fit(again, "raw", "label", LOW, HIGH), toxic / n)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) for each row with an id; passages: (first word, end, total) of each significant segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("total", pa.float64())]))
        for b in batches:
            found = list(_scored(b.column(1), scorer))
            least = [math.log(max(model.k * max(n, 1), 1e-12) / EXPECTED) / model.lam for n, _ in found]
            spans = [[{"first": s, "end": e, "total": t} for s, e, t in segs if t >= low] for (_, segs), low in zip(found, least, strict=True)]
            yield record_batch(id=b.column(0), score=_value(_raw(found, model), model), passages=pa.array(spans, kind))

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return own.mapInArrow(run, "id long, score double, passages array<struct<first:int,end:int,total:double>>")


def filtered(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with an id whose score is below the threshold, with all their columns; only texts go to Python."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(model)
        for t in texts:
            yield pa.array(_value(_raw(list(_scored(t, scorer)), model), model))

    rows = docs.where(F.col(id_col).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.withColumn("score", score(F.col("row")[text_col].cast("string"))).where(F.col("score") < threshold).select("row.*")
