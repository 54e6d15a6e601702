"""Quality of documents: ridge regression on random Fourier features, then isotonic calibration.

Statistics of the whole text (shares of character classes, repetition, word shape, compressibility) are
standardised and mapped to ``N_FEATURES`` cosines whose inner products approximate a Gaussian kernel. Each
partition adds up its part of the normal equations, Spark adds up the parts, and the driver solves one system of
fixed size. A quarter of the training rows calibrates the result by pooled adjacent violators over fixed bins.

Bounds: what reaches the driver is one matrix row for each feature, whatever the input; the text is read once and
never shuffled, only its statistics meet the labels. At most about ``MAX_LABELS`` labelled rows train, a hash sample
when there are more, so ``PARTS`` partial matrices are enough.

Defined results: a null text counts as empty; an empty text has all-zero statistics and is scored like any other;
rows with a null id are left out; rows with a null label or id do not train; a document labelled twice takes the
higher label; repeated rows come back as often as they came; without training rows of both classes every score is
the share of label 1 (0.5 without any label); label, lang, source and id are never inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecforge.llm import calibration
from vecforge.llm.common import as_bytes, record_batch, stored

N_FEATURES = 256
RIDGE = 1e-2
WIDTH = 4.0
SEED = 7
LOW, HIGH = -0.5, 1.5
CHUNK = 1 << 20
MAX_LABELS = 400_000
PARTS = 24
#: Characters that mark decoration rather than prose.
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
_CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "bang": list(b"!?"),
    "stop": list(b".,;:'\"()-"),
    "symbol": list(_SYMBOLS),
    "bar": list(b"|"),
    "line": [10, 13],
    "high": list(range(128, 256)),
}
STATISTICS = [*_CLASSES, "log_words", "word_length", "log_line", "distinct_words", "same_as_last", "top_word", "distinct_lines", "compressed", "wordless", "odd_ends"]


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = [float(hist[c].sum()) / n for c in _CLASSES.values()]
    words = text.split()
    m = len(words) or 1
    ids = dict.fromkeys(words)
    for i, w in enumerate(ids):
        ids[w] = i
    seq = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    zip_ = zlib.compressobj(1)
    packed = sum(len(zip_.compress(text[i : i + CHUNK])) for i in range(0, n, CHUNK)) + len(zip_.flush())
    return [
        *shares,
        float(np.log1p(len(words))),
        float(np.log1p(n / m)),
        float(np.log1p(n / max(len(lines), 1))),
        len(ids) / m,
        float((seq[1:] == seq[:-1]).sum()) / m,
        float(np.bincount(seq).max()) / m if len(words) else 0.0,
        len(set(lines)) / max(len(lines), 1),
        packed / n,
        sum(not w[:1].isalpha() and w[0] < 128 for w in words) / m,
        sum(w[-1] in _SYMBOLS or w[-1] == 33 for w in words) / m,
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) for each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record_batch(id=b.column(0), stats=pa.array([statistics(t) for t in as_bytes(b.column(1))], pa.list_(pa.float64())))

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return own.mapInArrow(run, "id long, stats array<double>")


def waves(dims: int, n: int = N_FEATURES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random features."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, n)) / WIDTH, rng.uniform(0, 2 * np.pi, n)


def features(x: np.ndarray, mean: np.ndarray, std: np.ndarray, w: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -8, 8)
    return np.hstack([np.ones((len(x), 1)), z, np.sqrt(2 / len(phase)) * np.cos(z @ w + phase)])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def _calibrates() -> Column:
    return F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(4)) == 0


def fit(train: DataFrame):
    """A function from statistics to scores, learnt from rows (id, stats, label 0.0/1.0)."""
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or not 0 < ones < n:
        base = ones / n if n else 0.5
        return lambda x: np.full(len(x), base)
    dims = range(len(STATISTICS))
    row = train.agg(*[f(F.col("stats")[i]) for i in dims for f in (F.avg, F.stddev_pop)]).first()
    mean, std = np.array(row[0::2], float), np.maximum(np.array(row[1::2], float), 1e-6)
    w, phase = waves(len(mean))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = features(_matrix(b.column(0)), mean, std, w, phase)
            both = np.hstack([x, b.column(1).to_numpy()[:, None]])
            total = x.T @ both if total is None else total + x.T @ both
        if total is not None:
            yield record_batch(row=np.arange(len(total), dtype=np.int32), sums=pa.array(list(total), pa.list_(pa.float64())))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column(0).to_pylist(), _rows(b.column(1)), strict=True):
                sums[r] = sums[r] + v if r in sums else v
        if sums:
            yield record_batch(row=pa.array(sums.keys(), pa.int32()), sums=pa.array(list(sums.values()), pa.list_(pa.float64())))

    parts = train.where(~_calibrates()).coalesce(PARTS).select("stats", "label").mapInArrow(part, "row int, sums array<double>")
    normal = parts.repartition(8, "row").sortWithinPartitions("row", F.hash("sums")).mapInArrow(add, "row int, sums array<double>")
    rows = sorted((r.row, r.sums) for r in normal.collect())
    full = np.array([v for _, v in rows]) if rows else np.zeros((len(mean) + len(phase) + 1,) * 2)
    a, y = full[:, :-1], full[:, -1]
    beta = np.linalg.solve(a + RIDGE * np.eye(len(a)), y)

    def raw(x: np.ndarray) -> np.ndarray:
        return features(x, mean, std, w, phase) @ beta

    held = _with(train.where(_calibrates()).select("id", "stats", "label"), raw, "raw")
    curve = calibration.fit(held, "raw", "label", LOW, HIGH)
    return lambda x: calibration.apply(curve, raw(x))


def _rows(column: pa.Array) -> list[np.ndarray]:
    return [np.array(v, float) for v in column.to_pylist()]


def _with(rows: DataFrame, score, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(score(_matrix(b.column(1))), 9), pa.float64())], names=[*b.schema.names, name])

    extra = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{extra}, {name} double")


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row with an id; learns from the rows of ``labels``: hold rows out by not giving them."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("double").alias("label"))
    n = known.count()
    if n > MAX_LABELS:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("labels")), F.lit(1_000_000)) < int(MAX_LABELS / n * 1_000_000))
    stats = stored(measured(docs, id_col, text_col), "quality")
    train = stored(stats.join(known, "id"), "quality-train")
    return _with(stats, fit(train), "score").select("id", "score")
