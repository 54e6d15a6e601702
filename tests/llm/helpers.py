"""Small fixtures that every operator is tried on, and brute-force versions."""

import zlib

import numpy as np
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, copies string, curve string, position string, row string"


def prose(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(words))


def rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, copies, near copies, ties."""
    base = prose(1, 300)
    texts = [base, base, base.replace("a", "b", 3), None, "", "  \n ", prose(2, 30_000), prose(3, 80), "one", "one two", "Größe ÉTÉ ñandú " * 40, base + " tail", prose(4, 80)]
    out = [(i, t, None if i == 4 else "en", None if i == 5 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[0], out[7], (None, base, "en", "s1", 3), (100, base, "de", "s0", None)]
    return [(*r, "x", "y", "z", "w", "v", "u") for r in out]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return documents(spark, []).where(F.lit(False))


def crc(x: bytes) -> int:
    return zlib.crc32(x)
