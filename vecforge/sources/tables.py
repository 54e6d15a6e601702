"""Readers and writers of the tables that the library works on."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.functions.arrays import as_doubles

#: Record layouts of measurement reports.
MEASUREMENTS = "passage int, channel string, kind string, kv_mode string, k_bits int, v_bits int, delta_ppl double, top1_pair double, k_mse_layer0 double, v_mse_layer0 double, ppl_ref double, ppl_alt double, t_alt double, fire_count int, fatal string"
STORAGE = "passage int, channel string, kind string, q_range int, k_bits_per_tok_per_head int, v_bits_per_tok_per_head int, baseline_bytes_128k bigint, coded_bytes_128k bigint, total_ratio_128k double, ppl_ref double, ppl_alt double, delta_ppl double, top1_pair double, k_mse_rel double, v_mse_rel double, k_cos_mean double, v_cos_mean double, t_codec double, t_alt double, fire_count int, mismatch_count int, missing_count int, fatal string"
RETRIEVAL = "ctx_len int, depth double, channel string, codec_bits_per_token_per_head int, n_correct int, n_trials int, accuracy double, sample_outputs array<string>, t_gen_last double"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def passages(spark: SparkSession, texts: list[tuple[str, str]], repeat: int = 1) -> DataFrame:
    """(passage_id, topic, text) of texts given in place, each repeated within its passage."""
    return spark.createDataFrame([(i, topic, text * repeat) for i, (topic, text) in enumerate(texts)], "passage_id int, topic string, text string")


def records(spark: SparkSession, path: str, schema: str, field: str = "per_passage") -> DataFrame:
    """The records of JSON reports, each a document with a list of records under ``field``.

    The schema is given, so files are read once and only wanted fields are parsed."""
    return spark.read.schema(f"{field} array<struct<{_fields(schema)}>>").option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in schema.split(", ")))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(records: DataFrame, field: str = "per_passage", **facts: Column | str | int | float) -> DataFrame:
    """(value): one indented JSON document with the facts and, under ``field``, all records: for reports, whose records
    are few. Written as text, ``records`` reads it back."""
    rows = records.agg(F.sort_array(F.collect_list(F.struct(*records.columns))).alias(field))
    named = [v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in facts.items()]
    return rows.select(F.to_json(F.struct(*named, field), {"pretty": "true"}).alias("value"))


def work_dir(spark: SparkSession) -> str:
    """A new folder for small files that a query writes and reads again, among those that the cluster shares."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/work"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(key, sha256, bits) of a JSON object of frozen entries; entries without a hash (such as notes) are left out."""
    entries = F.from_json("value", "map<string,string>")
    text = spark.read.option("wholetext", True).text(path).select(F.explode(entries).alias("key", "entry"))
    parsed = text.select("key", F.from_json("entry", "sha256 string, bits int").alias("e"))
    return parsed.where(F.col("e.sha256").isNotNull()).select("key", "e.*")


def with_unit(text: Column) -> Column:
    """The number of a field such as ``45.3 W`` or ``12 MiB``."""
    return F.regexp_extract(F.trim(text), r"^(-?[0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")


def trace(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A device trace with a header of padded names and numbers with units; names become plain identifiers."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    plain = {c: "".join(x if x.isalnum() else "_" for x in c.split("[")[0].strip().lower()) for c in raw.columns}
    return raw.select(*[(with_unit(F.col(f"`{c}`")) if n in numbers else F.trim(F.col(f"`{c}`"))).alias(n) for c, n in plain.items()])


def digest(vec: Column, decimals: int = 6) -> Column:
    """SHA-256 of a vector's rounded decimal form."""
    return F.sha2(F.concat_ws(",", F.transform(as_doubles(vec), lambda x: F.format_string(f"%.{decimals}f", x))), 256)


def byte_digest(vec: Column, kind: str = "<f4") -> Column:
    """SHA-256 of a vector's bytes as a tensor of that kind; null for null."""

    @F.arrow_udf("string")
    def hashed(vecs: pa.Array) -> pa.Array:
        return pa.array([None if v is None else hashlib.sha256(np.array(v, kind).tobytes()).hexdigest() for v in vecs.to_pylist()], pa.string())

    return hashed(vec)


def gaussian(spark: SparkSession, tokens: int, heads: int, dims: int, scale: float = 0.3, seed: int = 0) -> DataFrame:
    """(token_idx, head_idx, vec): independent normal numbers; the same for a seed however they are partitioned.

    Each number comes from two hashes of its place by the Box-Muller transform."""
    def uniform(salt: str, i: Column) -> Column:
        return (F.pmod(F.xxhash64("token_idx", "head_idx", i, F.lit(salt), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def number(i: Column) -> Column:
        return (F.sqrt(-2 * F.log(uniform("r", i))) * F.cos(uniform("a", i) * 6.283185307179586) * scale).cast("float")

    places = spark.range(tokens).select(F.col("id").cast("int").alias("token_idx"), F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head_idx"))
    return places.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), number))


def with_head_gain(df: DataFrame, heads: int, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Vectors scaled from ``low`` at the first head to ``high`` at the last, in even steps."""
    gain = F.lit(low) + F.col("head_idx") * ((high - low) / max(heads - 1, 1))
    return df.withColumn("vec", F.transform("vec", lambda x: (x * gain).cast("float")))


def shards(spark: SparkSession, folder: str, glob: str = "*.safetensors") -> DataFrame:
    """(path, snapshot, shard): files of the newest snapshot folder, with the number from the name; contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")
    named = files.select("path", "modificationTime", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("snapshot"), F.regexp_extract("path", r"-(\d+)-of-\d+", 1).try_cast("int").alias("shard"))
    newest = named.agg(F.max_by("snapshot", "modificationTime").alias("snapshot"))
    return named.join(F.broadcast(newest), "snapshot").select("path", "snapshot", "shard")


#: Kinds of stored numbers: bytes, and how a block of them becomes doubles. Fixed values of the format.
_KINDS: dict[str, tuple[int, Callable[[np.ndarray], np.ndarray]]] = {
    "F64": (8, lambda b: b.view("<f8")),
    "F32": (4, lambda b: b.view("<f4")),
    "F16": (2, lambda b: b.view("<f2")),
    "BF16": (2, lambda b: (b.view("<u2").astype("<u4") << 16).view("<f4")),
    "I64": (8, lambda b: b.view("<i8")),
    "I32": (4, lambda b: b.view("<i4")),
    "I8": (1, lambda b: b.view("i1")),
    "U8": (1, lambda b: b),
    "F8_E8M0": (1, lambda b: 2.0 ** (b.astype(float) - 127)),
    "F8_E4M3": (1, lambda b: _E4M3[b]),
}
_BYTE = np.arange(256)
_E4M3 = np.where(_BYTE & 120, (1 + (_BYTE & 7) / 8) * 2.0 ** ((_BYTE >> 3 & 15) - 7), (_BYTE & 7) / 512) * np.where(_BYTE & 128, -1, 1)
_E4M3[[127, 255]] = np.nan


def _opened(path: str) -> pa.NativeFile:
    files, at = pafs.FileSystem.from_uri(path)
    return files.open_input_file(at)


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape, begin, end) from the JSON header in front of safetensors files; begin and end count
    from the start of the file, and nothing but the header is read."""

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                with _opened(path) as f:
                    n = int.from_bytes(f.read_at(8, 0), "little")
                    header = json.loads(f.read_at(n, 8))
                rows += [(path, k, t["dtype"], t["shape"], *(x + 8 + n for x in t["data_offsets"])) for k, t in header.items() if k != "__metadata__"]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("begin", pa.int64()), ("end", pa.int64())])
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(headers, "path string, name string, dtype string, shape array<bigint>, begin bigint, end bigint")


def tensor_values(found: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """(path, name, row, values): the tensors of rows of ``tensors``, one row for each entry of the first axis.

    Tensors are cut into stretches of about ``chunk`` bytes, each read at its offset by a task of its own."""
    first = F.when(F.size("shape") > 1, F.col("shape")[0]).otherwise(F.lit(1))
    sized = found.withColumn("rows", first).where("rows > 0").withColumn("width", F.expr("(end - begin) div rows"))
    step = F.greatest(F.lit(chunk) / F.greatest("width", F.lit(1)), F.lit(1)).cast("long")
    parts = sized.withColumn("step", step).select("path", "name", "dtype", "begin", "width", "rows", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.col("step"))).alias("row"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, dtype, begin, width, rows, step, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = min(step, rows - row)
                with _opened(path) as f:
                    raw = np.frombuffer(f.read_at(n * width, begin + row * width), np.uint8)
                size, decode = _KINDS[dtype]
                values = decode(raw).astype(float).reshape(n, width // size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([name] * n), pa.array(row + np.arange(n)), pa.array(list(values), pa.list_(pa.float64()))], names=["path", "name", "row", "values"])

    return parts.repartition("path", "name", "row").mapInArrow(read, "path string, name string, row bigint, values array<double>")
