"""The coded write path over streams: the codec is a stateless projection, counters are the only state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecforge.operators.cache import write
from vecforge.operators.codec import Codec


def source(spark: SparkSession, path: str, schema: str, glob: str | None = None, files: int = 8) -> DataFrame:
    """A file stream with a given schema and a bounded number of files in each batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def coded(stream: DataFrame, codec: Codec | None, n_layers: int, k: int, vec_col: str = "vec", layer_col: str = "layer_id") -> DataFrame:
    """Appends to the store: the batch transform, unchanged."""
    return write(stream, codec, n_layers, k, vec_col, layer_col)


def counts(stream: DataFrame, layer_col: str = "layer_id") -> DataFrame:
    """(layer_id, fired, n): running counts, for update or complete mode."""
    return stream.groupBy(layer_col, "fired").agg(F.count("*").alias("n"))


def event_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n): counts in event-time windows; rows later than the watermark are dropped from state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is and stop; restarted with the same checkpoint, it goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def capture(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The tap: each micro-batch goes to its own folder, so a batch that is run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
