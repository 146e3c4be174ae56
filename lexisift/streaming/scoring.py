"""Structured Streaming front ends: validation of arriving texts and request metrics over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexisift.functions.segment import segment
from lexisift.functions.text import clean_text, held, with_quality


def texts(spark: SparkSession, folder: str, schema: StructType, files: int = 8) -> DataFrame:
    """Texts as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def validated(stream: DataFrame, text: str = "text") -> DataFrame:
    """Each arriving text cleaned, scored and segmented; stateless, so it works on streams and tables alike."""
    out = with_quality(held(stream, "cleaned", clean_text(text)), "cleaned", 0.7, 20)
    return segment(out, "cleaned").withColumn("is_valid", (F.col("length") >= 20) & (F.col("khmer_ratio") >= 0.7) & (F.col("quality_score") >= 0.6))


def metrics(events: DataFrame, time: str = "ts", value: str = "value", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and their mean value in tumbling windows; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("requests"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("start"), "requests", "mean_value")


def run_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to Parquet and ends when all there is has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
