"""New Parquet files as a stream: cleaned, and published batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def cleaned_stream(spark: SparkSession, folder: str, schema: str, options: T.CleanOptions = T.CleanOptions()) -> DataFrame:
    """The kept documents of files as they arrive."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return T.clean(rows, "text", options).where("clean is not null")


def publish(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each micro-batch under its own number: a batch that is run again replaces its files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def interval_losses(stream: DataFrame, every: int) -> DataFrame:
    """Mean value by count-based interval of a metric stream (event_id, value)."""
    return stream.groupBy(F.floor(F.col("event_id") / every).alias("interval")).agg(F.count("*").alias("steps"), F.avg("value").alias("loss"))
