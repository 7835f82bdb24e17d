"""Request ingest as Structured Streaming: deduplicated sequence numbers and batches that commit once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import fixtures as X


def requests_stream(spark: SparkSession, folder: str, pattern: str, schema, files: int = 1) -> DataFrame:
    """Files of a folder whose name fits the pattern, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def deduplicated(stream: DataFrame, key: str = "event_id", time: str = "received_at", delay: str = "1 day") -> DataFrame:
    """Padded sequence numbers, each once within the watermark; keys that aren't all digits are left out."""
    n = F.col(key).cast("string")
    padded = stream.where(n.rlike("^[0-9]{1,40}$")).withColumn("sequence_number", F.lpad(n, 40, "0"))
    return padded.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sequence_number"])


def commit_batches(stream: DataFrame, out: str, checkpoint: str):
    """Write each micro-batch under its own id; a replayed batch overwrites itself, so it counts once."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


@query("stream_dedupe", "SELECT lpad((event_id % 700)::VARCHAR, 40, '0') AS sequence_number FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    """All events as a stream with repeated sequence numbers, committed batch by batch and read back."""
    schema = X.table(spark, sf_dir, "events").schema
    root = f"{X.shared_folder(spark)}/{uuid.uuid4().hex}"
    at = F.col("ts").cast("timestamp").alias("received_at")
    stream = requests_stream(spark, sf_dir, "events*.parquet", schema).select((F.col("event_id") % 700).alias("event_id"), at)
    commit_batches(deduplicated(stream, delay="60 days"), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("sequence_number")
