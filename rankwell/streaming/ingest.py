"""Review files taken in as they arrive.

Reading reviews one by one without loading a file is, in Spark, a file stream: each run takes the
files it has not seen, with exactly-once writes through the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankwell.operators.cleaning import interactions
from rankwell.sources.reviews import parse_review_lines


def review_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Interactions from the JSON lines files of a folder, as a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return interactions(parse_review_lines(lines, "value"))


def ingest_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the interactions of all files that are new since the last run, then stop."""
    writer = review_stream(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(out)
