"""Row-wise cleaning and classing of files as they arrive. No state, so nothing needs a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from screenspark.operators.predictions import classified


def stream_predictions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Prediction files of a folder as a stream, with decision and class."""
    return classified(spark.readStream.schema(schema).parquet(folder))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now; the checkpoint makes a repeated call go on where the last one stopped."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
