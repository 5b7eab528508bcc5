"""Runs a stream over what is there and gives its rows as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.storage import scratch


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a parquet file or folder."""
    schema = spark.read.parquet(path).schema
    # A pattern that only the path itself fits, as a stream's source has to be a folder or a pattern.
    return spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")


def settled(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given once it has read everything: every batch's rows, or the last batch's in ``complete`` mode."""
    spark = stream.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    save = "append" if mode == "append" else "overwrite"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(save).parquet(f"{base}/rows")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
