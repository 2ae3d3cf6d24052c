"""Tables as streams, and running a stream to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_dir
from tidemark.sources.tables import table


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table of files as a stream, at most ``files_per_trigger`` files in a micro-batch."""
    static = table(spark, folder, name)
    reader = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", files_per_trigger)
    single = any(f.endswith(f"/{name}.parquet") for f in static.inputFiles())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one for a stream's output and checkpoint."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], home: str) -> None:
    """Process all that is there now; after a restart with the same ``home`` finished batches are not run again."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def drain_to_table(stream: DataFrame, home: str) -> DataFrame:
    """Append a stream's rows to a table in ``home`` and give the table."""
    query = stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")
