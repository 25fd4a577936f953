"""Search over a stream of query files: each micro-batch runs the batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def search_stream(spark: SparkSession, folder: str, schema: str, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Parquet files of queries that arrive in `folder` are searched batch by
    batch; results go to `out`/batch_id=N, so a batch run again after a failure
    replaces its own rows."""
    queries = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            search(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
