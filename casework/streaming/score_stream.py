"""Scoring cases as they arrive.

A file stream hands over its micro-batches; each goes through the function of
the batch path as a whole, so that every column is the batch's.  Nothing is
kept between batches: models, thresholds and other tables are static inputs.

The sink writes a batch to the folder of its number and then the number to a
commit table.  After a failure the stream hands over the same batch under the
same number: a committed one is skipped, a half-written one is replaced.  Only
committed batches are read, so no case is there twice or by half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "batch_id long, n long"


def _commits(spark: SparkSession, out_dir: str) -> DataFrame:
    path = f"{out_dir.rstrip('/')}/commits"
    spark.createDataFrame([], COMMITS).write.mode("append").json(path)
    return spark.read.schema(COMMITS).json(path)


def write_once(out_dir: str, score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that stores ``score(batch)`` exactly once."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _commits(spark, out_dir).where(F.col("batch_id") == batch_id).count():
            return
        path = f"{out_dir.rstrip('/')}/data/batch_id={batch_id}"
        score(batch).write.mode("overwrite").parquet(path)
        n = spark.read.parquet(path).count()
        spark.createDataFrame([(batch_id, n)], COMMITS).coalesce(1).write.mode("append").json(f"{out_dir.rstrip('/')}/commits")
    return sink


def read_scored(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows of all committed batches, with ``batch_id``."""
    # one row a batch
    done = _commits(spark, out_dir).select("batch_id").distinct()
    rows = spark.read.parquet(f"{out_dir.rstrip('/')}/data").withColumn("batch_id", F.col("batch_id").cast("long"))
    return rows.join(done, "batch_id", "left_semi")


def score_stream(spark: SparkSession, in_dir: str, schema: T.StructType, out_dir: str, checkpoint: str,
                 score: Callable[[DataFrame], DataFrame], file_filter: str | None = None,
                 files_per_batch: int | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Score all that has arrived and return the committed rows.

    ``in_dir`` is the folder cases arrive in; ``file_filter`` (a glob) picks the
    case files inside it.  ``score`` is the batch path's function from case rows
    to scored rows.  Run again with the same folders to go on: after new
    arrivals, or after a failure."""
    reader = spark.readStream.schema(schema)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (reader.parquet(in_dir).writeStream.foreachBatch(sink or write_once(out_dir, score))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return read_scored(spark, out_dir)
