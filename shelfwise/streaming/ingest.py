"""Incremental ingest of pages: each key is stored once, runs can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.plans.skew import is_small, top_n

#: Parts of the store by a hash of the key; a batch reads those that its keys fall into.
BUCKETS = 64


def _stored(spark: SparkSession, store: str, before: int) -> DataFrame | None:
    try:
        return spark.read.parquet(store).where(F.col("batch_id") < before)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest(
    source: DataFrame,
    store: str,
    checkpoint: str,
    key: str,
    order: str,
    extract: Callable[[DataFrame], DataFrame],
) -> None:
    """Read what is new, keep the first row per key, skip keys already stored,
    extract and append. Returns when the available input is used up.

    A batch owns one ``batch_id`` folder and overwrites it when it is replayed,
    and it compares only with folders of earlier batches; so a run that dies and
    starts again leaves the same store. Folders are cut into ``BUCKETS`` by a hash of
    the key; only buckets with fresh keys are read. ``extract`` must keep the key.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        fresh = top_n(batch, [key], [F.col(order)]).withColumn("bucket", bucket).persist()
        known = _stored(batch.sparkSession, store, batch_id)
        new = fresh
        if known is not None:
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
            keys = known.where(F.col("bucket").isin(touched)).select("bucket", key)
            if is_small(fresh):
                # scan the touched buckets' keys in place instead of shuffling them
                keys = keys.join(F.broadcast(fresh.select("bucket", key)), ["bucket", key], "left_semi")
            new = fresh.join(keys, ["bucket", key], "left_anti")
        # one file per bucket and batch, however many tasks there are
        rows = extract(new.drop("bucket")).withColumn("bucket", bucket).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch_id={batch_id}")
        fresh.unpersist()

    query = (
        source.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def page_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1_000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
