"""Runs a stream over what is there now and gives the result back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studyspark.session import scratch_path, ship_package

#: State lives in RocksDB on the executors' disks and in the checkpoint, not in their heap.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Process all available input, write every micro-batch to ``folder``, and read it back with its ``batch_id``.

    Output and stream checkpoint both live in that folder, on storage all executors share: a later call with the same
    folder goes on where the last one stopped and reads what both wrote. Without a folder the run is a new one, in the
    shared folder for intermediate tables. A source without input gives an empty table.
    """
    spark: SparkSession = stream.sparkSession
    base = folder or scratch_path(spark, f"stream-{name}")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/batch_id=-1")    # so that there is a table
    ship_package(spark)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)      # the query keeps the settings it was started with
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of every key of an update-mode stream."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")
