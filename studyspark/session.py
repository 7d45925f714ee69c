"""Session helpers: a local session for tests and benches, and lineage cutting for loops."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_roots: dict[str, str] = {}


def local_session(app: str = "studyspark", cpus: int | str = 8, **conf) -> SparkSession:
    """A local session. On a cluster the session comes from spark-submit instead."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        # The JVM never compiles methods above this size; such stages run faster without fused code.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local
    path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there, so that loop plans stay small."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, from whatever folder the driver was started. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="studyspark-code-")) / "studyspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in PACKAGE.rglob("*.py"):
            out.write(source, source.relative_to(PACKAGE.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, under the shared folder. All of them go when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark).rstrip('/')}/studyspark-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return f"{_roots[app]}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        remove_folder(spark, folder)
    except Exception:  # noqa: BLE001  the application may have ended; its shared folder is then cleared by the cluster
        pass


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of an intermediate table that no later action reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now instead of at its next periodic collection. Files that
    a DataFrame in use may still need stay."""
    for _ in range(3):      # the driver first lets go of Python's handles, then of the plans, then of the files
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, safe from lost executors, with a short lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows of a few large input splits over all cores before work that is heavy per row. Input
    that already has a split per core stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
