"""Session defaults: UTC, adaptive execution, skew handling; sizes follow the cluster."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("lodestar")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return attach((builder.master(master) if master else builder).getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it outside PYTHONPATH."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share (spark.checkpoint.dir).

    Without that setting only a local master works, in a folder of its own; elsewhere it is an error,
    since executors do not see each other's disks.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/lodestar-{context.applicationId}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back, where several later steps need it."""
    path = f"{shared_folder(df.sparkSession)}/{unique_name(label)}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_max(df: DataFrame, order: list[str], value: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`: the greatest `value` up to each row in `order`, over all rows (or those of its keys), without one task for all.

    Rows are range-partitioned by keys and order and stored; each partition runs its own maximum, and the
    partitions' maxima (one row each and key) give what went before, so a key may span many partitions.
    """
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    tops = ranged.groupBy("_pid", *keys).agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select(F.col("_pid").alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], F.max("_top").over(before).alias("_earlier"))
    within = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_pid") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inner = ranged.withColumn("_within", F.max(value).over(within)).join(earlier, same)
    return inner.withColumn(out, F.greatest("_within", "_earlier")).drop("_pid", "_of", "_within", "_earlier", *[f"_of_{k}" for k in keys])


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders directly under `path` that a job wrote to the end, in order of their names; none where there is no such path."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(base) if s.isDirectory()] if fs.exists(base) else []
    return sorted(p.toString() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unique_name(label: str) -> str:
    """A name for a new folder beside others of its kind."""
    return f"{label}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that still read them are then lost."""
    delete_folder(spark, shared_folder(spark))
