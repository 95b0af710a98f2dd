"""Session plumbing shared by the operators: shared-folder tables and distributed numbering."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/checkpoints"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


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
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/lodestar-{context.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that still read them are then lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it outside PYTHONPATH.

    Arrow batches of whole texts are also made smaller than Spark's default number of rows and bytes,
    unless the session sets its own.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage (an executor lost later costs a re-read, not a recomputation) and gives the
    planner real sizes. The files stay until `clear_tables`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Exclusive running sum of `amount` per `keys` in `order`, without one task per key.

    Rows are range-partitioned by keys and order, so a key with a third of all rows spans many
    partitions. Each partition sums its own rows; the totals (one row per partition and key) give
    the offsets. Rows that tie on keys, order and amount are alike, so their order is immaterial.
    """
    from pyspark.sql import Window

    ranged = materialize(
        df.repartitionByRange(*keys, *order, amount).withColumn("_pid", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy("_pid", *keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_pid", *keys).orderBy(*order, amount).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col("_pid") == F.col("_opid")] + [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        ranged.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(offsets.withColumnRenamed("_pid", "_opid"), same)
        .withColumn(out, (F.col("_inner") + F.col("_before")).cast("long"))
        .drop("_inner", "_before", "_opid", "_pid", *[f"_k_{k}" for k in keys])
    )
