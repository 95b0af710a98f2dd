"""Ingest reports: log rates, counts, ETA, throughput, JSON sinks and corpus grep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = r"ingested (\d+) chunks from .* in ([\d.]+)s \(([\d.]+) chunks/s[,)]"


def parse_log_rates(lines: DataFrame, column: str = "value") -> DataFrame:
    """chunks, seconds, rate of the lines that report an ingest (with or without a running total)."""
    part = lambda k: F.regexp_extract(column, RATE, k)
    return lines.where(F.col(column).rlike(RATE)).select(part(1).cast("long").alias("chunks"), part(2).cast("double").alias("seconds"), part(3).cast("double").alias("rate"))


def progress_counts(progress: DataFrame) -> DataFrame:
    return progress.agg(F.count("*").alias("files"), F.count_if("completed").alias("completed_files"), F.coalesce(F.sum(F.when(F.col("completed"), F.col("chunk_count"))), F.lit(0)).alias("completed_chunks"))


def ingest_report(rates: DataFrame, progress: DataFrame, total_files: int) -> DataFrame:
    """min, max and average rate, and the hours left at the average chunks per finished file."""
    speed = rates.agg(F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), F.avg("rate").alias("avg_rate"))
    left = (F.lit(total_files) - F.col("completed_files")) * F.try_divide("completed_chunks", "completed_files")
    return progress_counts(progress).crossJoin(speed).withColumn("eta_hours", F.try_divide(F.try_divide(left, F.col("avg_rate")), F.lit(3600)))


def throughput(progress: DataFrame, began: str = "began_at", ended: str = "updated_at") -> DataFrame:
    """chunks, seconds and chunks_per_sec (0 without time) of the files of a progress log."""
    seconds = F.unix_micros(F.max(ended)) - F.unix_micros(F.min(began))
    total = progress.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), (F.coalesce(seconds, F.lit(0)) / 1_000_000).alias("seconds"))
    return total.withColumn("chunks_per_sec", F.coalesce(F.try_divide(F.col("chunks").cast("double"), "seconds"), F.lit(0.0)))


def nested_report(series: str, rates: DataFrame, progress: DataFrame, total_files: int, at: Column) -> DataFrame:
    """One row: the ingest report as a nested object (timestamp, counts, rates, hours left)."""
    flat = ingest_report(rates, progress, total_files).crossJoin(rates.agg(F.count("*").alias("samples"))).crossJoin(progress.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")))
    speed = F.struct("samples", F.col("min_rate").alias("min"), F.col("max_rate").alias("max"), F.round("avg_rate", 2).alias("avg"))
    return flat.select(
        at.cast("string").alias("timestamp"), F.lit(series).alias("series"), F.lit(total_files).alias("volumes_total"), F.col("completed_files").alias("volumes_completed"), F.col("files").alias("volumes_in_progress_table"),
        F.col("chunks").alias("chunks_in_db"), F.col("completed_chunks").alias("chunks_from_completed_volumes"), speed.alias("ingest_rates_chunks_per_sec"), F.round("eta_hours", 2).alias("eta_hours_at_avg_rate"),
    )


def evaluation_report(results: DataFrame, k: int) -> DataFrame:
    """One row: questions, k, recall over all and by category (a map), and the misses (id, reason)."""
    category = F.upper(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("UNKNOWN")))
    by = results.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.avg("hit").alias("recall"))
    nested = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.struct("n", "recall"))))).alias("by_category"))
    reason = F.col("miss_reason") if "miss_reason" in results.columns else F.lit(None).cast("string")
    missed = F.array_sort(F.collect_list(F.when(F.col("hit") == 0, F.struct("id", reason.alias("miss_reason")))))
    return results.agg(F.count("*").alias("questions"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall_all"), missed.alias("misses")).withColumn("k", F.lit(k)).crossJoin(nested)


def write_report(report: DataFrame, path: str) -> None:
    """A report (one row, nested by structs and maps) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def corpus_grep(segments: DataFrame, pattern: str, limit: int | None = 100) -> DataFrame:
    """file_path, line_no, coord, text of matching lines, the first `limit` in file order (None: all, in no order)."""
    found = segments.where(F.col("text").rlike(pattern)).select("file_path", "line_no", "coord", "text")
    return found if limit is None else found.orderBy("file_path", "line_no").limit(limit)
