"""Keyed state on plain files: append log, latest view, compaction, caches, translation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import cache_key, strip
from lodestar.operators.search import cosine_distance


def latest(log: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest row per key of an append log: the upsert view."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(v).desc_nulls_last() for v in version])
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def compact(log: DataFrame, keys: list[str], version: list[str], path: str) -> None:
    """Write the latest view to a new directory; the log being read is never overwritten."""
    latest(log, keys, version).write.mode("errorifexists").parquet(path)


def load_progress(files: DataFrame, progress: DataFrame) -> DataFrame:
    """files with last_coord, chunk_count, completed; files without progress start anew."""
    view = latest(progress, ["file_path"], ["updated_at"]).select("file_path", "last_coord", "chunk_count", "completed")
    return files.join(view, "file_path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("completed", F.coalesce("completed", F.lit(False)))


def checkpoint_rows(chunks: DataFrame, at: Column, completed: bool = True) -> DataFrame:
    """One progress row per file from the chunks just written, to append to the log."""
    return chunks.groupBy("file_path").agg(F.max("coord_end").alias("last_coord"), F.count("*").cast("int").alias("chunk_count")).withColumn("completed", F.lit(completed)).withColumn("updated_at", at)


def cache_lookup(queries: DataFrame, cache: DataFrame, now: Column, days: int = 7, similarity: float = 0.95, least_chunks: int = 3, version: str = "v1") -> DataFrame:
    """Queries (query, vector) with cached chunks and answer where the exact text is cached, fresh, near and filled.

    `source` says "cache" where the answer is non-empty, else "fresh" (compute these).
    """
    view = latest(cache, ["query_hash"], ["created_at"]).where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))
    keyed = queries.withColumn("query_hash", cache_key(F.col("query"), version))
    found = keyed.join(view.select("query_hash", "query_embed", "top_chunks", "answer"), "query_hash", "left")
    near = (1 - cosine_distance(F.col("vector"), F.col("query_embed")) >= similarity) & (F.size("top_chunks") >= least_chunks) & (F.coalesce("answer", F.lit("")) != "")
    return found.withColumn("source", F.when(near, "cache").otherwise("fresh")).withColumn("top_chunks", F.when(near, F.col("top_chunks"))).drop("query_embed", "answer")


def purge_expired(cache: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one-row count of those that go)."""
    fresh = F.col("created_at") >= now - F.make_dt_interval(F.lit(days))
    return cache.where(fresh), cache.agg(F.count_if(~fresh).alias("purged"))


def upsert(log: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """Append rows to an append log at `path` and return the log with them; `latest` is its view."""
    rows.select(*log.columns).write.mode("append").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def cache_rows(answers: DataFrame, at: Column, version: str = "v1", least_chunks: int = 1) -> DataFrame:
    """Rows to append to the answer cache: query_hash, query_embed, top_chunks, answer, created_at.

    answers: query, vector, top_chunks, answer; failed and empty answers, and those without chunks, are not kept.
    """
    good = answers.where((F.coalesce("answer", F.lit("")) != "") & (F.coalesce(F.size("top_chunks"), F.lit(0)) >= least_chunks))
    return good.select(cache_key(F.col("query"), version).alias("query_hash"), F.col("vector").alias("query_embed"), "top_chunks", "answer", at.alias("created_at"))


def memory_rows(translated: DataFrame, at: Column) -> DataFrame:
    """Rows to append to the translation memory: new drafts without an error, one per source text."""
    fresh = translated.where(~F.col("from_memory") & F.col("error").isNull() & (strip(F.col("text")) != ""))
    if "skip" in translated.columns:
        fresh = fresh.where(~F.coalesce(F.col("skip"), F.lit(False)))
    return fresh.groupBy("source_key").agg(*[F.max_by(c, "id").alias(c) for c in ("draft", "polished", "used_specialist")]).withColumn("created_at", at)


def memory_lookup(requests: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with draft and polished, rows still to compute). Blank texts and bypassed rows are never looked up."""
    keyed = requests.withColumn("source_key", cache_key(F.col("text")))
    asks = (strip(F.col("text")) != "") & ~F.coalesce(F.col("skip"), F.lit(False)) if "skip" in requests.columns else strip(F.col("text")) != ""
    view = latest(memory, ["source_key"], ["created_at"]).select("source_key", "draft", "polished", "used_specialist")
    hits = keyed.where(asks).join(view, "source_key")
    rest = keyed.where(asks).join(view, "source_key", "left_anti").unionByName(keyed.where(~F.coalesce(asks, F.lit(False))))
    return hits, rest
