"""Incremental forms: corpus ingest, re-embedding by range, expiring keyed caches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from lodestar.operators.chunking import chunk_segments
from lodestar.operators.infer import embed
from lodestar.operators.state import checkpoint_rows
from lodestar.session import delete_folder, finished_folders, shared_folder, unique_name
from lodestar.sources import corpus


def ingest_new_files(spark: SparkSession, root: str, out: str, checkpoint: str, encoder: Callable | None = None, dim: int = 2048, progress: str | None = None, files_per_batch: int = 1000):
    """Process every file that the checkpoint has not seen, in batches, then stop.

    A batch is one version of the chunk table `out` and of the progress log `progress`: a repeated
    batch replaces its own files and rows, a file that now has no chunks loses its earlier ones, and one
    that is no UTF-8 stops the run. `RateListener` measures the batches.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "new.txt").option("maxFilesPerTrigger", files_per_batch).schema("value string").load(root)
    named = files.select(corpus._relative(root).alias("file_path"), "value").withColumn("series", corpus.series_key(F.split("file_path", "/")[0]))

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("value", corpus.checked_text(F.col("value")))
        chunks = corpus.with_chunk_ids(chunk_segments(corpus.segments_of(batch))).withColumn("series", corpus.series_key(F.split("file_path", "/")[0]))
        corpus.write_chunks(embed(chunks, "text", "passage", dim, encoder), out, number, batch.select("file_path"))
        if progress:
            written = corpus.read_version(spark, out, number)
            checkpoint_rows(written, F.current_timestamp()).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{progress}/version={number:012d}")

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RateListener(StreamingQueryListener):
    """Keeps number and seconds of every finished micro-batch while it is registered (`spark.streams.addListener`).

    `rates` joins them with the files and chunks that each batch wrote.
    """

    def __init__(self) -> None:
        self.batches: list[tuple[int, float]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.batches.append((p.batchId, p.durationMs.get("triggerExecution", 0) / 1000))

    def rates(self, spark: SparkSession, out: str) -> DataFrame:
        """batch, files, chunks, seconds, rate of the batches seen, for `reports.ingest_report`; chunks from the manifest of table `out`."""
        seen = spark.createDataFrame(self.batches, "batch long, seconds double")
        written = corpus.read_manifest(spark, out).groupBy(F.col("version").alias("batch")).agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))
        return seen.join(written, "batch").select("batch", "files", "chunks", "seconds", F.try_divide(F.col("chunks").cast("double"), "seconds").alias("rate"))


def reembed_range(chunks: DataFrame, series: str, after_id: int, limit: int, encoder: Callable | None = None, dim: int = 2048) -> DataFrame:
    """One id range with new embeddings; running it again gives the same rows."""
    return embed(corpus.fetch_batch(chunks, series, after_id, limit).drop("embedding"), "text", "passage", dim, encoder)


def _uncovered(done: list) -> Column:
    """Whether no committed range (after_id < id <= last_id) holds the id; ranges that touch are put together."""
    merged: list[list[int]] = []
    for r in done:
        if merged and r.after_id <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], r.last_id)
        else:
            merged.append([r.after_id, r.last_id])
    out = F.lit(True)
    for after, last in merged:
        out = out & ~((F.col("id") > F.lit(after)) & (F.col("id") <= F.lit(last)))
    return out


def reembed(
    chunks: DataFrame, series: str, out: str, checkpoint: str, encoder: Callable | None = None, dim: int = 2048, batch: int = 1_000_000, limit: int | None = None, parallel: int = 4
) -> dict:
    """Give all chunks of a series new embeddings in ranges of ids, `parallel` at a time, and resume after a killed run.

    Ranges of about `batch` chunks are cut at quantiles of the ids. One scan deals the chunks that no
    committed range covers to a folder per range; each range is then embedded from its folder by a job of
    its own and committed by a line of the checkpoint (JSON: after_id, last_id, part, updated,
    elapsed_sec), which names its part of `out`. A range cut short has no line: it is dealt again, and
    `read_reembedded` never reads what it left. `limit` bounds the chunks of this run (the smallest ids).
    Returns the counts of this run.
    """
    spark, began = chunks.sparkSession, time.perf_counter()
    done = corpus.read_checkpoint(spark, checkpoint)
    rest = chunks.where((F.col("series") == series) & _uncovered(done)).drop("embedding")
    if limit is not None:
        top = rest.select("id").orderBy("id").limit(limit).agg(F.max("id")).first()[0]  # ids alone are ranked
        rest = rest.where(F.col("id") <= F.lit(top))
    cuts = corpus.plan_ranges(rest, series, batch)
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    staged = f"{shared_folder(spark)}/{unique_name('ranges')}"
    rest.withColumn("range", number).hint("rebalance", "range").write.partitionBy("range").parquet(staged)
    table = spark.read.schema(T.StructType([*rest.schema, T.StructField("range", T.IntegerType())])).parquet(staged)
    ranges = table.groupBy("range").agg(F.max("id").alias("last"), F.count("*").alias("n")).collect()  # a row a range
    commit = threading.Lock()

    def run(r) -> None:
        part = unique_name("part")
        embed(table.where(F.col("range") == r["range"]).drop("range"), "text", "passage", dim, encoder).write.parquet(f"{out}/{part}")
        # every id after the cut before it, up to its last one, is in this range or was committed earlier
        after = cuts[r["range"] - 1] if r["range"] else -(1 << 63)
        with commit:
            corpus.write_checkpoint(spark, checkpoint, after, r.last, part, r.n, time.perf_counter() - began)

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(run, sorted(ranges)))
    updated, seconds = sum(r.n for r in ranges), time.perf_counter() - began
    last_id = max([r.last_id for r in done] + [r.last for r in ranges], default=None)
    return {"updated": updated, "last_id": last_id, "elapsed_sec": round(seconds, 1), "chunks_per_sec": round(updated / seconds, 2) if seconds > 0 else 0.0}


def read_reembedded(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    """The rows of all committed ranges."""
    return spark.read.parquet(*[f"{out}/{r.part}" for r in corpus.read_checkpoint(spark, checkpoint)])


def first_within_ttl(events: DataFrame, keys: list[str], time: str, ttl: str = "7 days") -> DataFrame:
    """Keep-first expiring cache on a stream: one row per key while it is younger than the watermark."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


class LatestRow(StatefulProcessor):
    """Per key the newest row (time in microseconds, row as JSON), until the watermark passes its time."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", "at long, row string")

    def _out(self, key: tuple, at: int | None, op: str, row: str | None) -> pd.DataFrame:
        return pd.DataFrame([(*key, at, op, row)], columns=[*self.keys, "_at", "_op", "_row"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        at, row = old = held if held is not None else (None, None)
        for pdf in rows:
            # the last two columns, whose names do not come through
            for a, r in zip(pdf.iloc[:, -2].tolist(), pdf.iloc[:, -1].tolist()):
                if at is None or (a, r) > (at, row):  # of rows at one time the greatest stays
                    at, row = a, r
        if (at, row) == tuple(old) or at is None:
            return
        if held is not None:
            self.handle.deleteTimer(old[0] // 1000)
        self.newest.update((at, row))
        self.handle.registerTimer(at // 1000)
        yield self._out(key, at, "put", row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.newest.get()
        if held is not None and held[0] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
            yield self._out(key, held[0], "expire", None)

    def close(self) -> None:
        pass


#: Rows keep microseconds on their way through the state.
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_within_ttl(events: DataFrame, keys: list[str], time: str, out: str, checkpoint: str, ttl: str = "7 days", compact_every: int = 20):
    """Keep-latest expiring cache on a stream: the newest row of each key within `ttl` of the newest event.

    The state holds one row per living key: a row that is newer replaces it, older and repeated ones change
    nothing, events behind the watermark are dropped, and a timer at the row's time ends it when the
    watermark passes. A batch appends its changes to a log (a version per batch, so a repeated batch writes
    the same one); every `compact_every` batches the living rows become a snapshot, and the log before it
    and older snapshots go. Rows whose key or time is null take no part. Start it with `.start()`; read the
    cache with `read_latest`. The session needs the RocksDB state store (`build_session` sets it).
    """
    spark, schema = events.sparkSession, events.schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    present = F.col(time).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    timed = events.where(present).withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", ttl)
    rows = timed.select(*keys, "_time", F.unix_micros("_time").alias("_at"), F.to_json(F.struct(*schema.names), MICROS).alias("_row"))
    types = T.StructType([*[schema[k] for k in keys], T.StructField("_at", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_row", T.StringType())])
    changes = rows.groupBy(*keys).transformWithStateInPandas(LatestRow(keys), types, "Update", "EventTime")

    def append(batch: DataFrame, number: int) -> None:
        others = [c for c in schema.names if c not in keys]
        log = batch.withColumn("_r", F.from_json("_row", schema, MICROS)).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], "_op")
        log.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/log/version={number:012d}")
        if number % compact_every == compact_every - 1:
            read_latest(batch.sparkSession, out, keys).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/snapshot/version={number:012d}")
            _drop_older(batch.sparkSession, out, number, compact_every)

    return changes.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, folder) of a table's version folders that were written to the end."""
    return [(int(f.rsplit("version=", 1)[1]), f) for f in finished_folders(spark, path) if "version=" in f.rsplit("/", 1)[1]]


def _drop_older(spark: SparkSession, out: str, number: int, kept: int) -> None:
    """Snapshots and log versions that the snapshot before this one already holds: readers that began with it can finish."""
    for name, bound in (("snapshot", number - kept), ("log", number - kept + 1)):
        for version, folder in _versions(spark, f"{out}/{name}"):
            if version < bound:
                delete_folder(spark, folder)


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The living rows of a keep-latest cache: its newest snapshot and the changes since."""
    snapshots, logs = _versions(spark, f"{out}/snapshot"), _versions(spark, f"{out}/log")
    since = snapshots[-1][0] if snapshots else -1
    rows = None
    for version, folder in ([(since, snapshots[-1][1])] if snapshots else []) + [v for v in logs if v[0] > since]:
        part = spark.read.parquet(folder).withColumn("_version", F.lit(version))
        part = part if "_op" in part.columns else part.withColumn("_op", F.lit("put"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError(f"no cache at {out}")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "_version"]), "_version").alias("_r")).select("_r.*")
    return newest.where("_op = 'put'").drop("_op")
