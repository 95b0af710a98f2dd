"""Corpus files, golden sets, chunk tables: scans and idempotent sinks."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from lodestar.functions.text import parse_line
from lodestar.session import unique_name

GOLDEN = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("category", T.StringType()), ("question", T.StringType()), ("expected_canon_ids", T.ArrayType(T.StringType())),
    ("expected_canon_id", T.StringType()), ("sample_answer", T.StringType()), ("notes", T.StringType()),
)])


def series_key(name: Column) -> Column:
    """First two characters, upper-cased, of the first path component under the root."""
    return F.substring(F.upper(name), 1, 2)


def _relative(root: str) -> Column:
    plain = root.removeprefix("file:").rstrip("/")
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/"), f"^{re.escape('/' + plain.lstrip('/'))}/", "")


def checked_text(value: Column) -> Column:
    """value, or an error that names the file (column file_path) where it is no UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("file_path"))).cast("string"))


def read_files(spark: SparkSession, root: str, series: str | None = None, volume: str | None = None) -> DataFrame:
    """file_path (relative), series, value: every new.txt under the root; a missing volume is an error."""
    path = root if series is None and volume is None else f"{root}/{volume or series}"
    if volume is not None:
        path = f"{path}/new.txt"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader if volume is not None else reader.option("pathGlobFilter", "new.txt")
    files = reader.load(path).select(_relative(root).alias("file_path"), F.col("content"))
    return files.select("file_path", series_key(F.split("file_path", "/")[0]).alias("series"), checked_text(F.col("content").cast("string")).alias("value"))


def discover_series(spark: SparkSession, root: str) -> DataFrame:
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "new.txt").load(root).select(F.split(_relative(root), "/")[0].alias("dir"))
    return names.groupBy(series_key(F.col("dir")).alias("series")).agg(F.min("dir").alias("first_dir")).orderBy("first_dir").select("series")


def segments_of(files: DataFrame) -> DataFrame:
    """file_path, series, line_no, coord, text: lines with a marker and text, in file order."""
    lines = files.select("file_path", "series", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "raw")).where(F.instr("raw", "##") > 0)
    return lines.withColumn("_p", parse_line(F.col("raw"))).select("file_path", "series", "line_no", F.col("_p.coord").alias("coord"), F.col("_p.text").alias("text")).where("text <> ''")


def read_segments(spark: SparkSession, root: str, **scope) -> DataFrame:
    return segments_of(read_files(spark, root, **scope))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """A stable id per (file, chunk, piece): rewriting a file gives the same ids."""
    return chunks.withColumn("id", F.xxhash64("file_path", "chunk_no", "piece_no"))


#: Replaced files that are sent to all tasks at once when a table is read; more are left out in several rounds.
STALE_BLOCK = 500_000
_MANIFEST = "file_path string, chunks long, attempt string, fields string"


def write_chunks(chunks: DataFrame, path: str, version: int, files: DataFrame | None = None) -> None:
    """Write a batch of whole files as one version; writing the version again replaces all of it.

    The rows go to a folder of this attempt, then the version's manifest (file_path, chunks) names the
    folder: until that, and after a failure, readers see what was there before. `files` (file_path) lists
    all files of the batch: one without chunks gets a tombstone and loses its earlier rows. A file's rows
    count in its newest version only. `chunks` is computed once.
    """
    spark, attempt = chunks.sparkSession, unique_name("attempt")
    folder = f"{path}/data/version={version:012d}/attempt={attempt}"
    chunks.write.partitionBy("series").parquet(folder)
    written = spark.read.schema(chunks.schema).parquet(folder).groupBy("file_path").agg(F.count("*").alias("chunks"))
    if files is not None:
        written = files.select("file_path").distinct().join(written, "file_path", "left").select("file_path", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))
    rows = written.select("file_path", "chunks", F.lit(attempt).alias("attempt"), F.lit(chunks.schema.json()).alias("fields"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/manifest/version={version:012d}")


def delete_files(files: DataFrame, path: str, version: int) -> None:
    """Tombstones for files (file_path): a version of its own without rows."""
    spark = files.sparkSession
    write_chunks(spark.createDataFrame([], _newest_fields(read_manifest(spark, path))), path, version, files)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file_path, chunks, attempt, fields, version of every committed version; `live` on a file's newest one that has chunks."""
    rows = spark.read.schema(f"{_MANIFEST}, version long").parquet(f"{path}/manifest")
    newest = rows.groupBy("file_path").agg(F.max("version").alias("_newest"))
    return rows.join(newest, "file_path").withColumn("live", (F.col("version") == F.col("_newest")) & (F.col("chunks") > 0)).drop("_newest")


def _newest_fields(manifest: DataFrame) -> T.StructType:
    return T.StructType.fromJson(json.loads(manifest.agg(F.max_by("fields", "version")).first()[0]))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every file's newest version.

    The manifest says which folders have rows that count, and others are not read. Folders where all rows
    count are read as they are; in the rest, replaced files are left out by a join with their names, which
    are sent to the tasks in blocks of STALE_BLOCK at most. The chunks, vectors included, are never shuffled.
    """
    manifest = read_manifest(spark, path)
    held = manifest.where("chunks > 0").groupBy("version", "attempt").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("stale")).where("live > 0").collect()  # a row a version
    fields = _newest_fields(manifest)
    whole = T.StructType([*fields, T.StructField("version", T.LongType()), T.StructField("attempt", T.StringType())])

    def folders(rows) -> DataFrame:
        names = [f"{path}/data/version={r.version:012d}/attempt={r.attempt}" for r in rows]
        return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*names)

    clean, mixed = [r for r in held if not r.stale], [r for r in held if r.stale]
    parts = [folders(clean)] if clean else []
    if mixed:
        rows, gone = folders(mixed), manifest.where("chunks > 0 and not live").select("file_path", "version")
        blocks = -(-sum(r.stale for r in mixed) // STALE_BLOCK)
        for block in range(blocks):
            rows = rows.join(F.broadcast(gone.where(F.pmod(F.xxhash64("file_path"), F.lit(blocks)) == block)), ["file_path", "version"], "left_anti")
        parts.append(rows)
    if not parts:
        return spark.createDataFrame([], fields)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*fields.names)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows that one version wrote."""
    row = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version:012d}").first()
    fields = T.StructType.fromJson(json.loads(row.fields)) if row else T.StructType.fromJson(json.loads(read_manifest(spark, path).first().fields))
    return spark.read.schema(fields).parquet(f"{path}/data/version={version:012d}/attempt={row.attempt}") if row else spark.createDataFrame([], fields)


def compact_chunks(spark: SparkSession, path: str, out: str) -> None:
    """The newest rows as version 0 of a new table."""
    write_chunks(read_chunks(spark, path), out, 0)


def replace_embeddings(new: DataFrame, path: str, version: int) -> None:
    """Write the given (id, series, embedding) over those of a chunk table: a version of the files that have such chunks.

    Other files are not rewritten, and readers see all new vectors or none.
    """
    spark = new.sparkSession
    chunks = read_chunks(spark, path)
    fresh = new.select(F.col("id").alias("_id"), F.col("series").alias("_s"), F.col("embedding").cast(chunks.schema["embedding"].dataType).alias("_new"))
    mine = (F.col("id") == F.col("_id")) & (F.col("series") == F.col("_s"))
    touched = chunks.select("file_path", "id", "series").join(fresh.select("_id", "_s"), mine, "left_semi").select("file_path").distinct()
    rows = chunks.join(touched, "file_path", "left_semi").join(fresh, mine, "left")
    write_chunks(rows.withColumn("embedding", F.coalesce("_new", "embedding")).select(*chunks.columns), path, version)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)


def fetch_batch(chunks: DataFrame, series: str, after_id: int, limit: int) -> DataFrame:
    return chunks.where((F.col("series") == series) & (F.col("id") > after_id)).orderBy("id").limit(limit)


def update_embeddings(chunks: DataFrame, new: DataFrame, staging: str) -> DataFrame:
    """Write chunks with the given (id, series) embeddings replaced to a fresh staging directory and read it."""
    fresh = new.select(F.col("id").alias("_id"), F.col("series").alias("_s"), F.col("embedding").alias("_new"))
    out = chunks.join(fresh, (F.col("id") == F.col("_id")) & (F.col("series") == F.col("_s")), "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_id", "_s", "_new")
    path = f"{staging}/embeddings-{uuid.uuid4().hex}"
    out.write.partitionBy("series").parquet(path)
    return chunks.sparkSession.read.schema(out.schema).parquet(path)


def plan_ranges(chunks: DataFrame, series: str, size: int) -> list[int]:
    """Ids that cut a series into ranges of about `size` chunks, from a quantile sketch: one pass, no sort."""
    rows = chunks.where(F.col("series") == series)
    parts = max(1, -(-rows.count() // size))
    if parts == 1:
        return []
    cuts = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], F.lit(max(10_000, 10 * parts)))).first()[0]
    return sorted(set(cuts))


def reembed_checkpoint(done: DataFrame) -> DataFrame:
    """last_id and updated of the rows committed so far."""
    return done.agg(F.max("id").alias("last_id"), F.count("*").alias("updated"))


_CHECKPOINT = "after_id long, last_id long, part string, updated long, elapsed_sec double"


def read_checkpoint(spark: SparkSession, path: str) -> list:
    """The committed ranges (after_id < id <= last_id, part, updated, elapsed_sec) of a JSON log in order; none before the first."""
    try:
        return spark.read.schema(_CHECKPOINT).json(path).orderBy("after_id", "last_id").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def write_checkpoint(spark: SparkSession, path: str, after_id: int, last_id: int, part: str, updated: int, elapsed_sec: float) -> None:
    spark.createDataFrame([(after_id, last_id, part, updated, elapsed_sec)], _CHECKPOINT).coalesce(1).write.mode("append").json(path)
