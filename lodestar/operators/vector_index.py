"""Approximate vector search on a written index: coarse cells, product-quantised residuals, exact rerank.

The index is a table partitioned by cell. A row has its id, a code of a few bytes for what its unit vector
differs from the cell's centre, and the vector itself. A search reads the codes of the nearest cells only,
keeps a shortlist per query by the coded vectors, and reads the vectors of the shortlist for exact distances.
Centres, code books, and how many cells and rows are enough are learned on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.nearest import Nearest, held_queries, pass_by, scopes, slices, vectors_of
from lodestar.operators.search import QUERY_BLOCK, ROW_BLOCK, row_masks, top_k
from lodestar.session import attach, shared_folder, unique_name

#: Bound of the sample that the model is fitted on (vectors, by hash of their ids), and of the part of it that asks.
SAMPLE, ASKING = 16_384, 512
MOST_CELLS, PARTS, WORDS = 4096, 16, 256
#: Share of the sample's true neighbours that must be found.
REACH = 0.95


def k_means(points: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k centres (fewer where there are fewer points); empty ones are taken by the worst placed points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest, apart = assign(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = points[np.argsort(-apart, kind="stable")[: len(empty)]]
    return centres


def assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the squared distance to it."""
    half = (centres**2).sum(axis=1)
    best, apart = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        d = half - 2 * part @ centres.T
        best[at : at + 4096] = d.argmin(axis=1)
        apart[at : at + 4096] = d.min(axis=1) + (part**2).sum(axis=1)
    return best, apart


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one; zero vectors become NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


@dataclass
class CellModel:
    """Centres (cells x dim), code books (parts x words x width), and how far a search goes."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    shortlist: int

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def _padded(self, vectors: np.ndarray) -> np.ndarray:
        return np.pad(vectors, ((0, 0), (0, self.books.shape[0] * self.width - vectors.shape[1])))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and codes (rows x parts) of unit vectors."""
        cells = assign(vectors, self.centres)[0]
        rest = self._padded(vectors - self.centres[cells])
        codes = [assign(rest[:, p * self.width : (p + 1) * self.width], book)[0] for p, book in enumerate(self.books)]
        return cells, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = [book[codes[:, p]] for p, book in enumerate(self.books)]
        return self.centres[cells] + np.hstack(parts)[:, : self.centres.shape[1]]

    def nearest_cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """(queries x probes): the cells whose centres are nearest, nearest first."""
        apart = (self.centres**2).sum(axis=1) - 2 * queries @ self.centres.T
        return np.argsort(apart, axis=1, kind="stable")[:, :probes]


def train(sample: np.ndarray, rows: int, k: int = 10, cells: int | None = None, parts: int = PARTS, reach: float = REACH) -> CellModel:
    """A model of unit vectors for a table of `rows` rows.

    probes: the fewest cells that hold `reach` of the asking vectors' k nearest; shortlist: the rank by
    coded distance within which `reach` of those lie, times the root of how often the table is the sample
    (neighbours of a larger table lie closer, but more rows compete).
    """
    cells = max(1, min(MOST_CELLS, round(rows**0.5 if cells is None else cells), len(sample)))
    centres = k_means(sample, cells)
    width = -(-sample.shape[1] // parts)
    model = CellModel(centres, np.zeros((parts, 1, width)), 1, k)
    rest = model._padded(sample - centres[assign(sample, centres)[0]])
    model.books = np.stack([k_means(rest[:, p * width : (p + 1) * width], WORDS, seed=p) for p in range(parts)])
    asking = sample[np.random.default_rng(1).choice(len(sample), min(ASKING, len(sample)), replace=False)]
    held, codes = model.encode(sample)
    coded = model.decode(held, codes)
    order = model.nearest_cells(asking, cells)
    place = np.argsort(order, axis=1)  # of each cell in the asking vector's order
    near = np.argsort(-(asking @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    if near.shape[1]:
        model.probes = int(np.quantile(np.take_along_axis(place, held[near], axis=1), reach, method="higher")) + 1
        ranks = []
        for q, cell_of, true in zip(asking, place, near):
            scores = np.where(cell_of[held] < model.probes, coded @ q, -np.inf)
            ranks.append([(scores > s).sum() + 1 for s in scores[true] if np.isfinite(s)])
        rank = int(np.quantile(np.concatenate(ranks), reach, method="higher")) if any(ranks) else k
        model.shortlist = max(k, int(np.ceil(rank * max(1.0, rows / len(sample)) ** 0.5)))
    return model


_MODEL = "cells long, dim long, parts long, words long, width long, probes long, shortlist long, centres binary, books binary"


def write_model(spark: SparkSession, model: CellModel, path: str) -> None:
    values = [*model.centres.shape, *model.books.shape, model.probes, model.shortlist, model.centres.astype("<f4").tobytes(), model.books.astype("<f4").tobytes()]
    row = pa.table({c.split()[0]: [v] for c, v in zip(_MODEL.split(", "), values)})
    spark.createDataFrame(row).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> CellModel:
    r = spark.read.schema(_MODEL).parquet(f"{path}/model").first()
    centres = np.frombuffer(r.centres, "<f4").reshape(r.cells, r.dim).astype(float)
    return CellModel(centres, np.frombuffer(r.books, "<f4").reshape(r.parts, r.words, r.width).astype(float), r.probes, r.shortlist)


def _usable(chunks: DataFrame) -> DataFrame:
    """Rows with a vector that has a direction."""
    return chunks.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def write_rows(chunks: DataFrame, model: CellModel, path: str) -> None:
    """Append chunks (id, embedding and, if they have one, series) to the index's table, one partition a cell."""
    attach(chunks.sparkSession)
    columns = ["id"] + (["series"] if "series" in chunks.columns else [])

    def code(batches):
        for batch in batches:
            if not len(batch):
                continue
            cells, codes = model.encode(units(vectors_of(batch.column("embedding"))))
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, batch.column("embedding"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cells.astype(np.int32))], [*columns, "embedding", "code", "cell"])

    rows = _usable(chunks).select(*columns, F.col("embedding").cast("array<float>").alias("embedding"))
    coded = rows.mapInArrow(code, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", embedding array<float>, code binary, cell int")
    # REBALANCE splits a cell with many rows over several tasks and puts small ones together
    coded.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")


def build_vector_index(chunks: DataFrame, path: str, k: int = 10, cells: int | None = None, sample: int = SAMPLE) -> CellModel:
    """Fit a model on at most `sample` vectors and write every chunk's row; returns the model.

    Later chunks are added by `write_rows` with the same model. Null, zero and NaN vectors take no part.
    """
    rows = _usable(chunks).select("id", "embedding")
    n = rows.count()
    if n == 0:
        raise ValueError("no vectors to index")
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < 2 * sample)  # about twice the bound
    taught = np.array([r.embedding for r in drawn.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], float)
    model = train(units(taught), n, k, cells)
    write_model(chunks.sparkSession, model, path)
    write_rows(chunks, read_model(chunks.sparkSession, path), path)
    return model


_FOUND = "query_id long, id long, distance double, exact double"


class _Probing:
    """The nearest rows of a task's queries by the coded vectors, in their nearest cells among the rows that have passed by,
    each with its exact distance."""

    def __init__(self, asked: pa.Table, model: CellModel, probes: int, most: int, keep: int | None = None) -> None:
        self.ids, self.model, self.keep = asked["query_id"].to_numpy(), model, keep
        self.vectors = units(vectors_of(asked["vector"])) if len(asked) else np.zeros((0, model.centres.shape[1]))
        self.scope = asked.select([c for c in ("series",) if c in asked.column_names]).to_pandas()
        self.groups = [np.arange(len(asked)) if g is None else g for g in scopes(self.scope)]
        self.probing = np.zeros((len(model.centres), len(asked)), bool)
        for a in range(0, len(asked), 1024):
            near = model.nearest_cells(np.nan_to_num(self.vectors[a : a + 1024]), probes)
            self.probing[near, a + np.arange(len(near))[:, None]] = True
        self.nearest = Nearest(self.vectors, most, cosine=False, extra=True)

    def meet(self, rows: pa.Table) -> None:
        part = rows.drop_columns(["embedding", "code"]).to_pandas()
        cells, mask = part["cell"].to_numpy(), row_masks(self.scope, part)
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(part), -1)
        true, met = units(vectors_of(rows["embedding"])), []
        for at in self.groups if len(self.ids) else []:
            ok = mask(at[0])
            for cell in np.unique(cells if ok is None else cells[ok]):
                here = cells == cell if ok is None else (cells == cell) & ok
                met.append((at[self.probing[cell, at]], np.flatnonzero(here)))
        self.nearest.meet(part["id"].to_numpy(), self.model.decode(cells, codes), met, lambda q, i: 1 - np.einsum("ij,ij->i", self.vectors[q], true[i]))

    def found(self) -> Iterator[pa.RecordBatch]:
        for q, ids, distance, exact in self.nearest.found(order_by_extra=self.keep is not None, keep=self.keep):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[q], ids, distance, exact)], ["query_id", "id", "distance", "exact"])


def _shortlist(queries: DataFrame, path: str, probes: int | None, most: int | None, keep: int | None = None) -> DataFrame:
    """query_id, id, distance by the coded vectors, exact distance: at least what `shortlist` says; with `keep`, of
    more than QUERY_BLOCK queries only the `keep` nearest of it by exact distance."""
    spark = attach(queries.sparkSession)
    model = read_model(spark, path)
    probes, most = min(probes or model.probes, len(model.centres)), most or model.shortlist
    rows = spark.read.parquet(f"{path}/rows")
    scoped = "series" in queries.columns and "series" in rows.columns
    light = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"), *(["series"] if scoped else []))
    table = rows.select("id", "code", "cell", "embedding", *(["series"] if scoped else []))
    asked = light.limit(QUERY_BLOCK + 1).toArrow()
    if len(asked) > QUERY_BLOCK:
        held = held_queries(most, len(asked["vector"][0]) + len(model.centres) // 24)
        return pass_by(light, table, held, lambda some: _Probing(some, model, probes, most, keep), _FOUND, ROW_BLOCK)
    cells = np.flatnonzero(_Probing(asked, model, probes, 1).probing.any(axis=1)).tolist()

    def local(batches):
        met = _Probing(asked, model, probes, most)
        for batch in batches:
            for part in slices(batch):
                met.meet(pa.Table.from_batches([part]))
        yield from met.found()

    return table.where(F.col("cell").isin(cells)).mapInArrow(local, _FOUND)


def shortlist(queries: DataFrame, path: str, probes: int | None = None, most: int | None = None) -> DataFrame:
    """query_id, id, distance by the coded vectors: the `most` nearest of each query in its `probes` nearest cells.

    Up to QUERY_BLOCK queries are sent to all tasks, which read the probed cells where they lie; of more, each
    task holds a block, and the rows pass by, about ROW_BLOCK at a time.
    """
    found = _shortlist(queries, path, probes, most)
    return top_k(found, [F.col("distance"), F.col("id")], most or read_model(queries.sparkSession, path).shortlist).select("query_id", "id", "distance")


def search_vector_index(queries: DataFrame, path: str, k: int = 20, probes: int | None = None, most: int | None = None) -> DataFrame:
    """query_id, id, distance (exact), rank: the k nearest found of each query, ties by id.

    queries: query_id, vector and, to keep to a series, series. A shortlist of at least k rows is
    reranked by exact cosine distances, which are computed where the rows are read; `probes` and `most`
    override what the index has learned.
    """
    most = max(k, most or read_model(queries.sparkSession, path).shortlist)
    short = top_k(_shortlist(queries, path, probes, most, k), [F.col("distance"), F.col("id")], most).select("query_id", "id", F.col("exact").alias("distance"))
    return top_k(short.where(~F.isnan("distance")), [F.col("distance"), F.col("id")], k)


def approximate_vector_search(queries: DataFrame, chunks: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """Index `chunks` in the application's shared folder and search it once."""
    path = f"{shared_folder(queries.sparkSession)}/{unique_name('cells')}"
    build_vector_index(chunks, path, k, sample=sample)
    return search_vector_index(queries, path, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: pairs, recall: how many of the exact (query_id, id) pairs are among those found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
