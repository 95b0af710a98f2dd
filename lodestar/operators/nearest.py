"""Nearest rows of many queries in bounded memory: a task holds a block of queries, a table passes by.

Nothing is shuffled but the queries and what each task finds: the table is written once in packed rows, and
every task reads it as a stream (a Cartesian product of query blocks with the table as one partition).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import attach, shared_folder, unique_name

#: Bytes of what a task holds about its queries, of the rows that meet them at a time, and of a packed row of the table.
HELD_BYTES, PART_BYTES, PACK_BYTES = 96 << 20, 8 << 20, 256 << 10
#: Queries that a task holds at least where there are fewer blocks than cores.
LEAST_HELD = 1024
#: Queries and rows that are compared at once, and pairs whose distances are computed at once.
TILE_QUERIES, TILE_ROWS, PAIRS = 256, 2048, 1 << 15
#: Queries whose nearest are merged at once.
MERGED = 1024


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as a matrix; null elements become NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors of different lengths")
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _ordered(who: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by all three; `who` has 16 bits."""
    order = np.argsort(distance)
    order = order[np.argsort(who[order], kind="stable")]
    same = (np.diff(who[order]) == 0) & (np.diff(distance[order]) == 0)
    if same.any():
        ties = np.flatnonzero(np.append(same, False) | np.append(False, same))
        tied = order[ties]
        order[ties] = tied[np.lexsort((ids[tied], distance[tied], who[tied]))]
    return order


class Nearest:
    """The `most` nearest rows of each query among those that have passed by, ties to smaller ids.

    Products in single precision rule out rows that cannot be among them, by a bound on their error. The
    distance of each pair that is left is computed by itself in double precision, so that equal vectors tie
    wherever they stand. `cosine`: 1 - cosine; else 1 - product. Vectors without a direction have no distance.
    """

    def __init__(self, vectors: np.ndarray, most: int, cosine: bool = True, extra: bool = False) -> None:
        self.vectors, self.most, self.cosine = vectors, most, cosine
        self.sizes, self.units, usable = self._units(vectors)
        self.usable = np.flatnonzero(usable)
        self.distance, self.ids = np.full((len(vectors), most), np.inf), np.zeros((len(vectors), most), np.int64)
        self.extra = np.zeros((len(vectors), most)) if extra else None
        self.floor = np.full(len(vectors), -np.inf)
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def _units(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, what is compared in single precision, and which rows can be."""
        with np.errstate(all="ignore"):
            sizes = np.sqrt((vectors**2).sum(axis=1)) if self.cosine else np.ones(len(vectors))
            units = (vectors / sizes[:, None]).astype(np.float32)
        return sizes, units, np.isfinite(units).all(axis=1)

    def meet(self, ids: np.ndarray, rows: np.ndarray, groups: list[tuple[np.ndarray | None, np.ndarray | None]], extra: Callable | None = None) -> None:
        """Rows pass by. groups: numbers of queries and of the rows that they meet (None: all).

        extra(queries, rows) gives a number that is kept with each pair, by their numbers.
        """
        sizes, units, usable = self._units(rows)
        if not usable.any():
            return
        longest = 1.0 if self.cosine else max(1.0, float(np.sqrt((units[usable].astype(float) ** 2).sum(axis=1).max())))
        if not self.cosine and len(self.usable):
            longest *= max(1.0, float(np.sqrt((self.units[self.usable].astype(float) ** 2).sum(axis=1).max())))
        # of a product of rounded vectors, in any order of summation
        off = (rows.shape[1] + 8) * 2.0**-24 * longest
        whole = np.flatnonzero(usable)
        for at, among in groups:
            at = self.usable if at is None else at[np.isin(at, self.usable, assume_unique=True)] if len(self.usable) < len(self.vectors) else at
            among = whole if among is None else among[usable[among]]
            for a in range(0, len(among), TILE_ROWS):
                part = among[a : a + TILE_ROWS]
                turned = np.ascontiguousarray(units[part].T)
                for b in range(0, len(at), TILE_QUERIES):
                    self._tile(at[b : b + TILE_QUERIES], part, turned, off, ids, rows, sizes, extra)
                if self.n_waiting >= max(PAIRS, len(self.vectors) * self.most):
                    self.merge()

    def _tile(self, asked, part, turned, off, ids, rows, sizes, extra) -> None:
        alike = self.units[asked] @ turned
        floor = (self.floor[asked] - off).astype(np.float32)
        fresh = np.isneginf(floor)
        if fresh.any() and len(part) > self.most:
            floor[fresh] = np.partition(alike[fresh], -self.most, axis=1)[:, -self.most] - np.float32(2 * off)
        hit = np.flatnonzero(alike >= floor[:, None])
        for a in range(0, len(hit), PAIRS):
            q, i = np.divmod(hit[a : a + PAIRS], len(part))
            q, i = asked[q], part[i]
            with np.errstate(all="ignore"):
                product = np.einsum("ij,ij->i", self.vectors[q], rows[i])
                apart = 1 - product / (self.sizes[q] * sizes[i]) if self.cosine else 1 - product
            ok = apart == apart
            q, i, apart = (q, i, apart) if ok.all() else (q[ok], i[ok], apart[ok])
            self.waiting.append((q.astype(np.int32), apart, ids[i], *([extra(q, i)] if extra else [])))
            self.n_waiting += len(q)
            if self.n_waiting >= max(2 * PAIRS, 2 * len(self.vectors) * self.most):  # many equal vectors
                self.merge()

    def merge(self) -> None:
        """Take what is waiting into the nearest of its queries."""
        if not self.waiting:
            return
        new = [np.concatenate(x) for x in zip(*self.waiting)]
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(new[0], kind="stable")
        new = [x[order] for x in new]
        held = [self.distance, self.ids] + ([self.extra] if self.extra is not None else [])
        for a in range(0, len(self.vectors), MERGED):
            lo, hi = np.searchsorted(new[0], [a, a + MERGED])
            if lo == hi:
                continue
            some = np.unique(new[0][lo:hi])
            mine, slot = np.nonzero(np.isfinite(self.distance[some]))
            own = [np.concatenate([h[some[mine], slot], n[lo:hi]]) for h, n in zip(held, new[1:])]
            who = np.concatenate([mine, np.searchsorted(some, new[0][lo:hi])])
            order = _ordered(who.astype(np.uint16), own[0], own[1])
            who = who[order]
            rank = np.arange(len(who)) - np.searchsorted(who, np.arange(len(some)))[who]
            kept = rank < self.most
            for h, x in zip(held, own):
                h[some[who[kept]], rank[kept]] = x[order[kept]]
            # known only where there are `most`; the distance is 1 - likeness, up to its own rounding
            worst = self.distance[some, -1]
            self.floor[some] = np.where(np.isfinite(worst), 1 - worst - 1e-12, -np.inf)

    def found(self, order_by_extra: bool = False, only_extra: bool = False, keep: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Numbers of queries, ids, distances and extras of the nearest, some queries at a time.

        order_by_extra: the extra number takes the place of the distance; only_extra: rows whose extra is 0
        are left out; keep: so many of what is left of a query.
        """
        self.merge()
        for a in range(0, len(self.vectors), MERGED):
            part = slice(a, a + MERGED)
            distance, ids = self.distance[part], self.ids[part]
            extra = self.extra[part] if self.extra is not None else None
            there = np.isfinite(distance) if not only_extra else np.isfinite(distance) & (extra != 0)
            if order_by_extra:
                there &= extra == extra
                order = np.lexsort((ids, np.where(there, extra, np.inf)), axis=1)
                distance, ids, extra, there = (np.take_along_axis(x, order, axis=1) for x in (distance, ids, extra, there))
            if keep is not None:
                there = there & (np.cumsum(there, axis=1) <= keep)
            q, slot = np.nonzero(there)
            yield q + a, ids[q, slot], distance[q, slot], extra[q, slot] if extra is not None else None


def scopes(asked: pd.DataFrame) -> list[np.ndarray | None]:
    """Numbers of the queries that share their series and prefixes (whichever columns there are)."""
    own = [c for c in ("series", "prefixes") if c in asked.columns]
    if not own:
        return [None]
    key = list(zip(*[[None if v is None or v is pd.NA or v != v else v for v in asked["series"]] if c == "series" else [tuple(p.upper() for p in v) if v is not None else () for v in asked["prefixes"]] for c in own]))
    codes, _ = pd.factorize(pd.Series(key, dtype=object))
    order = np.argsort(codes, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []


def _bytes(batch: pa.RecordBatch, compression: str | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def slices(batch: pa.RecordBatch, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes."""
    step = max(1, size * len(batch) // max(1, batch.nbytes))
    for a in range(0, len(batch), step):
        yield batch.slice(a, step)


def _packed_table(table: DataFrame) -> DataFrame:
    """`table` in the shared folder, many rows in one (column `data`)."""

    def pack(batches):
        for batch in batches:
            for part in slices(batch, PACK_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([_bytes(part)], pa.binary())], ["data"])

    path = f"{shared_folder(table.sparkSession)}/{unique_name('passing')}"
    # small row groups: a reader holds one of them
    table.mapInArrow(pack, "data binary").write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
    return table.sparkSession.read.schema("data binary").parquet(path)


def pass_by(queries: DataFrame, table: DataFrame, held: int, start: Callable[[pa.Table], object], schema: str, at_once: int) -> DataFrame:
    """All rows of `table` pass by all `queries`, of which a task holds about `held`.

    start(queries) gives an object with `meet(rows)`, which gets about `at_once` rows of the table at a time,
    and `found()`, which then yields record batches of `schema`.
    """
    spark = attach(queries.sparkSession)
    n, slots = queries.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // max(1, held)), min(slots, -(-n // LEAST_HELD)))
    blocks = -(-blocks // slots) * slots if blocks > slots else blocks

    def pack(batches):
        held = [b for b in batches if len(b)]
        if held:
            data = _bytes(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

    def meet(pairs):
        met, held, rows, size = None, [], 0, 0
        for (_, asked), (data,) in pairs:  # one block of queries a task
            met = start(_table(bytes(asked))) if met is None else met
            part = _table(bytes(data))
            held.append(part)
            rows, size = rows + len(part), size + len(data)
            if rows >= at_once or size >= PART_BYTES:
                met.meet(pa.concat_tables(held))
                held, rows, size = [], 0, 0
        if held:
            met.meet(pa.concat_tables(held))
        if met is not None:
            for batch in met.found():
                yield (bytearray(_bytes(batch)),)

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from _table(data.as_py()).to_batches()

    asked = queries.repartition(blocks).mapInArrow(pack, "block int, data binary").repartitionById(blocks, F.col("block"))
    found = asked.rdd.cartesian(_packed_table(table).coalesce(1).rdd).mapPartitions(meet)
    return spark.createDataFrame(found, "data binary", verifySchema=False).mapInArrow(unpack, schema)


def held_queries(most: int, dim: int) -> int:
    """How many queries fit a task with the `most` nearest of each, those that wait to be merged, and their vectors."""
    return max(1, HELD_BYTES // (100 * most + 24 * dim))
