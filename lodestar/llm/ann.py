"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Rotations are learned on a bounded sample (principal axes, then iterative quantisation from several
starts); the signs of the rotated vector are its code. Codes are split into substrings, each indexed; a
query probes all substring values within its share of the Hamming radius, which by the pigeonhole
principle reaches every code within the radius, and reranks those by the exact distance. The table is
dealt once into row blocks of bounded size; the stated queries pass by every block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import _text
from lodestar.llm._spark import attach, materialize

#: Bound of the sample that rotations and radius are fitted on (vectors, by hash).
SAMPLE = 2048
ROW_BLOCK, SUBSTRING = 16384, 16
#: Learned rotations side by side: more bits tell near from far better.
ROTATIONS = 4
#: Share of the sample's true neighbours that the radius must reach; those of a larger table lie closer.
REACH = 0.95


def learn_rotation(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dim x bits): axes of greatest variance, each set rotated so that signs lose least."""
    mean = sample.mean(axis=0)
    centered = sample - mean
    _, axes = np.linalg.eigh(centered.T @ centered)
    axes, turns = axes[:, ::-1][:, :64], []
    flat = centered @ axes
    for seed in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))[0]
        for _ in range(rounds):
            signs = np.where(flat @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ flat)
            turn = (u @ vt).T
        turns.append(axes @ turn)
    return mean, np.hstack(turns)


def codes(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(vectors, words of 64 bits): the signs of the rotated vectors; bits beyond the rotations are 0."""
    bits = (vectors - model[0]) @ model[1] >= 0
    padded = np.zeros((len(vectors), -(-max(bits.shape[1], 1) // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(np.packbits(padded, axis=1, bitorder="little")).view(np.uint64)


def apart(code: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Differing bits of each code and the query's."""
    return np.bitwise_count(code ^ query).sum(axis=1, dtype=np.int64)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def learn_radius(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray], k: int, reach: float = REACH) -> int:
    """Hamming radius that holds `reach` of the sample's k nearest; the full table's lie closer still."""
    code, bits = codes(sample, model), []
    for i in range(min(len(sample), 512)):
        d = distances(sample, sample[i])
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        bits.append(apart(code[near], code[i]))
    return int(np.ceil(np.quantile(np.concatenate(bits), reach))) if bits and len(bits[0]) else 64 * code.shape[1]


class SubstringIndex:
    """Codes by the values of each of their substrings."""

    def __init__(self, code: np.ndarray) -> None:
        self.code, self.parts, self.tables = code, np.ascontiguousarray(code).view(np.uint16), []
        for t in range(self.parts.shape[1]):
            order = np.argsort(self.parts[:, t], kind="stable")
            values, starts = np.unique(self.parts[order, t], return_index=True)
            self.tables.append((order, values, starts, np.diff(np.append(starts, len(code)))))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most `radius` bits."""
        share, more = divmod(radius, len(self.tables))
        found, parts = np.zeros(len(self.code), bool), np.ascontiguousarray(query).view(np.uint16)
        for t, (order, values, starts, sizes) in enumerate(self.tables):
            reach = share if t <= more else share - 1
            if reach < 0:
                continue
            at = np.flatnonzero(np.bitwise_count(values ^ parts[t]) <= reach)
            found[order[_text.ranges(starts[at], sizes[at])]] = True
        rows = np.flatnonzero(found)
        return rows[apart(self.code[rows], query) <= radius]


def search_block(index: SubstringIndex, ids: list[list[int]], vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, model, radius: int, k: int) -> list[tuple[int, int, float]]:
    """(query, id, distance): the k nearest found of one block, ties to smaller ids, copies expanded."""
    bits, out = 64 * index.code.shape[1], []
    for qid, q, code in zip(query_ids.tolist(), queries, codes(queries, model)):
        reach = radius
        rows = index.within(code, reach)
        while len(rows) <= k and reach < bits:
            reach = min(bits, reach + bits // 16)
            rows = index.within(code, reach)
        d = distances(vectors[rows], q)
        if len(d) > k + 1:
            near = d <= np.partition(d, k)[k]
            rows, d = rows[near], d[near]
        best = sorted((s, i) for r, s in zip(rows.tolist(), d.tolist()) for i in ids[r] if i != qid)[:k]
        out += [(qid, i, s) for s, i in best]
    return out


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (double): finite, not all zero vectors of the commonest length, one per non-null id (the least)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("embedding") == (common.n if common else 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(rows: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, its k nearest other rows found.

    Vectors that are null, zero, hold null or non-finite components, or are not of the table's
    commonest length take no part, nor do null ids. A repeated id counts once, with the least of its
    vectors in array order. Equal vectors are indexed once with their k + 1 smallest ids, so copies
    cost nothing. Fewer rows than k give fewer neighbours; an empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    attach(rows.sparkSession)
    good = materialize(valid_vectors(rows.select("vec_id", "embedding")), "vectors")
    same = good.withColumn("hash", F.xxhash64("embedding"))
    first = same.withColumn("nth", F.row_number().over(Window.partitionBy("hash", "embedding").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    distinct = materialize(first.groupBy("hash", "embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select("hash", "ids", F.col("embedding").alias("vector")), "distinct-vectors")
    n_rows = distinct.count()
    near_sample = distinct.where(F.pmod(F.xxhash64("hash"), F.lit(max(1, n_rows))) < 2 * sample)  # about twice the bound
    taught = [r.vector for r in near_sample.orderBy(F.xxhash64("hash"), "vector").limit(sample).collect()]
    if not taught:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    taught = np.array(taught)
    model = learn_rotation(taught)
    radius = learn_radius(taught, model, k)
    blocks = max(6, math.ceil(n_rows / ROW_BLOCK))
    block = F.pmod("hash", F.lit(blocks)).cast("int").alias("block")
    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), F.array("vec_id").alias("ids"), F.col("embedding").alias("vector"))
    both = distinct.select(block, F.lit(0).alias("asks"), "ids", "vector").unionByName(asked)

    def search(frames):
        """Rows come by block, its vectors first: they are held, its queries pass by."""
        now, held, index = -1, [], None
        for pdf in frames:
            for number, part in pdf.groupby("block", sort=False):
                if number != now:
                    now, held, index = number, [], None
                mine = part[part["asks"] == 0]
                if len(mine):
                    held.append(mine)
                queries = part[part["asks"] == 1]
                if not len(queries) or not held:
                    continue
                if index is None:
                    ids = [list(x) for p in held for x in p["ids"]]
                    vectors = np.stack([v for p in held for v in p["vector"]])
                    index = SubstringIndex(codes(vectors, model))
                found = search_block(index, ids, vectors, np.array([x[0] for x in queries["ids"]]), np.stack(queries["vector"].to_numpy()), model, radius, k)
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = both.repartition("block").sortWithinPartitions("block", "asks").mapInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
