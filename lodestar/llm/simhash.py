"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, verified Hamming links, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import _text
from lodestar.llm._spark import attach, materialize
from lodestar.llm.components import component_labels

#: Five blocks: fingerprints that differ in at most three bits agree on at least two of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(5), 2))
#: A block pair with more fingerprints than this is split again by the bits outside the pair.
BUCKET_ROWS = 1024
#: Eight 5-bit pieces of those bits, of which five agree: at most 2^15 fingerprints share a piece key.
PIECES = tuple(combinations(range(8), 5))
DISTANCE = 3


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned fingerprints of consecutive texts."""
    low = _text.LOWER[data]
    start, end, first = _text.word_bounds(low, offsets)
    n_words = np.diff(first)
    out = np.zeros(len(n_words), np.uint64)
    if not len(start):
        return out
    # The words with single spaces between them, over all texts of the run.
    lengths = end - start
    flat = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flat[_text.ranges(begin, lengths)] = low[_text.ranges(start, lengths)]
    stop, joined = begin + lengths, flat.tobytes()
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    heads = _text.ranges(first[:-1], n_shingles)
    tails = np.minimum(heads + width, np.repeat(first[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(begin[heads].tolist(), stop[tails].tolist())), np.uint64, len(heads))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = n_shingles > 0
    marks = np.concatenate([[0], np.cumsum(n_shingles[some])[:-1]])
    ones = np.add.reduceat(bits, marks, axis=0, dtype=np.int64)
    over = (2 * ones > n_shingles[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, carry: str = "doc_id") -> DataFrame:
    """(doc_id, fp long): null and wordless texts have fingerprint 0. `carry` is the long column to keep for doc_id."""
    attach(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint_batch(data, marks, width, seed) for _, data, marks in _text.text_runs(batch, "text", 600_000)]
            if fps:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(fps).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(carry).alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _bits(value: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << n) - 1))


def _keys(fp: Column) -> Column:
    """For each block pair: its key (with the pair's number) and the other bits, side by side."""
    def one(k: int, pair: tuple[int, int]) -> Column:
        key, rest, shift = F.lit(k).cast("long"), F.lit(0).cast("long"), 0
        for b, (at, n) in enumerate(BLOCKS):
            if b in pair:
                key = F.shiftleft(key, 13).bitwiseOR(_bits(fp, at, n))
            else:
                rest = rest.bitwiseOR(F.shiftleft(_bits(fp, at, n), shift))
                shift += n
        return F.struct(key.alias("key"), rest.alias("rest"))

    return F.array(*[one(k, p) for k, p in enumerate(PAIRS)])


def _sub_keys(rest: Column) -> Column:
    def one(k: int, pieces: tuple[int, ...]) -> Column:
        out = F.lit(k + 1).cast("long")
        for p in pieces:
            out = F.shiftleft(out, 5).bitwiseOR(_bits(rest, 5 * p, 5))
        return out

    return F.array(*[one(k, p) for k, p in enumerate(PIECES)])


def bucket_links(rest: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of rows within `distance` bits in each run of equal `group`."""
    n = len(rest)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(bounds)
    a, b = [], []
    small = np.repeat(sizes <= 64, sizes)
    for lag in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        if not len(i):
            break
        i = i[np.bitwise_count(rest[i] ^ rest[i + lag]) <= distance]
        a.append(i)
        b.append(i + lag)
    for g in np.flatnonzero(sizes > 64):
        lo, hi = bounds[g], bounds[g + 1]
        label = np.arange(hi - lo)
        for at in range(lo, hi, 256):
            near = np.bitwise_count(rest[at : at + 256, None] ^ rest[None, at:hi]) <= distance
            i, j = np.nonzero(near)
            keep = i < j
            i, j = i[keep] + at - lo, j[keep] + at - lo
            label = _text.components(hi - lo, np.concatenate([i, np.arange(hi - lo)]), np.concatenate([j, label]))
        i = np.flatnonzero(label != np.arange(hi - lo))
        a.append(i + lo)
        b.append(label[i] + lo)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = _text.components(n, np.concatenate(a), np.concatenate(b))
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def _link_partition(frames):
    """Rows come sorted by key and sub; a group that goes on in the next batch is held back."""
    held = None
    def out(pdf):
        group = np.cumsum(np.concatenate([[True], (pdf["key"].values[1:] != pdf["key"].values[:-1]) | (pdf["sub"].values[1:] != pdf["sub"].values[:-1])]))
        i, j = bucket_links(pdf["rest"].values, group)
        fp = pdf["fp"].values
        return pd.DataFrame({"u": fp[i], "v": fp[j]})

    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        held = None
        if not len(pdf):
            continue
        last = (pdf["key"].values == pdf["key"].values[-1]) & (pdf["sub"].values == pdf["sub"].values[-1])
        cut = int(np.flatnonzero(last)[0])
        held = pdf.iloc[cut:]
        if cut:
            yield out(pdf.iloc[:cut])
    if held is not None and len(held):
        yield out(held)


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between different fingerprints of column fp that span every component at 3 bits.

    A bucket's rows are bounded: block pairs over BUCKET_ROWS are split by 56 piece keys, each of
    which leaves 15 bits free. Within a bucket only a spanning forest is emitted.
    """
    attach(fps.sparkSession)
    keyed = fps.select("fp", F.inline(_keys(F.col("fp"))))
    hot = keyed.groupBy("key").count().where(F.col("count") > BUCKET_ROWS).select("key", F.lit(True).alias("hot"))
    split = keyed.join(hot, "key", "left").select("key", "fp", "rest", F.explode(F.when(F.col("hot"), _sub_keys(F.col("rest"))).otherwise(F.array(F.lit(0).cast("long")))).alias("sub"))
    return split.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInPandas(_link_partition, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Links join fingerprints that differ in at most three bits; equal texts and wordless texts link
    through equal fingerprints. Null or repeated doc_ids keep their rows (null never becomes a
    component_id unless the component has no other id). Empty tables give empty results; other columns
    are not read, whatever their names.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    roots = component_labels(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, whatever its ids: the smallest doc_id (null last), then the smallest text hash.

    Wordless texts are one component. Columns unchanged, whatever their names; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    prints = materialize(fingerprints(rows, carry="hash").distinct().select(F.col("doc_id").alias("hash"), "fp"), "fingerprints")
    roots = component_labels(links(prints.select("fp").distinct()))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(F.col("hash").alias("of"), F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash"))
    chosen = rows.select("doc_id", "hash").join(rooted, F.col("hash") == F.col("of")).groupBy("root").agg(first.alias("one"))
    chosen = chosen.select(F.col("one.doc_id").alias("keep"), F.col("one.hash").alias("of"))
    marked = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = marked.join(chosen, F.col("id").eqNullSafe(F.col("keep")) & (F.col("hash") == F.col("of")), "left_semi")
    return kept.dropDuplicates(["id", "hash"]).select("row.*")
