"""Document fingerprints: weighted SimHash over word pairs, and permuted block tables to find near ones.

A text's terms are its pairs of neighbouring words (its word, if it has one only); each votes with a
weight that grows with the logarithm of its count on 128 signed bits. Fingerprints within a Hamming
radius below the number of blocks agree on at least one block, so a table keyed by each block, moved to
the front, finds all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import _text
from lodestar.llm._spark import attach, materialize

#: Eight blocks of 16 bits: a radius of up to seven leaves one block alike.
BLOCKS, RADIUS = 8, 7
#: Votes are whole numbers, so that no order of summation changes a bit.
UNIT = 64
_ODD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def vote(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2) unsigned: the fingerprints of consecutive texts; wordless texts have zeros."""
    low = _text.LOWER[data]
    start, end, first = _text.word_bounds(low, offsets)
    n_words = np.diff(first)
    out = np.zeros((len(n_words), 2), np.uint64)
    if not len(start):
        return out
    words = _text.word_hashes(low, start, end)
    n_terms = np.where(n_words > 1, n_words - 1, n_words)
    heads, text = _text.ranges(first[:-1], n_terms), np.repeat(np.arange(len(n_words)), n_terms)
    pairs = np.append(_text.window_hashes(words, 2), _text.mix(words[-1:]))
    term = np.where(np.repeat(n_words > 1, n_terms), pairs[heads], _text.mix(words[heads]))
    # Equal terms of a text: sorted by a hash of both, then counted.
    key = _text.mix(term ^ (text.astype(np.uint64) * _ODD))
    order = np.argsort(key, kind="stable")
    marks = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    counts = np.diff(np.append(marks, len(order)))
    once = order[marks]
    by_text = np.argsort(text[once], kind="stable")
    once, counts = once[by_text], counts[by_text]
    weight = np.rint(UNIT * (1 + np.log(counts))).astype(np.int32)
    halves = np.stack([term[once], _text.mix(term[once] + _SECOND)], axis=1)
    some = np.flatnonzero(n_terms)
    begin = np.searchsorted(text[once], some)
    for at in range(0, len(some), 64):  # a few texts at a time: the signed bits take 512 bytes a term
        lo, hi = begin[at], begin[at + 64] if at + 64 < len(some) else len(once)
        signs = np.unpackbits(np.ascontiguousarray(halves[lo:hi]).view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
        signs *= weight[lo:hi, None]
        votes = np.add.reduceat(signs, begin[at : at + 64] - lo, axis=0, dtype=np.int64)
        out[some[at : at + 64]] = np.packbits((votes > 0).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def text_fingerprints(texts: list[str]) -> np.ndarray:
    """(texts, 2) unsigned, in runs of bounded bytes."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    runs = [vote(data, marks) for _, data, marks in _text.text_runs(batch, "text")]
    return np.concatenate(runs) if runs else np.zeros((0, 2), np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the voters' weights as the share of differing bits estimates it, at least 0."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.where(apart >= 64, 0.0, np.cos(np.pi * apart / 128))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of the following one (or all)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _hex(prints: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in prints.tolist()]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "hi", "lo"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long"


def _columns(ids: list, texts: list[str], following: list[str], own: np.ndarray, nexts: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = text_fingerprints(changed)
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    signed = own.view(np.int64)
    values = [ids, [len(t) for t in texts], shas, _hex(own), _hex(other), likeness(own, other), likeness(own, nexts), signed[:, 0], signed[:, 1]]
    return [pa.array(v, t) for v, t in zip(values, _TYPES)]


def _walk(batches):
    """Rows come in order: each meets the next one. The first and the last text of the partition go along unmet."""
    task, held = TaskContext.get().partitionId(), None
    edge = lambda doc, side, text: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([doc, *[None] * 8, task, side, text], [*_TYPES, pa.int32(), pa.int32(), pa.string()])], [*_NAMES, "task", "side", "text"])
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t.decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        if not ids:
            continue
        own = text_fingerprints(texts)
        if held is None:
            yield edge(None, 0, texts[0])
        else:
            ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
        if len(ids) > 1:
            n = len(ids) - 1
            yield pa.RecordBatch.from_arrays([*_columns(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], [*_NAMES, "task", "side", "text"])
        held = ids[-1], texts[-1], own[-1:]
    if held is not None:
        yield edge(held[0], 1, held[1])


def _meet(batches):
    """Rows (doc_id, text, following) whose two texts were in different partitions."""
    for batch in batches:
        ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
        if ids:
            yield pa.RecordBatch.from_arrays(_columns(ids, texts, following, text_fingerprints(texts), text_fingerprints(following)), _NAMES)


def _block(hi: Column, lo: Column, k: int) -> Column:
    half = hi if k < BLOCKS // 2 else lo
    return F.shiftrightunsigned(half, 16 * (k % (BLOCKS // 2))).bitwiseAND(F.lit(0xFFFF)).cast("int")


def within(asked: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(asked_hi, asked_lo, hi, lo, n): all fingerprints within `radius` bits of each asked one, itself included.

    asked: distinct hi, lo; prints: distinct hi, lo and n. One table per block, keyed by it; a pair that
    agrees on several blocks is met in the table of the first. radius is at most 7.
    """
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 1}")
    keyed = lambda rows: rows.select("*", F.posexplode(F.array(*[_block(F.col("hi"), F.col("lo"), k) for k in range(BLOCKS)])).alias("block", "key"))
    left = keyed(asked.select("hi", "lo")).select("block", "key", F.col("hi").alias("asked_hi"), F.col("lo").alias("asked_lo"))
    met = left.join(keyed(prints.select("hi", "lo", "n")), ["block", "key"])
    apart = F.bit_count(F.col("hi").bitwiseXOR(F.col("asked_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("asked_lo")))
    first = F.lit(BLOCKS)
    for k in reversed(range(BLOCKS)):
        first = F.when(_block(F.col("hi"), F.col("lo"), k) == _block(F.col("asked_hi"), F.col("asked_lo"), k), k).otherwise(first)
    return met.where((apart <= radius) & (F.col("block") == first)).select("asked_hi", "asked_lo", "hi", "lo", "n")


def document_fingerprints(docs: DataFrame, every: int = 100, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row.

    The next document is the one after it by falling doc_id (nulls last; rows of one doc_id by the hash of
    their texts, then the text); after the last comes the first, so a single row follows itself. n_near:
    for rows whose doc_id is divisible by `every`, the other rows with a fingerprint within `radius` bits;
    null for the rest. Null texts are empty, and wordless ones have fingerprint zero; texts are taken
    whole; an empty table gives an empty result; other columns are not read, whatever their names.

    Rows are range-partitioned, so no id or text needs a task of its own; the texts at the partitions'
    edges (two a partition) are joined afterwards.
    """
    attach(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    walked = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(_walk, f"{_SCHEMA}, task int, side int, text string")
    parts = materialize(walked, "fingerprinted")
    firsts = parts.where("side = 0").select("task", F.col("text").alias("following"))
    tasks = firsts.select("task")  # one row a partition
    line = Window.orderBy("task")
    after = tasks.select(F.col("task").alias("of"), F.coalesce(F.lead("task").over(line), F.min("task").over(line)).alias("task"))
    lasts = parts.where("side = 1").select("doc_id", "text", F.col("task").alias("of"))
    edges = lasts.join(after, "of").join(firsts, "task").select("doc_id", "text", "following").mapInArrow(_meet, _SCHEMA)
    found = parts.where("side is null").select(*_NAMES).unionByName(materialize(edges, "edges"))
    is_asked = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    prints = found.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    near = within(found.where(is_asked).select("hi", "lo").distinct(), prints, radius)
    counted = near.groupBy(F.col("asked_hi").alias("hi"), F.col("asked_lo").alias("lo")).agg((F.sum("n") - 1).alias("n_near"))
    asked = found.where(is_asked).join(counted, ["hi", "lo"], "left")
    return asked.unionByName(found.where(~is_asked).withColumn("n_near", F.lit(None).cast("long"))).select(*_NAMES[:-2], "n_near")
