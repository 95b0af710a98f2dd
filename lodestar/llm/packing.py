"""Packing by cutting stock: column generation over a length histogram, knapsack pricing, rounding.

Documents become token ids, cut only where they exceed a sequence. Piece lengths fall into classes
(256 of 8 tokens by default); the linear program sees only that histogram, so its size does not
depend on the corpus. Its rounded patterns are dealt to the pieces by their rank within the class.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm._spark import attach, materialize

CAPACITY, STEP, END_ID = 2048, 8, 1
#: Ids of at most so many words are kept by a worker; beyond it the cache starts anew.
CACHED = 500_000
_LOOSE, _CUT = regex.compile(r"\s |^ "), regex.compile(r"(?<=\S)(?= )")


class WordIds(dict):
    """Word -> little-endian ids of " word", asked of the tokenizer once each.

    A byte-level BPE never merges across the start of " word", so a text's ids are those of its
    pieces cut before each space that follows a non-space. With `ranks` (the same vocabulary as
    merge ranks, and its pattern), words of Latin letters go through the faster rank encoder.
    """

    def __init__(self, tokenizer_file: str, ranks: tuple[str, str] | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.ranked = Tokenizer.from_file(tokenizer_file), None
        self.tokenizer.encode_special_tokens = True
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={}).encode_ordinary

    def piece(self, text: str) -> bytes:
        if self.ranked and (text.isascii() or max(text) < "\u0250"):
            return array("I", self.ranked(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        ids = self[word] = self.piece(" " + word)
        return ids

    def encode(self, text: str) -> bytes:
        if _LOOSE.search(text):
            return b"".join([self[p[1:]] if p[:1] == " " else self.piece(p) for p in _CUT.split(text)])
        head, *tail = text.split(" ")
        return self.piece(head) + b"".join(map(self.__getitem__, tail))


_encoders: dict[tuple, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_file: str, ranks: tuple[str, str] | None = None, capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, cls, and (task, nth of cls in task)."""
    attach(docs.sparkSession)

    def run(batches):
        if (tokenizer_file, ranks) not in _encoders:
            _encoders[tokenizer_file, ranks] = WordIds(tokenizer_file, ranks)
        encoder = _encoders[tokenizer_file, ranks]
        seen, task = np.zeros(capacity // step + 2, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(ids), 256):
                rows = []
                for doc, text in zip(ids[at : at + 256], texts[at : at + 256]):
                    raw = encoder.encode(text or "") + end
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        part = raw[4 * start : 4 * (start + capacity)]
                        cls = -(-(len(part) // 4) // step)
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, cls, task, int(seen[cls])))
                        seen[cls] += 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "task", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls long, task long, nth long")


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (count per class 1..m) of the greatest dual value."""
    m = len(duals)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for room in range(1, capacity + 1):
        c = np.arange(1, min(m, room) + 1)
        worth = best[room - c] + duals[c - 1]
        k = int(worth.argmax())
        best[room], pick[room] = (worth[k], k + 1) if worth[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    pattern, room = np.zeros(m, int), capacity
    while room > 0:
        if pick[room]:
            pattern[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def cutting_stock(demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[np.ndarray, int]]:
    """[(pattern, times)] covering `demand` pieces of class sizes 1..m exactly, by column generation.

    Revised simplex on the restricted master (one row per class in use), columns priced by knapsack;
    stops at optimality or when Farley's bound is within `gap`. The solution is rounded down and the
    rest, at most a few pieces per pattern, is packed by falling size.
    """
    demand = np.asarray(demand, np.int64)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    sizes, need = used + 1, demand[used].astype(float)
    m = len(used)
    columns = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1 / np.diag(columns)), need / np.diag(columns)
    for _ in range(most):
        duals = inverse.sum(axis=0)
        full = np.zeros(int(sizes[-1]))
        full[used] = np.maximum(duals, 0)
        value, pattern = price(full, capacity)
        if value <= 1 + gap:
            break
        column = pattern[used].astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * step
        x[out] = theta
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    left, plan = demand.copy(), []
    for k in range(m):
        pattern = np.zeros(len(demand), np.int64)
        pattern[used] = columns[:, k].astype(np.int64)
        times = int(min(np.floor(x[k] + 1e-7), (left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for c in np.flatnonzero(left)[::-1]:
            n = min(left[c], room // (c + 1))
            pattern[c] = n
            room -= n * (c + 1)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def pack(docs: DataFrame, tokenizer_file: str, ranks: tuple[str, str] | None = None, capacity: int = CAPACITY, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Null and empty texts are one piece of the end id; repeated rows are packed separately; an empty
    table gives an empty result; other columns are not read, whatever their names. Sequences hold whole
    pieces end to end from offset 0.
    """
    cut = materialize(pieces(docs, tokenizer_file, ranks, capacity, step, end_id), "pieces")
    counts = cut.groupBy("task", "cls").count()
    demand = np.zeros(capacity // step, np.int64)
    for row in counts.groupBy("cls").agg(F.sum("count").alias("n")).collect():  # one row per class
        demand[row.cls - 1] = row.n
    dealt, base, at = [], 0, np.zeros(len(demand), np.int64)
    for pattern, times in cutting_stock(demand, capacity // step):
        for c in np.flatnonzero(pattern):
            dealt.append((int(c + 1), int(at[c]), int(at[c] + pattern[c] * times), int(pattern[c]), base))
            at[c] += pattern[c] * times
        base += times
    table = docs.sparkSession.createDataFrame(dealt, "_cls long, _from long, _to long, _each long, _base long")
    before = Window.partitionBy("cls").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "cls", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = cut.join(offsets, ["task", "cls"]).withColumn("_rank", F.col("nth") + F.col("_before"))
    # The pattern table has at most classes^2 rows, whatever the corpus.
    placed = ranked.join(F.broadcast(table), (F.col("cls") == F.col("_cls")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")))
    along = Window.partitionBy("sequence_id").orderBy(F.col("cls").desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long").alias("offset"))
