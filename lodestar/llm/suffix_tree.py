"""LM scoring with a probabilistic suffix tree.

The symbols are the bytes of a text's words, lower-cased and joined by one space, and an end symbol;
a context is the up to five bytes before a symbol. Contexts are kept by a divergence test against
their suffix, next-symbol distributions are smoothed with those of the longest kept suffix, and a
text is scored along the longest kept context of each symbol.

The tree is a table, not an object: it has as many contexts as the corpus supports, and its levels
are joined in Spark. A gram (five bytes and the symbol after them) has one probability, so texts meet
theirs by gram: those of the commonest grams travel with the scorer, all others are joined. Words,
whose counts give the base a report compares with, are met in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import _text
from lodestar.llm._spark import attach, materialize

#: Bytes of the longest context: with the symbol after it a gram is one 64-bit key.
DEPTH = 5
#: A context is kept if its gain in nats over its suffix exceeds this per distinct next symbol.
GAIN_PER_SYMBOL = 3.0
#: Words and grams whose values are sent to the scorers; those of all others are joined.
COMMON_WORDS, COMMON_GRAMS = 1 << 18, 1 << 19
#: The end token's key among word hashes, and the symbol that ends a text and stands before it.
END, EDGE = np.uint64(0x1D8E4E27C47D124F), 10


def symbols(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, first gram of each text, word hashes, first word of each text) of consecutive texts."""
    low = _text.LOWER[data]
    start, end, first = _text.word_bounds(low, marks)
    lengths, n_words = end - start, np.diff(first)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    # Each text: DEPTH edges, its words with a space between, one edge.
    sizes = np.bincount(text_of, weights=lengths, minlength=len(n_words)).astype(np.int64) + np.maximum(n_words - 1, 0)
    begin = np.concatenate([[0], np.cumsum(sizes + DEPTH + 1)])
    flat = np.full(int(begin[-1]), 32, np.uint8)
    edges = begin[:-1, None] + np.arange(DEPTH)
    flat[edges.ravel()] = EDGE
    flat[begin[1:] - 1] = EDGE
    run = np.cumsum(lengths + 1) - (lengths + 1)
    if len(run):
        head = np.zeros(len(n_words), np.int64)
        some = n_words > 0
        head[some] = run[first[:-1][some]]
        flat[_text.ranges(begin[text_of] + DEPTH + run - head[text_of], lengths)] = low[_text.ranges(start, lengths)]
    grams = flat[DEPTH:].astype(np.uint64) if len(flat) > DEPTH else np.zeros(0, np.uint64)
    for d in range(1, DEPTH + 1):
        grams |= flat[DEPTH - d : len(flat) - d].astype(np.uint64) << np.uint64(8 * d)
    places = _text.ranges(begin[:-1], sizes + 1)
    return grams[places], np.concatenate([[0], np.cumsum(sizes + 1)]), _text.word_hashes(low, start, end), first


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts (one column for training texts, one for all)."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n[order], head) if len(keys) else n


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word boolean, key, n, seen long): how often each word and gram occurs in training texts (n) and all (seen).

    docs: text, training (boolean). Words are counted in training texts only.
    """
    attach(docs.sparkSession)

    def count(batches):
        held: dict[bool, list] = {True: [], False: []}

        def add(word: bool, keys: np.ndarray, training: bool) -> None:
            unique, n = np.unique(keys, return_counts=True)
            held[word].append((unique, np.stack([n * training, n], axis=1)))

        def flush(word: bool):
            keys, n = _counted(held[word])
            held[word] = []
            for at in range(0, len(keys), 100_000):
                part, m = keys[at : at + 100_000], n[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), word)), pa.array(part.view(np.int64)), pa.array(m[:, 0]), pa.array(m[:, 1])], ["word", "key", "n", "seen"])

        for batch in batches:
            flags = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
            for rows, data, marks in _text.text_runs(batch):
                grams, first_gram, words, first = symbols(data, marks)
                train = flags[rows]
                of_training = np.repeat(train, np.diff(first_gram))
                add(True, np.concatenate([words[np.repeat(train, np.diff(first))], np.full(int(train.sum()), END)]), True)
                add(False, grams[of_training], True)
                add(False, grams[~of_training], False)
                for word in (True, False):
                    if sum(len(k) for k, _ in held[word]) > 1_000_000:
                        held[word] = [_counted(held[word])]
                        if len(held[word][0][0]) > 1_000_000:  # spill to the shuffle, which adds up
                            yield from flush(word)
        for word in (True, False):
            if held[word]:
                yield from flush(word)

    counted = docs.select("text", "training").mapInArrow(count, "word boolean, key long, n long, seen long")
    return counted.groupBy("word", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


class Table:
    """Open-addressing hash table over 64-bit keys, looked up many at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            take, s = todo[free], slot[free]
            self.at[s] = take  # the last of those that want one slot gets it
            self.slots[slot[free]] = keys[self.at[s]]
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        slot = self._slot(keys)
        out = self.at[slot]
        wrong = np.flatnonzero((out >= 0) & (self.slots[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.at[slot]
            still = (out[wrong] >= 0) & (self.slots[slot] != keys[wrong])
            wrong, slot = wrong[still], slot[still]
        return out


def gram_scores(grams: DataFrame, gain: float = GAIN_PER_SYMBOL) -> DataFrame:
    """(key, seen, log double): log10 P(symbol | longest kept context) of every gram (key, n, seen).

    One join and one window a level, from single symbols up to whole grams. A context's group has at
    most 256 rows (its next symbols), and so has a suffix's in the join, so no key is hot.
    """
    def suffix(d: int):
        return F.col("key").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))

    levels = {DEPTH: grams}
    for d in range(DEPTH - 1, -1, -1):
        levels[d] = materialize(levels[d + 1].groupBy(suffix(d).alias("key")).agg(F.sum("n").alias("n")), "grams")
    every = float(levels[0].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    smooth = (F.col("n") + 0.5) / F.lit(every + 128.0)
    below = levels[0].select("key", smooth.alias("p"), F.try_divide(F.col("n"), F.lit(every)).alias("share"))
    for d in range(1, DEPTH + 1):
        context = Window.partitionBy(F.shiftrightunsigned("key", 8))
        lower = below.select(F.col("key").alias("_key"), F.col("p").alias("_p"), F.col("share").alias("_share"))
        met = levels[d].join(lower, suffix(d - 1) == F.col("_key"))
        # Gain over the suffix: sum n ln(n / total / share) = sum n ln(n / share) - total ln total.
        met = met.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.count_if(F.col("n") > 0).over(context)).withColumn(
            "gain", F.coalesce(F.sum(F.col("n") * F.ln(F.try_divide("n", "_share"))).over(context), F.lit(0.0)) - F.coalesce(F.col("total") * F.ln("total"), F.lit(0.0))
        )
        kept = (F.col("kinds") > 0) & (F.col("gain") > gain * F.col("kinds"))
        mixed = F.try_divide(F.col("n") + F.col("kinds") * F.col("_p"), F.col("total") + F.col("kinds"))
        below = met.select("key", F.when(kept, mixed).otherwise(F.col("_p")).alias("p"), F.try_divide("n", "total").alias("share"), *(["seen"] if d == DEPTH else []))
        below = materialize(below, "levels")
    return below.select("key", "seen", F.log10("p").alias("log"))


def commonest(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the greatest `by`, at most `most`: cut by a histogram of at most 1,024 classes of counts."""
    size = F.floor(F.log2(F.col(by)) * 16)
    left, least = most, 1 << 20
    for row in sorted(counts.groupBy(size.alias("size")).count().where("size is not null").collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["size"]
    return counts.where(size >= least)


class Known:
    """Values by key that every scoring task needs; a worker builds the table once."""

    def __init__(self, rows: DataFrame) -> None:
        """rows: key, log; a bounded number."""
        found = rows.select("key", "log").toArrow().combine_chunks()
        self.keys, self.logs = found["key"].to_numpy().view(np.uint64), found["log"].to_numpy()
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def sums(self, keys: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Per text: summed values and how many keys have one; and (text, key, times) of the other keys."""
        self.table = self.table or Table(self.keys)
        at = self.table.find(keys)
        hit = at >= 0
        total = np.bincount(text_of[hit], weights=self.logs[at[hit]] if len(self.logs) else None, minlength=n).astype(float)
        text, key = text_of[~hit], keys[~hit]
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.zeros(0, np.int64)
        return total, np.bincount(text_of[hit], minlength=n), (text[head], key[head], np.diff(np.append(head, len(key))))


def score_texts(docs: DataFrame, is_training: str = "crc32(coalesce(cast(doc_id as string), '')) % 10 <> 0", common_words: int = COMMON_WORDS, common_grams: int = COMMON_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts score as empty ones (one token, the end); repeated rows are scored alike and each
    counts as training text; an empty table gives an empty result; other columns are not read, whatever
    their names. The two numbers of common keys
    decide what is sent and what is joined, not any score.
    """
    spark = attach(docs.sparkSession)
    counts = materialize(corpus_counts(docs.select("text", F.expr(is_training).alias("training"))), "corpus-counts")
    words = counts.where("word").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = float(np.log10(total + 0.1 * (distinct + 1)))
    grams = gram_scores(counts.where("not word").select("key", "n", "seen"))
    word_log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - F.lit(floor)
    model = spark.sparkContext.broadcast((Known(commonest(words, "n", common_words).select("key", word_log.alias("log"))), Known(commonest(grams, "seen", common_grams))))
    part = "uid long, doc_id long, n_tokens long, n_known long, base_score double, score double, word boolean, key long, times long"
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in part.split(", ")])

    def score(batches):
        known_words, known_grams = model.value
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows, data, marks in _text.text_runs(batch):
                grams, first_gram, hashes, first = symbols(data, marks)
                n = rows.stop - rows.start
                text_of = np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])
                base, n_known, rare_words = known_words.sums(np.concatenate([hashes, np.full(n, END)]), text_of, n)
                scores, _, rare_grams = known_grams.sums(grams, np.repeat(np.arange(n), np.diff(first_gram)), n)
                none = [pa.nulls(n, f.type) for f in list(schema)[6:]]
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(n)), batch.column("doc_id").slice(rows.start, n), pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(base), pa.array(scores), *none], schema=schema)
                for word, (text, key, times) in ((True, rare_words), (False, rare_grams)):
                    for at in range(0, len(key), 100_000):
                        to = min(at + 100_000, len(key))
                        none = [pa.nulls(to - at, f.type) for f in list(schema)[1:6]]
                        yield pa.RecordBatch.from_arrays([pa.array(uid + text[at:to]), *none, pa.array(np.full(to - at, word)), pa.array(key[at:to].view(np.int64)), pa.array(times[at:to])], schema=schema)
                uid += n

    parts = materialize(docs.select("doc_id", "text").mapInArrow(score, part), "scores")
    values = words.select(F.lit(True).alias("word"), "key", word_log.alias("log")).union(grams.select(F.lit(False), "key", "log"))
    rare = parts.where("key is not null").select("uid", "word", "key", "times").join(values, ["word", "key"], "left")
    log = F.coalesce("log", F.lit(float(np.log10(0.1)) - floor))  # a word without training occurrences; every gram has its value
    more = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("word"), F.col("times") * log)).alias("_base"), F.sum(F.when(~F.col("word"), F.col("times") * log)).alias("_score"),
        F.sum(F.when(F.col("word") & F.col("log").isNotNull(), F.col("times"))).alias("_known"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.where("key is null").join(more, "uid", "left").select(
        "doc_id", (~F.expr(is_training)).alias("held_out"), "n_tokens", plus("n_known", "_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "_base").alias("base_score"), plus("score", "_score").alias("score"),
    )
