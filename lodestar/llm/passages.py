"""Substring dedup with compact windows: near-duplicate passages of different documents.

Tokens are five-word shingles. Under a hash function, every stretch of at least MIN_SHINGLES tokens
belongs to the compact window (left, right) of its least token: the spans of the Cartesian tree over
the token hashes. Windows of different texts that agree on their least token meet in a hash bucket
and are linked to the text with the smallest doc_id; the intervals of a pair are joined by position,
on both sides, and where enough hash functions agree the passages are verified by Jaccard similarity.

The earliest holder of a token need not hold the passage around it. So the windows of a text are also
intersected over pairs of hash functions: where no verified passage holds both least tokens of such an
intersection, it is compared with every earlier text that has the same two least tokens in one stretch.

Passages are verified on the lower 32 bits of their shingles' 64-bit hashes. Two different shingles agree
there with probability 2^-32: regions of 10,000 shingles each have 0.02 such agreements on average, where
a passage needs tens of agreements in one stretch.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import _text
from lodestar.llm._spark import attach, materialize

SHINGLE, MIN_WORDS, SIMILARITY, HASHES = 5, 50, 0.8, 4
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
#: Of the hash functions, so many must agree on a pair of texts: all do on an exact passage, and a
#: passage at similarity 0.8 is lost with probability 0.03, a closer or longer one with much less.
AGREE = 2
#: Documents per hash bucket: bounds what one task holds of the windows.
BUCKET_DOCS = 4000
#: Rows that are compared again at once: more holders of two least tokens are compared in blocks of so many.
BLOCK_ROWS = 50_000
_SEEDS = [np.uint64(0xA0761D6478BD642F + 0x9E3779B97F4A7C16 * k & 0xFFFFFFFFFFFFFFFF) for k in range(16)]


def _shingles(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive texts, and the first shingle of each text."""
    low = _text.LOWER[data]
    start, end, first = _text.word_bounds(low, marks)
    words = _text.word_hashes(low, start, end)
    every = _text.window_hashes(words, SHINGLE)
    count = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    return every[_text.ranges(first[:-1], count)], np.concatenate([[0], np.cumsum(count)])


def compact_windows(tokens: np.ndarray, first: np.ndarray, seed: np.uint64, least: int = MIN_SHINGLES) -> tuple[np.ndarray, ...]:
    """(key, text, left, right) of the compact windows of at least `least` tokens; bounds within the text, inclusive."""
    key, owner, _, left, right = placed_windows(tokens, first, seed, least)
    return key, owner, left, right


def placed_windows(tokens: np.ndarray, first: np.ndarray, seed: np.uint64, least: int = MIN_SHINGLES) -> tuple[np.ndarray, ...]:
    """(key, text, place, left, right): the compact windows and the places of their least tokens, within the text.

    Only least tokens of some stretch of `least` tokens have such a window, and so do all tokens
    that bound it; the Cartesian tree is built over those alone.
    """
    n = len(tokens)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in range(4)])
    if n < least:
        return none
    bits = np.uint64(max(20, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = _text.mix(tokens ^ seed)
    value = (key & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // least) * least, np.iinfo(np.uint64).max)
    padded[:n] = value
    blocks = padded.reshape(-1, least)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    smallest = np.minimum(behind[: n - least + 1], ahead[least - 1 : n])
    at = (smallest[text_of[: n - least + 1] == text_of[least - 1 :]] & low).astype(np.int64)
    if not len(at):
        return none
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    owner = text_of[at]
    places, values, owners = at.tolist(), value[at].tolist(), owner.tolist()
    stack: list[int] = []
    lefts, rights = first[owner].tolist(), (first[owner + 1] - 1).tolist()
    text = -1
    for i, (place, v, o) in enumerate(zip(places, values, owners)):
        if o != text:
            stack, text = [], o
        while stack and values[stack[-1]] > v:
            rights[stack.pop()] = place - 1
        if stack:
            lefts[i] = places[stack[-1]] + 1
        stack.append(i)
    left, right = np.array(lefts), np.array(rights)
    # A token that stays the least while it recurs has one window: its first and last place stand for it.
    again = (key[at][1:] == key[at][:-1]) & (owner[1:] == owner[:-1])
    head, tail = np.concatenate([[True], ~again]), np.concatenate([~again, [True]])
    left = left[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    at, owner, left, right = (x[head | tail] for x in (at, owner, left, right))
    return key[at], owner, at - first[owner], left - first[owner], right - first[owner]


_ROW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i4"), ("left", "<i4"), ("right", "<i4"), ("hash", "<i4")])
_SHARED = "key long, doc long, text long, at long, left long, right long, hash long, source_doc long, source_text long, source_left long, source_right long"
_REGION = ["text", "doc", "source_text", "source_doc", "left", "right", "source_left", "source_right"]
#: Shingles on either side of two least tokens: every stretch of MIN_SHINGLES that holds both lies inside.
REACH = MIN_SHINGLES - 1


def _shared(rows: np.ndarray) -> pd.DataFrame:
    """The rows of keys that several texts hold, each with the row of smallest doc (its centre); copies of a text count once."""
    rows = rows[np.lexsort((rows["at"], rows["text"], rows["doc"], rows["key"]))]
    once = np.lexsort((rows["doc"], rows["at"], rows["text"], rows["key"]))
    again = np.concatenate([[False], np.all([rows[n][once][1:] == rows[n][once][:-1] for n in ("key", "text", "at")], axis=0)])[: len(rows)]
    rows = rows[np.sort(once[~again])]
    head = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])[: len(rows)]
    group = np.cumsum(head) - 1
    center = rows[head][group]
    several = np.bincount(group, rows["text"] != center["text"]).astype(bool)[group] if len(rows) else head
    rows, center = rows[several], center[several]
    out = {n: rows[n].astype(np.int64) for n in _ROW.names}
    return pd.DataFrame(out | {f"source_{n}": center[n].astype(np.int64) for n in ("doc", "text", "left", "right")})


def _blobs(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows as one binary value for each bucket of keys."""
    home = (rows["key"].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    rows, cuts = rows[order], np.searchsorted(home[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(full), pa.array([rows[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "rows"])


def shared_windows(docs: DataFrame, hashes: int = HASHES, buckets: int | None = None) -> DataFrame:
    """Compact windows whose least token several texts have, with the window of the smallest doc that has it.

    `docs` has doc_id, text and _text (its hash). No holder is left out: those that turn out to have
    no passage in common with the centre are compared with each other by `open_pairs`.
    """
    attach(docs.sparkSession)
    buckets = buckets or max(32, -(-docs.count() // BUCKET_DOCS))

    def make(batches):
        for batch in batches:
            docs_, texts_ = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("_text").to_numpy(zero_copy_only=False)
            for rows, data, marks in _text.text_runs(batch):
                tokens, first = _shingles(data, marks)
                parts = []
                for j in range(hashes):
                    key, owner, at, left, right = placed_windows(tokens, first, _SEEDS[j])
                    part = np.empty(len(key), _ROW)
                    part["key"], part["doc"], part["text"] = _text.mix(key + np.uint64(j)), docs_[rows][owner], texts_[rows][owner]
                    part["at"], part["left"], part["right"], part["hash"] = at, left, right, j
                    parts.append(part)
                yield _blobs(np.concatenate(parts), buckets)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        return _shared(np.frombuffer(b"".join(pdf["rows"]), _ROW))

    made = docs.select("doc_id", "_text", "text").where("doc_id is not null").mapInArrow(make, "bucket long, rows binary")
    return made.groupBy("bucket").applyInPandas(meet, _SHARED)


def window_pairs(shared: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Regions (_REGION) of a text and a centre where enough hash functions agree: their windows joined by position.

    Windows of a pair belong together while they have a stretch of MIN_SHINGLES in common, first on
    the text's side, then on the source's; the functions are counted within such a region.
    """
    pair = ["text", "source_text"]
    part = shared.where("text != source_text")
    for name, left, right in (("_part", "left", "right"), ("_spot", "source_left", "source_right")):
        along = Window.partitionBy(*pair).orderBy(left, right)
        before = F.max(right).over(along.rowsBetween(Window.unboundedPreceding, -1))
        part = part.withColumn("_cut", F.coalesce((F.col(left) + REACH > before).cast("int"), F.lit(0)))
        part = part.withColumn(name, F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        pair = [*pair, name]
    agreed = F.bit_or(F.expr("shiftleft(1L, cast(hash as int))")).alias("hashes")
    hull = [f(c).alias(c) for c, f in (("doc", F.min), ("source_doc", F.min), ("left", F.min), ("right", F.max), ("source_left", F.min), ("source_right", F.max))]
    return part.groupBy(*pair).agg(*hull, agreed).where(F.bit_count("hashes") >= min(AGREE, hashes)).select(*_REGION)


_MEET = "key long, text long, doc long, lo long, hi long, left long, right long, open boolean"


def _intersections(windows: dict[str, np.ndarray], text_of: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], hashes: int) -> tuple[np.ndarray, ...]:
    """(key, text number, lo, hi, left, right, open) of windows of two hash functions in one stretch of a text.

    windows: key, at, left, right, hash; spans: text number, start, end of verified passages, by text
    and start. lo and hi are the places of the two least tokens.
    """
    far = np.int64(1) << 32
    out: list[tuple[np.ndarray, ...]] = []
    place = text_of * far + windows["at"]
    for i in range(hashes):
        for j in range(i + 1, hashes):
            a, b = np.flatnonzero(windows["hash"] == i), np.flatnonzero(windows["hash"] == j)
            b = b[np.argsort(place[b], kind="stable")]
            start, end = np.searchsorted(place[b], place[a] - REACH, "left"), np.searchsorted(place[b], place[a] + REACH, "right")
            a, b = np.repeat(a, end - start), b[_text.ranges(start, end - start)]
            left, right = np.maximum(windows["left"][a], windows["left"][b]), np.minimum(windows["right"][a], windows["right"][b])
            lo, hi = np.minimum(windows["at"][a], windows["at"][b]), np.maximum(windows["at"][a], windows["at"][b])
            good = (right - left >= REACH) & (left <= lo) & (hi <= right)
            key = _text.mix(_text.mix(windows["key"][a].view(np.uint64)) + windows["key"][b].view(np.uint64)).view(np.int64)
            out.append(tuple(x[good] for x in (key, text_of[a], lo, hi, left, right)))
    key, text, lo, hi, left, right = (np.concatenate(x) for x in zip(*out))
    of, s, e = spans
    # The furthest end of a text's passages that begin at or before lo.
    furthest = np.maximum.accumulate(of * far + e) if len(of) else e
    k = np.searchsorted(of * far + s, text * far + lo, "right") - 1
    settled = np.zeros(len(key), bool)
    some = k >= 0
    settled[some] = furthest[k[some]] > text[some] * far + hi[some]
    return key, text, lo, hi, left, right, ~settled


def intersections(shared: DataFrame, spans: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Rows (_MEET) for each pair of least tokens in one stretch of a text; open if no verified span (text, s, e) holds both."""
    listed = shared.groupBy("text").agg(F.min("doc").alias("doc"), F.collect_list(F.struct("key", "at", "left", "right", "hash")).alias("windows"))
    found = spans.groupBy(F.col("text").alias("_t")).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    names = [c.split()[0] for c in _MEET.split(", ")]

    def run(batches):
        for batch in batches:
            texts, docs = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("text", "doc"))
            lists, spans_ = batch.column("windows"), batch.column("spans").combine_chunks() if isinstance(batch.column("spans"), pa.ChunkedArray) else batch.column("spans")
            flat = lists.flatten()
            windows = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("key", "at", "left", "right", "hash")}
            text_of = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            inner, sizes = spans_.flatten(), pa.compute.list_value_length(spans_).fill_null(0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(batch)), sizes)
            key, text, *rest = _intersections(windows, text_of, (of, *(inner.field(n).to_numpy(zero_copy_only=False) for n in ("s", "e"))), hashes)
            for at in range(0, len(key), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (key, texts[text], docs[text], *rest)], names)

    return listed.join(found, F.col("text") == F.col("_t"), "left").select("text", "doc", "windows", "spans").mapInArrow(run, _MEET)


def _different(tokens: np.ndarray) -> np.ndarray:
    """For each stretch of MIN_SHINGLES, the places where a token stands for the first time in it."""
    order = np.argsort(tokens, kind="stable")
    before = np.full(len(tokens), -1)
    again = tokens[order][1:] == tokens[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    start, spot = np.arange(max(len(tokens) - MIN_SHINGLES, 0) + 1)[:, None], np.arange(len(tokens))
    return (spot >= start) & (spot < start + MIN_SHINGLES) & (before < start)


def _hopeful(known: np.ndarray, mark: np.ndarray, ask: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The asking rows with a stretch of MIN_SHINGLES of which SIMILARITY is known; rows that repeat a token (`twice`) are not judged."""
    sizes = np.diff(mark)
    sums = np.concatenate([[0], np.cumsum(known)])
    starts = _text.ranges(mark[:-1], np.maximum(sizes - REACH, 0))
    best, count = np.zeros(len(sizes), np.int64), np.maximum(sizes - REACH, 0)
    some = np.flatnonzero(count)
    if len(some):
        best[some] = np.maximum.reduceat(sums[starts + MIN_SHINGLES] - sums[starts], np.cumsum(count[some]) - count[some])
    return np.flatnonzero(ask & (sizes >= MIN_SHINGLES) & ((best >= SIMILARITY * MIN_SHINGLES) | twice))


def _promising(pair: np.ndarray, hit: np.ndarray, begin: np.ndarray, end: np.ndarray, similarity: float, least: int) -> np.ndarray:
    """The pairs of which some stretch of at least `least` shingles can have `similarity`.

    One item per hit (a shared shingle), by pair and place: its place, and the sums over both sides of the
    different shingles before and up to it. A stretch has no more shared shingles than hits, so it can pass
    only if (1 + similarity) * hits >= similarity * (different ones of both sides), which is an inequality
    between a term of its last hit and one of its first.
    """
    if not len(pair):
        return pair
    n = np.arange(len(pair)) - np.searchsorted(pair, pair)
    ends, starts = (1 + similarity) * (n + 1) - similarity * end, (1 + similarity) * n - similarity * begin
    # The greatest end from each hit on, within its pair: earlier pairs are lifted above later ones.
    lift = (pair[-1] - pair) * (ends.max() - ends.min() + 1.0)
    best = np.maximum.accumulate((ends + lift)[::-1])[::-1] - lift
    wide = int(hit.max()) + least + 1
    to = np.searchsorted(pair * wide + hit, pair * wide + hit + least - 1)
    inside = np.minimum(to, len(pair) - 1)
    return _distinct(pair[(to < len(pair)) & (pair[inside] == pair) & (best[inside] >= starts - 1e-6)])


def regrouped(rows: pd.DataFrame) -> list[tuple[int, ...]]:
    """Regions (_REGION) of every asking row with the earliest rows of its key that share a passage around the two tokens.

    Columns: key, ask (else the row may be a source), text, doc, lo, hi (of the two tokens within
    `around`), left, right, around (shingles, uint32). A stretch has SIMILARITY of its different
    shingles in common with its source, so one of its rarest must be among them; a phrase that the
    whole group has is therefore no candidate by itself, and a group costs about its real matches.
    A source is earlier by (doc, text); the search of a row ends at the first one that holds both tokens.
    Rows go on in rounds, each with its next few candidates, so that the bound which rules out nearly all
    of them is computed for many pairs at once.
    """
    rows = rows.sort_values(["key", "doc", "text"], kind="stable", ignore_index=True)
    arrays = [np.frombuffer(x, np.uint32) for x in rows["around"]]
    sizes = np.array([len(x) for x in arrays], np.int64)
    which = np.repeat(np.arange(len(rows)), sizes)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    ask, key, text, doc = rows["ask"].to_numpy(bool), rows["key"].to_numpy(), rows["text"].to_numpy(), rows["doc"].to_numpy()
    _, token = np.unique(_text.mix(_text.mix(key.view(np.uint64))[which] + flat), return_inverse=True)
    n_tokens, mark = int(token.max(initial=-1)) + 1, np.concatenate([[0], np.cumsum(sizes)])
    # Rows of one text are one holder; holders are numbered in order within the key.
    rank = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])[: len(rows)])
    # Each row's tokens in order, with their places; rows that repeat one.
    named = which * n_tokens + token
    spot = np.argsort(named, kind="stable")
    named = named[spot]
    twice = np.zeros(len(rows), bool)
    twice[which[spot[1:][named[1:] == named[:-1]]]] = True
    # Postings of the rows that may be sources, once per row and token, in order.
    source = ~ask[which]
    posting = _distinct(token[source].astype(np.int64) * len(rows) + which[source])
    holder, held = posting % max(len(rows), 1), posting // max(len(rows), 1)
    first = np.searchsorted(held, np.arange(n_tokens + 1))
    often = np.diff(first)[token]
    earliest = np.full(n_tokens, np.iinfo(np.int64).max)
    some = np.flatnonzero(np.diff(first))
    earliest[some] = rank[holder[first[:-1][some]]]
    # A row can match only if some stretch has SIMILARITY of its tokens from earlier holders.
    known = earliest[token] < rank[which]
    hopeful = _hopeful(known, mark, ask, twice)
    flag, found, sets = np.zeros(n_tokens, bool), [], {}
    at = {n: rows[n].to_numpy() for n in ("lo", "hi", "left", "right")}
    ranks, names = rank.tolist(), text.tolist()

    def walk(t: int):
        for a in range(first[t], first[t + 1], 64):
            yield from holder[a : min(a + 64, first[t + 1])].tolist()

    def earlier(i: int, lists: list):
        """Rows before row i in these lists, in order and once; none of its own text."""
        last = -1
        for k in heapq.merge(*lists):
            if ranks[k] >= ranks[i]:
                return
            if k != last and names[k] != names[i]:
                last = k
                yield k

    def candidates(i: int):
        """The earlier rows that hold one of the rarest shingles of a stretch of row i."""
        mine, count = token[mark[i] : mark[i + 1]], np.where(known[mark[i] : mark[i + 1]], often[mark[i] : mark[i + 1]], 0)
        ranked = np.argsort(count, kind="stable")
        different = _different(mine)[:, ranked]
        size = different.sum(axis=1)
        least = np.ceil(SIMILARITY * size - 1e-9)
        usable = different[:, count[ranked] > 0].sum(axis=1) >= least
        different, size, least = different[usable], size[usable], least[usable]
        rare = _distinct(mine[ranked[(different & (np.cumsum(different, axis=1) <= (size - least + 1)[:, None])).any(axis=0)]])
        return earlier(i, [walk(t) for t in rare.tolist()])

    def part(k: int, other: int) -> bool:
        """Whether a stretch of row k has SIMILARITY of its tokens in common with the other's."""
        mine, theirs = (token[mark[r] : mark[r + 1]] for r in (k, other))
        flag[theirs] = True
        held_by = flag[mine]
        flag[theirs] = False
        if k not in sets:
            if len(sets) > 2000:
                sets.clear()
            sets[k] = _different(mine)
        return bool((sets[k][:, held_by].sum(axis=1) >= SIMILARITY * sets[k].sum(axis=1)).any())

    def alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The numbers of those pairs of rows without repeats that can share a passage."""
        pair = np.repeat(np.arange(len(one)), sizes[one])
        mine = _text.ranges(mark[one], sizes[one])
        want = other[pair] * n_tokens + token[mine]
        to = np.minimum(np.searchsorted(named, want), len(named) - 1)
        both = named[to] == want
        pair, mine, theirs = pair[both], mine[both], spot[to[both]]
        hit, place = mine - mark[one][pair], theirs - mark[other][pair]
        return _promising(pair, hit, hit + place, hit + place + 2, SIMILARITY, MIN_SHINGLES)

    for begin in range(0, len(hopeful), 500):
        waiting, size = [(i, candidates(i)) for i in hopeful[begin : begin + 500].tolist()], 4
        while waiting:
            asked = [(i, rest, list(itertools.islice(rest, size))) for i, rest in waiting]
            one, other = np.repeat([i for i, *_ in asked], [len(x) for *_, x in asked]), np.array([k for *_, x in asked for k in x], np.int64)
            good, plain = twice[one] | twice[other], np.flatnonzero(~(twice[one] | twice[other]))
            good[[n for n in np.flatnonzero(good).tolist() if not (part(one[n], other[n]) and part(other[n], one[n]))]] = False
            good[plain[alike(one[plain], other[plain])]] = True
            settled = set()
            for n in np.flatnonzero(good).tolist():
                i, k = int(one[n]), int(other[n])
                if i in settled:
                    continue
                spans = verified_passages(arrays[i], arrays[k])
                if spans:
                    found.append((text[i], doc[i], text[k], doc[k], at["left"][i], at["right"][i], at["left"][k], at["right"][k]))
                if any(s <= at["lo"][i] and at["hi"][i] < e for s, e, *_ in spans):
                    settled.add(i)
            waiting = [(i, rest) for i, rest, x in asked if len(x) == size and i not in settled]
            size = min(2 * size, 64)
    return found


def open_pairs(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Regions (_REGION) of texts that share a passage around two least tokens that no passage found before holds.

    met: rows as _MEET; texts: text, shingles. Only keys with an open row after the first holder count. Rows
    of one key meet in blocks: each row may be a source in one block, and open rows ask in all of them.
    """
    place = F.struct("doc", "text")
    stats = met.groupBy(F.col("key").alias("_key")).agg(F.min(place).alias("_first"), F.max(F.when(F.col("open"), place)).alias("_last"), F.count("*").alias("_n")).where("_last > _first")
    kept = met.join(stats.select("_key", "_first", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks")), F.col("key") == F.col("_key"))
    kept = kept.withColumn("open", F.col("open") & (place > F.col("_first")))
    kept = materialize(kept.select("key", "_blocks", "text", "doc", "lo", "hi", "left", "right", "open"), "open")
    begin, end = F.greatest("left", F.col("hi") - REACH), F.least("right", F.col("lo") + REACH)
    near = kept.join(texts.select(F.col("text").alias("_t"), "shingles"), F.col("text") == F.col("_t")).select(
        "key", "_blocks", "text", "doc", (F.col("lo") - begin).alias("lo"), (F.col("hi") - begin).alias("hi"), "left", "right", "open", _slice("shingles", begin, end).alias("around")
    )
    mine = F.pmod(F.xxhash64("text"), F.col("_blocks")).cast("int")
    own = F.array(F.struct(mine.alias("block"), F.lit(False).alias("ask")))
    asks = F.when(F.col("open"), F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(True).alias("ask")))).otherwise(F.array().cast("array<struct<block:int,ask:boolean>>"))
    dealt = near.select("key", "text", "doc", "lo", "hi", "left", "right", "around", F.inline(F.concat(own, asks)))
    region = ", ".join(f"{n} long" for n in _REGION)

    def again(frames):
        held: list[pd.DataFrame] = []
        for pdf in frames:
            if not len(pdf):
                continue
            last = (pdf["key"].to_numpy() == pdf["key"].iloc[-1]) & (pdf["block"].to_numpy() == pdf["block"].iloc[-1])
            cut = int(np.argmax(last))
            if cut and sum(map(len, held)) + cut >= 4000:
                yield pd.DataFrame(regrouped(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)), columns=_REGION, dtype=np.int64)
                held = [pdf.iloc[cut:]]
            else:
                held.append(pdf)
        if held:
            yield pd.DataFrame(regrouped(pd.concat(held, ignore_index=True)), columns=_REGION, dtype=np.int64)

    dealt = dealt.withColumn("key", F.xxhash64("key", "block")).repartition("key").sortWithinPartitions("key")
    pairs = dealt.select("key", "block", "ask", "text", "doc", "lo", "hi", "left", "right", "around").mapInPandas(again, region)
    hull = [f(c).alias(c) for c, f in (("left", F.min), ("right", F.max), ("source_left", F.min), ("source_right", F.max))]
    return pairs.groupBy("text", "doc", "source_text", "source_doc").agg(*hull).select(*_REGION)


def _slice(shingles: str, begin, end):
    """Shingles begin to end (inclusive) of a binary column of uint32."""
    return F.substring(shingles, (4 * begin + 1).cast("int"), (4 * (end - begin + 1)).cast("int"))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def _stretches(hit: np.ndarray, place: np.ndarray, similarity: float, least: int) -> list[tuple[int, int]]:
    """Fewest maximal stretches (from, to) of a chain that hold all its stretches of `least` shingles at `similarity`.

    With distinct shingles the similarity of the stretch from hit i to hit j is its hits over the
    spans of both sides less the hits; that it suffices is an inequality between a term of j and one of i.
    """
    n = np.arange(len(hit))
    ends = (1 + similarity) * (n + 1) - similarity * (hit + place + 2)
    starts = (1 + similarity) * n - similarity * (hit + place)
    # The furthest j for each i: the last one whose greatest end from there on is not below the start.
    best = np.maximum.accumulate(ends[::-1])[::-1]
    reach = len(hit) - 1 - np.searchsorted(best[::-1], starts - 1e-9, "left")
    good = np.flatnonzero((reach >= n) & (hit[np.clip(reach, 0, None)] - hit + 1 >= least))
    good = good[np.concatenate([[True], reach[good][1:] > np.maximum.accumulate(reach[good])[:-1]])[: len(good)]]
    out: list[tuple[int, int]] = []
    for k, i in enumerate(good):
        j = int(reach[i]) + 1
        # Not needed if the next one also begins inside the last one taken.
        if out and k + 1 < len(good) and good[k + 1] < out[-1][1]:
            continue
        out.append((int(i), j))
    return out


def _firsts(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many tokens stand for the first time before each place (one more item than tokens); order: their stable argsort."""
    ranked, new = tokens[order], np.ones(len(tokens), bool)
    new[order[1:]] = ranked[1:] != ranked[:-1]
    return np.concatenate([[0], np.cumsum(new)])


def verified_passages(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, least: int = MIN_SHINGLES) -> list[tuple[int, int, int, int, float]]:
    """(start, end, source start, source end, similarity) of passages of shingles a that occur in b; ends exclusive.

    Shared shingles are chained while they shift by no more than a few; a chain counts if the sets
    of shingles it spans on both sides have that Jaccard similarity. If not, its maximal stretches
    that have it count, and what lies between them is tried again with smaller skips. Chains of which
    no part can have it are given up at once.
    """
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    hit = np.flatnonzero(high > low)
    if len(hit) < similarity * least:
        return []
    place = order[low[hit]]
    # A shingle that b holds more than once is taken where the last unambiguous one points to.
    alone = high[hit] - low[hit] == 1
    if alone.any() and not alone.all():
        guide = np.maximum.accumulate(np.where(alone, np.arange(len(hit)), -1))
        guide = np.where(guide < 0, np.flatnonzero(alone)[0], guide)
        for k in np.flatnonzero(~alone):
            spots, aim = order[low[hit[k]] : high[hit[k]]], hit[k] + place[guide[k]] - hit[guide[k]]
            at = int(np.searchsorted(spots, aim))
            place[k] = min(spots[max(at - 1, 0) : at + 1], key=lambda x: abs(x - aim))
    own, theirs, found = _firsts(a, np.argsort(a, kind="stable")), _firsts(b, order), []

    def passes(hit: np.ndarray, place: np.ndarray) -> bool:
        s, e, p, q = int(hit[0]), int(hit[-1]) + 1, int(place.min()), int(place.max()) + 1
        one, two = _distinct(a[s:e]), _distinct(b[p:q])
        all_ = np.sort(np.concatenate([one, two]))
        both = int((all_[1:] == all_[:-1]).sum())
        score = both / (len(all_) - both)
        if e - s < least or score < similarity:
            return False
        found.append((s, e, p, q, score))
        return True

    def search(hit: np.ndarray, place: np.ndarray, skips: tuple[int, ...]) -> None:
        if len(hit) < similarity * least or hit[-1] - hit[0] + 1 < least:
            return
        # Where no part of the chain can pass, no smaller skips are tried.
        if not len(_promising(np.zeros(len(hit), np.int64), hit, own[hit] + theirs[place], own[hit + 1] + theirs[place + 1], similarity, least)) or passes(hit, place):
            return
        rest, at = [], 0
        for i, j in _stretches(hit, place, similarity, least):
            if (i, j) == (0, len(hit)) or not passes(hit[i:j], place[i:j]):
                # Repeated shingles make the sets smaller than the stretch: cut it at its widest gap.
                gap = i + 1 + int(np.argmax(np.diff(hit[i:j]) + np.abs(np.diff(place[i:j]))))
                search(hit[i:gap], place[i:gap], skips)
                search(hit[gap:j], place[gap:j], skips)
            rest.append((at, i))
            at = j
        for i, j in [*rest, (at, len(hit))]:
            if j > i:
                chain(hit[i:j], place[i:j], skips[1:])

    def chain(hit: np.ndarray, place: np.ndarray, skips: tuple[int, ...]) -> None:
        if len(hit) < similarity * least or not skips:
            return
        step, jump = np.diff(hit), np.diff(place)
        cut = np.flatnonzero((step > skips[0]) | (np.abs(jump - step) > skips[0])) + 1
        for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]])):
            search(hit[lo:hi], place[lo:hi], skips)

    # The first time only a shift of more than a few ends a chain: a long passage may have a long gap.
    cut = np.flatnonzero(np.abs(np.diff(place) - np.diff(hit)) > 2 * SHINGLE + 1) + 1
    for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]])):
        search(hit[lo:hi], place[lo:hi], (len(a), 2 * SHINGLE + 1, SHINGLE + 1, 1))
    return found


_FOUND = "text long, doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, similarity double"


def shingle_table(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """text, shingles (binary, uint32) of the wanted texts (text, doc) among rows (doc_id, text, _text)."""
    wanted = wanted.select(F.col("text").alias("_t"), F.col("doc").alias("_doc"))
    some = rows.join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("_text") == F.col("_t"))).dropDuplicates(["doc_id", "_text"])

    def run(batches):
        for batch in batches:
            keys = batch.column("_text")
            for part, data, marks in _text.text_runs(batch):
                tokens, first = _shingles(data, marks)
                raw = pa.py_buffer(tokens.astype(np.uint32).tobytes())
                ends = pa.py_buffer((4 * first).astype(np.int64).tobytes())
                lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, ends, raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start), lists], ["text", "shingles"])

    return some.select("_text", "text").mapInArrow(run, "text long, shingles binary")


def verified(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages (_FOUND) of regions (_REGION) with similarity SIMILARITY; only the regions' shingles are shipped."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            places = [batch.column(n).to_pylist() for n in ("text", "doc", "source_doc", "left", "source_left")]
            for i, (text, doc, source, lo, so) in enumerate(zip(*places)):
                a, b = (np.frombuffer(batch.column(n)[i].as_buffer(), np.uint32) for n in ("a", "b"))
                for s, e, p, q, score in verified_passages(a, b):
                    out.append((text, doc, lo + s, lo + e + SHINGLE - 1, source, so + p, so + q + SHINGLE - 1, score))
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(names, columns)], names)

    held = texts.select(F.col("text").alias("_t"), "shingles")
    near = regions.join(held, F.col("text") == F.col("_t")).select(*_REGION, _slice("shingles", F.col("left"), F.col("right")).alias("a"))
    near = near.join(held, F.col("source_text") == F.col("_t")).select("text", "doc", "source_doc", "left", "source_left", "a", _slice("shingles", F.col("source_left"), F.col("source_right")).alias("b"))
    return near.mapInArrow(run, _FOUND)


def text_passages(docs: DataFrame, hashes: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """(passages as _FOUND by text, classes of equal texts: _text, _doc, _copies) of documents with an id."""
    attach(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text")).where("doc_id is not null")
    classes = materialize(rows.groupBy("_text").agg(F.min("doc_id").alias("_doc"), F.count("*").alias("_copies")), "classes")
    shared = materialize(shared_windows(rows, hashes), "shared")
    texts = materialize(shingle_table(rows, shared.select("text", "doc").distinct()), "texts")
    found = materialize(verified(window_pairs(shared, hashes), texts), "passages")
    spans = found.select("text", F.col("start_word").alias("s"), (F.col("end_word") - (SHINGLE - 1)).alias("e"))
    met = materialize(intersections(shared, spans, hashes), "intersections")
    more = verified(materialize(open_pairs(met, texts), "pairs"), texts)
    return materialize(found.union(more).distinct(), "all-passages"), classes


def word_counts(rows: DataFrame) -> DataFrame:
    """doc_id, _text, _n (words of the text) of rows (doc_id, text, _text)."""

    def run(batches):
        for batch in batches:
            for part, data, marks in _text.text_runs(batch):
                words = np.diff(_text.word_bounds(data, marks)[2])
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(part.start, part.stop - part.start) for n in ("doc_id", "_text")), pa.array(words, pa.int64())], ["doc_id", "_text", "_n"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_text", "text").mapInArrow(run, "doc_id long, _text long, _n long")


def near_duplicate_passages(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Passages of at least 50 words that occur in an earlier document, at similarity 0.8 or more.

    doc_id, start_word, end_word, source_doc_id, source_start, source_end, similarity, copy_of. Rows
    link one document per text (its smallest doc_id); an exact copy of at least 50 words has one row,
    its whole text with copy_of set, and shares its class's other rows. Words are lower-cased. Earlier
    is the smaller doc_id (of two texts with one id, the smaller hash). Null or shorter texts and null
    doc_ids take no part; repeated rows of one id count once; repeats within one document are not
    looked for. An empty table gives an empty result; other columns are not read.
    """
    found, classes = text_passages(docs, hashes)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    sizes = word_counts(rows.withColumn("_text", F.xxhash64("text"))).where(F.col("_n") >= MIN_WORDS)
    again = sizes.join(classes.where("_copies > 1"), "_text").where("doc_id > _doc").select("doc_id", "_n", "_doc").distinct()
    zero = F.lit(0).cast("long")
    copies = again.select("doc_id", zero.alias("start_word"), F.col("_n").alias("end_word"), F.col("_doc").alias("source_doc_id"), zero.alias("source_start"), F.col("_n").alias("source_end"), F.lit(1.0).alias("similarity"), F.col("_doc").alias("copy_of"))
    return found.drop("text").withColumn("copy_of", F.lit(None).cast("long")).unionByName(copies)


def without(text: str, spans: list[list[int]]) -> str | None:
    """The text less the words of `spans` (start, end) and the bytes up to the next word; None if no word stays."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, _, _ = _text.word_bounds(data, np.array([0, len(data)]))
    keep, gone = np.ones(len(data), bool), np.zeros(len(start), bool)
    for a, b in spans:
        gone[a:b] = True
    for w in np.flatnonzero(gone):
        keep[start[w] : start[w + 1] if w + 1 < len(start) else len(data)] = False
    return None if len(start) and gone.all() else data[keep].tobytes().decode()


def drop_repeats(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """The documents without their repeated passages; the earliest document keeps its own.

    Passages are cut from the very text that they were found in, so that rows which share an id keep
    their own. A copy (of a text of at least 50 words) under a larger id, and a document whose words
    all go, is dropped; the others keep every other byte of their text and get the text's new n_chars
    if they have that column. Null texts, null ids and shorter texts stay, and so do repeated rows of
    an id. Columns unchanged, whatever their names; an empty table stays empty.
    """
    found, classes = text_passages(docs, hashes)
    spans = found.groupBy("text").agg(F.sort_array(F.collect_set(F.array("start_word", "end_word"))).alias("spans"))
    facts = classes.join(spans, F.col("_text") == F.col("text"), "left").where("_copies > 1 or spans is not null").select(F.col("_text").alias("key"), F.col("_doc").alias("first"), "spans")
    names = docs.columns

    def run(batches):
        for batch in batches:
            kept = pa.RecordBatch.from_arrays(batch.column("row").flatten(), names)
            firsts, cuts = batch.column("first"), batch.column("spans")
            touched = np.flatnonzero(firsts.is_valid().to_numpy(zero_copy_only=False) & kept.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            if len(touched):
                texts, ids, stay = kept.column("text").to_pylist(), kept.column("doc_id").to_pylist(), np.ones(len(kept), bool)
                for i in touched.tolist():
                    if texts[i] is None:
                        continue
                    if ids[i] > firsts[i].as_py():
                        stay[i] = len(_text.word_bounds(np.frombuffer(texts[i].encode(), np.uint8), np.array([0, len(texts[i].encode())]))[0]) < MIN_WORDS
                    elif cuts[i].is_valid:
                        texts[i] = without(texts[i], cuts[i].as_py())
                        stay[i] = texts[i] is not None
                new = {"text": pa.array(texts, kept.schema.field("text").type)}
                if "n_chars" in names:
                    sizes = kept.column("n_chars").to_pylist()
                    for i in touched.tolist():
                        sizes[i] = len(texts[i]) if texts[i] is not None and cuts[i].is_valid and ids[i] <= firsts[i].as_py() else sizes[i]
                    new["n_chars"] = pa.array(sizes, kept.schema.field("n_chars").type)
                kept = pa.RecordBatch.from_arrays([new.get(n, kept.column(n)) for n in names], names).filter(pa.array(stay))
            yield kept

    wrapped = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    marked = wrapped.join(facts, F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("key"), "left")
    return marked.select("row", "first", "spans").mapInArrow(run, docs.schema)
