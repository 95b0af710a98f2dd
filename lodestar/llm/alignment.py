"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte of a document.

An Arrow-native pipeline inside tasks: words become ids by two list columns, which are flattened with
their parent indices; segmented cumulative sums of the tokens' byte lengths give ends, and a hash join
on (document, end) links the two sides. Each document keeps the id pairs it links with their counts
(Table.group_by); Spark merges the partial counts of all tasks. Documents then look their pairs up: the
commonest ones in a table that is sent to the tasks, all others by a join, so the bound changes no count.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._spark import attach, materialize
from lodestar.llm.packing import CACHED, WordIds

#: Commonest id pairs that are sent to all tasks (17 bytes each).
SENT_PAIRS = 1 << 19
#: Texts are worked on in runs of about this many characters; a longer text is its own run.
RUN_CHARS = 1_000_000
#: Distinct pairs that a task counts before it hands its partial counts on.
HELD_PAIRS = 1_000_000
#: A pair of ids is one long: A's id above so many bits of B's.
SHIFT = 32
_LOOSE, _CUT = regex.compile(r"\s |^ "), regex.compile(r"(?<=\S)(?= )")


class PieceIds(dict):
    """Word -> little-endian ids of the piece model for the word after its space, asked once each.

    No piece of the model holds a space after another character, so merges never cross the start of a
    spaced word and a text's ids are those of its words.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(regex.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece crosses the start of a word")
        self.alone = array("I", [self.model.piece_to_id("▁")]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.model.encode(word, num_threads=1)).tobytes() if word else self.alone
        if len(self) > CACHED:
            self.clear()
        if len(word) <= 256:
            self[word] = ids
        return ids

    def token_bytes(self) -> list[bytes]:
        model = self.model
        return [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id: a byte-level vocabulary writes unprintable bytes as the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(printable)))}
    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens]


class Side:
    """One tokenizer: ids by word, and the bytes and the decimal digits of its ids."""

    def __init__(self, words: dict, tokens: list[bytes]) -> None:
        self.words, self.bytes = words, pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.digits = pa.array([str(i) for i in range(len(tokens))])

    def ids(self, distinct: list[str], codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order, and the word (position) of each."""
        found = [self.words[w] for w in distinct]
        marks = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])])
        lists = pa.LargeListArray.from_arrays(pa.array(marks, pa.int64()), pa.array(np.frombuffer(b"".join(found), np.uint32).astype(np.int64)))
        taken = lists.take(codes)
        return pc.list_flatten(taken).to_numpy(), pc.list_parent_indices(taken).to_numpy()


_sides: dict[tuple, tuple[Side, Side]] = {}


def tokenizer_sides(tokenizer_file: str, piece_file: str, ranks: tuple[str, str] | None) -> tuple[Side, Side]:
    """The two tokenizers, loaded once a worker."""
    key = tokenizer_file, piece_file, ranks
    if key not in _sides:
        words, pieces = WordIds(tokenizer_file, ranks), PieceIds(piece_file)
        _sides[key] = Side(words, byte_level_bytes(words.tokenizer)), Side(pieces, pieces.token_bytes())
    return _sides[key]


def spaced_words(text: str) -> list[str]:
    """The words of space + text: cut before each space that follows a non-space, without that space."""
    return [p[1:] for p in _CUT.split(" " + text)] if _LOOSE.search(text) else text.split(" ")


def _joined_differs(side: Side, ids: np.ndarray, bounds: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts are not what their tokens' bytes join to, with the space in front."""
    taken = side.bytes.take(pa.array(ids))
    marks = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2] or b"").cast("B")
    at = marks[bounds]
    return np.array([bool(t) and data[a:b] != b" " + t for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist())], bool)


def align(texts: list[bytes], left: Side, right: Side) -> tuple[dict[str, np.ndarray | list], pa.Table]:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256; and the linked pairs per text (doc, pair, n)."""
    n = len(texts)
    plain = [t.decode("utf-8", "replace") for t in texts]
    words = [spaced_words(t) if t else [] for t in plain]
    doc_of_word = np.repeat(np.arange(n), [len(w) for w in words])
    coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices
    sides, bad = [], np.array([not t for t in texts], bool)
    for side in (left, right):
        ids, parents = side.ids(distinct, codes)
        doc = doc_of_word[parents]
        bad |= _joined_differs(side, ids, np.searchsorted(doc, np.arange(n + 1)), texts)
        sides.append((side, ids, doc))
    tables, counts = [], []
    for side, ids, doc in sides:
        good = ~bad[doc]
        ids, doc = ids[good], doc[good]
        bounds = np.searchsorted(doc, np.arange(n + 1))
        counts.append(np.diff(bounds))
        running = np.concatenate([[0], np.cumsum(side.sizes[ids])])
        tables.append(pa.table({"doc": doc, "end": running[1:] - running[bounds][doc], "at": np.arange(len(ids)), "id": ids}))
    met = tables[0].join(tables[1], ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False).sort_by("at")
    doc = met["doc"].to_numpy()
    pair = (met["id"].to_numpy() << SHIFT) | met["id_b"].to_numpy()
    groups = []
    for (side, _, _), table, at in zip(sides, tables, ("at", "at_b")):
        marks = np.concatenate([[0], met[at].to_numpy() + 1])
        lists = pa.ListArray.from_arrays(pa.array(marks, pa.int32()), side.digits.take(table["id"].combine_chunks()))
        groups.append(pc.binary_join(lists, ","))
    bounds = np.searchsorted(doc, np.arange(n + 1))
    joined = pc.binary_join_element_wise(groups[0], groups[1], "|").cast(pa.large_string())
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), joined), pa.scalar(";", pa.large_string())).to_pylist()
    shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in whole]
    partial = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([("pair", "count")]).select(["doc", "pair", "pair_count"])
    n_links = np.diff(bounds)
    return {"n_a": counts[0], "n_b": counts[1], "n_groups": n_links, "n_links": n_links, "groups_sha256": shas}, partial.rename_columns(["doc", "pair", "n"]).sort_by("doc")


def _document_rows(docs: DataFrame, tokenizer_file: str, piece_file: str, ranks: tuple[str, str] | None) -> DataFrame:
    """One row per document with its digests and the pairs it links; row is unique."""

    def run(batches):
        left, right = tokenizer_sides(tokenizer_file, piece_file, ranks)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_CHARS, "right")))
                rows, pairs = align(texts[at:stop], left, right)
                marks = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(stop - at + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(marks, pairs[c].combine_chunks().cast(pa.int64())) for c in ("pair", "n")]
                columns = [pa.array(np.arange(row, row + stop - at)), ids.slice(at, stop - at), *[pa.array(v, pa.int64()) for v in list(rows.values())[:4]], pa.array(rows["groups_sha256"], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *rows, "pairs", "counts"])
                row, at = row + stop - at, stop

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n, best: links corpus-wide that hold the pair, and whether no pair of the same B id has more."""

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])

    def partial(batches):
        held = []
        for batch in batches:
            held.append(pa.table({"pair": pc.list_flatten(batch.column("pairs")), "n": pc.list_flatten(batch.column("counts"))}))
            if sum(map(len, held)) > HELD_PAIRS:
                held = [merged(held)]
                if len(held[0]) > HELD_PAIRS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    summed = rows.select("pairs", "counts").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialize(summed.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))), "pair-counts")
    tops = counted.groupBy("b").agg(F.max("n").alias("top"))  # a row per id of B's vocabulary at most
    return counted.join(tops, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, tokenizer_file: str, piece_file: str, ranks: tuple[str, str] | None = None, sent: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A: the byte-level tokenizer's file on space + text (`ranks`: the same vocabulary as merge ranks and
    its pattern, faster); B: the piece model on text. Strings of special tokens are plain text. Null and
    empty texts, and those that either tokenizer does not give back (a literal U+2581, bytes that are no
    UTF-8), have zeros and the digest ''. Texts of any length are taken whole. Rows with null or repeated
    doc_id stay rows of their own; equal texts count as often as they occur. An empty table gives an empty
    result; other columns are not read, whatever their names.
    """
    attach(docs.sparkSession)
    rows = materialize(_document_rows(docs, tokenizer_file, piece_file, ranks), "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    common = counts.orderBy(F.desc("n"), "pair").limit(sent).toArrow()
    order = np.argsort(common["pair"].to_numpy(), kind="stable")
    known = [common[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")]

    def look_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known[0], pairs), max(len(known[0]) - 1, 0))
        return at, (known[0][at] == pairs) if len(known[0]) else np.zeros(len(pairs), bool)

    def add_up(batches):
        for batch in batches:
            lists, n = batch.column("pairs"), pc.list_flatten(batch.column("counts")).to_numpy()
            at, found = look_up(pc.list_flatten(lists).to_numpy())
            doc = pc.list_parent_indices(lists).to_numpy()[found]
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], doc, n[found] * known[2][at[found]])
            np.add.at(sums[1], doc, n[found] * known[1][at[found]])
            kept = batch.drop_columns(["pairs", "counts"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sums[0]), pa.array(sums[1])], [*kept.schema.names, "n_best", "count_sum"])

    def others(batches):
        for batch in batches:
            lists = batch.column("pairs")
            pairs = pc.list_flatten(lists).to_numpy()
            rest = ~look_up(pairs)[1]
            row = batch.column("row").to_numpy()[pc.list_parent_indices(lists).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in (row, pairs, pc.list_flatten(batch.column("counts")).to_numpy())], ["row", "pair", "times"])

    added = rows.mapInArrow(add_up, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    rare = rows.select("row", "pairs", "counts").mapInArrow(others, "row long, pair long, times long").join(counts, "pair")
    more = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    best, total = (F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_best", "_best"), ("count_sum", "_sum")))
    return added.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", best.alias("n_best"), total.alias("count_sum"), "groups_sha256")
