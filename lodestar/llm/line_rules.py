"""Quality rules by line labelling: Viterbi over a line CRF, content share decides retention.

The bar of the share is the one that errs least on the labelled sample (0.5 without one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm import _text, crf
from lodestar.llm._spark import attach
from lodestar.llm.lines import line_table

MIN_WORDS = 50


def judged(table, model: crf.LineModel) -> dict[str, np.ndarray]:
    """Statistics, content share (of word characters in lines that Viterbi marks content; no words: 0) and the verdict."""
    labels = crf.viterbi(model, table.features, table.first)
    n = len(table.first) - 1
    text_of = np.repeat(np.arange(n), np.diff(table.first))
    content = np.bincount(text_of, weights=table.weight * labels, minlength=n)
    share = content / np.maximum(np.bincount(text_of, weights=table.weight, minlength=n), 1)
    s = table.stats
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return s | {"content_share": share, "base_failed": failed, "kept": ~failed & (share >= model.least_content)}


def label_documents(docs: DataFrame, model: crf.LineModel) -> DataFrame:
    """doc_id, the statistics, base_failed, content_share and kept of every row.

    Null and empty texts have no words: all zero, base_failed, not kept. Repeated rows are judged alike,
    long texts whole; an empty table gives an empty result. Other columns are not read, whatever their names.
    """
    attach(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]

    def run(batches):
        for batch in batches:
            for rows, data, marks in _text.text_runs(batch):
                table = line_table(data, marks)
                found = judged(table, model)
                ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(found[n]) for n in names]], ["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label_documents under a model fitted on `labels` (doc_id, quality) of these documents.

    Nulls, repeats, empty tables and other columns as there; a table without labelled documents is
    judged by an unfitted model.
    """
    return label_documents(docs, crf.train_on_labels(docs, labels))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text passes, in one scan; columns unchanged, whatever their names.

    Null and empty texts do not pass; repeated rows pass or fail alike; an empty table stays empty.
    """
    attach(docs.sparkSession)
    model = crf.train_on_labels(docs, labels)

    def run(batches):
        for batch in batches:
            kept = [judged(line_table(data, marks), model)["kept"] for _, data, marks in _text.text_runs(batch)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
