"""Quality classifier: line CRF marginals, weighted by length, aggregated into a document score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import _text, crf
from lodestar.llm._spark import attach
from lodestar.llm.lines import line_table

THRESHOLD = 0.3


def score_batch(model: crf.LineModel, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Scores of consecutive texts: marginals of their lines weighted by length, on the sample's logistic scale."""
    table = line_table(data, marks)
    _, mean = crf.document_means(model, table.features, table.first, table.weight, np.repeat(np.arange(len(table.first) - 1), np.diff(table.first)))
    slope, offset = model.scale
    return 1 / (1 + np.exp(-np.clip(slope * mean + offset, -700, 700)))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text scores as an empty one.

    Labels of held-out ids (crc32 of the id mod 5 = 0) are never read; a null id counts as the text
    "" for that test. Only the text enters the score. Repeated rows score alike, long texts whole; an
    empty table gives an empty result; other columns are not read, whatever their names.
    """
    attach(docs.sparkSession)
    model = crf.train_on_labels(docs, labels)

    def run(batches):
        for batch in batches:
            for rows, data, marks in _text.text_runs(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, rows.stop - rows.start), pa.array(score_batch(model, data, marks))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
