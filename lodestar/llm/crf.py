"""A two-label linear-chain conditional random field over lines: training, Viterbi, marginals.

All passes run over many texts at once, one line position at a time. Label 1 is good content. Lines
have no labels of their own to learn from: those of documents are noisy signs of them (see `fit`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import _text
from lodestar.llm._spark import attach
from lodestar.llm.lines import FEATURES, OWN, line_table

#: Bound of the labelled sample that the weights are fitted on (documents, by hash of doc_id).
SAMPLE = 4000
#: Training sequences are runs of so many lines of a document; scoring always uses whole documents.
TRAIN_LINES = 24
#: Bound of the training sequences (by hash of document and place), and so of what the driver holds.
TRAIN_RUNS = 6000
#: How often a line is taken to have the label of its document.
AGREES = 0.7
#: First rounds of expectation-maximisation, in which lines are labelled by their own features alone.
ALONE = 3
#: Ridge of the weights of a line's own features, and of its neighbours' features and labels: these may tip
#: the scales, but a line that looks like the others of its kind keeps their label beside any neighbour.
OWN_RIDGE, NEAR_RIDGE = 1e-4, 1e-2


@dataclass
class LineModel:
    emit: np.ndarray  # features
    stay: np.ndarray  # 2 x 2, from row to column
    #: Least content share (by Viterbi labels) of a document worth keeping.
    least_content: float = 0.5
    #: Slope and offset that turn the weighted mean of the marginals into a probability of document label 1.
    scale: tuple[float, float] = (1.0, 0.0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        """(lines, 2); label 0 is the reference at score 0."""
        return np.column_stack([np.zeros(len(features)), features @ self.emit])


def _steps(first: np.ndarray):
    """For each line position k: the texts that have one, longest first, as indices of texts."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    return order, active


def _log_add(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def viterbi(model: LineModel, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every line; ties go to label 1."""
    score, (order, active) = model.scores(features), _steps(first)
    best, back = np.zeros((len(order), 2)), np.zeros((len(features), 2), np.int8)
    for k, n in enumerate(active):
        at = first[order[:n]] + k
        if k == 0:
            best[:n] = score[at]
            continue
        for to in (0, 1):
            a, b = best[:n, 0] + model.stay[0, to], best[:n, 1] + model.stay[1, to]
            back[at, to] = b >= a
        best[:n] = np.column_stack([np.maximum(best[:n, 0] + model.stay[0, to], best[:n, 1] + model.stay[1, to]) for to in (0, 1)]) + score[at]
    out = np.zeros(len(features), np.int8)
    now = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for k in range(len(active) - 1, -1, -1):
        n = active[k]
        at = first[order[:n]] + k
        out[at] = now[:n]
        if k:
            now[:n] = back[at, now[:n]]
    return out


def forward_backward(model: LineModel, features: np.ndarray, first: np.ndarray, evidence: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """P(label 1) of every line, expected transitions (2 x 2, summed) and the summed log partition.

    `evidence` (lines, 2) is added to the lines' scores: what else is known about their labels.
    """
    score, (order, active) = model.scores(features) + evidence, _steps(first)
    ahead, behind = np.zeros((len(features), 2)), np.zeros((len(features), 2))
    for k, n in enumerate(active):
        at = first[order[:n]] + k
        if k == 0:
            ahead[at] = score[at]
        else:
            was = ahead[at - 1]
            ahead[at] = np.column_stack([_log_add(was + model.stay[:, to]) for to in (0, 1)]) + score[at]
    for k in range(len(active) - 2, -1, -1):
        at = first[order[: active[k + 1]]] + k
        follow = behind[at + 1] + score[at + 1]
        behind[at] = np.column_stack([_log_add(follow + model.stay[fr, :]) for fr in (0, 1)])
    total = _log_add(ahead + behind)
    good = np.exp(ahead[:, 1] + behind[:, 1] - total)
    inner = np.ones(len(features), bool)
    inner[first[:-1]] = False
    to_ = np.flatnonzero(inner)
    pair = ahead[to_ - 1][:, :, None] + model.stay[None] + (behind[to_] + score[to_])[:, None, :] - total[to_][:, None, None]
    return good, np.exp(pair).sum(axis=0), float(total[first[:-1]].sum())


def _climb(model: LineModel, features: np.ndarray, first: np.ndarray, gold: np.ndarray, moves: np.ndarray, steps: int, worth: np.ndarray | None = None) -> LineModel:
    """Adam steps up the likelihood of soft labels `gold` and transitions `moves`; with `worth` (of each line) by a line's own features alone."""
    width = len(FEATURES)
    ridge = np.r_[0, np.full(len(OWN) - 1, OWN_RIDGE), np.full(width - len(OWN) + 4, NEAR_RIDGE)]
    open_ = np.ones(width + 4)
    if worth is not None:
        open_[len(OWN) :] = 0
    worth = np.ones(len(gold)) if worth is None else worth
    theta, m, v = np.r_[model.emit, model.stay.ravel()], 0.0, 0.0
    for t in range(1, steps + 1):
        now = LineModel(theta[:width], theta[width:].reshape(2, 2))
        good, expected, _ = forward_backward(now, features, first)
        slope = np.concatenate([features.T @ (worth * (gold - good)), (moves - expected).ravel()]) / len(gold) - ridge * theta
        slope *= open_
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return LineModel(theta[:width], theta[width:].reshape(2, 2))


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 5, steps: int = 50) -> LineModel:
    """Lines get latent labels; a document's label (one per sequence) is a noisy sign of each line's.

    Expectation-maximisation: lines are labelled by forward-backward with what the document's label
    says about them, then weights and transitions are fitted to that. It starts with rounds of each line's own
    features alone, with good and bad documents worth the same, so that alike lines of both come to the label
    of those where they are commoner. Without both labels
    there is nothing to tell apart: the model then calls every line good or bad.
    """
    width = len(FEATURES)
    if len(set(labels.tolist())) < 2:
        emit = np.zeros(width)
        emit[0] = 5.0 if not len(labels) or labels[0] else -5.0
        return LineModel(emit, np.zeros((2, 2)))
    seen = np.repeat(labels, np.diff(first)).astype(int)
    gold, moves, model = seen.astype(float), np.zeros((2, 2)), LineModel(np.zeros(width), np.zeros((2, 2)))
    even = 0.5 / np.where(seen == 1, max(seen.mean(), 1e-9), max(1 - seen.mean(), 1e-9))
    sign = np.log(np.array([[AGREES, 1 - AGREES], [1 - AGREES, AGREES]]))[seen]
    for k in range(rounds):
        model = _climb(model, features, first, gold, moves, steps, even if k < ALONE else None)
        gold, moves, _ = forward_backward(model, features, first, sign)
    return _climb(model, features, first, gold, moves, steps)


def calibrate(model: LineModel, share: np.ndarray, mean: np.ndarray, labels: np.ndarray) -> LineModel:
    """The bar of content shares that errs least on labelled documents, and the logistic scale of the mean marginals."""
    if len(set(labels.tolist())) < 2:
        return model
    order = np.argsort(share, kind="stable")
    ranked = labels[order] > 0
    # Keeping the documents from place k on: wrong are the good ones before and the bad ones after it.
    wrong = np.concatenate([[0], np.cumsum(ranked)]) + (~ranked).sum() - np.concatenate([[0], np.cumsum(~ranked)])
    edge = np.concatenate([[True], share[order][1:] > share[order][:-1], [True]])
    k = int(np.flatnonzero(edge)[np.argmin(wrong[edge])])
    low, high = np.concatenate([[0.0], share[order], [1.0]])[k : k + 2]
    bar = float(np.clip(0.5, low + 0.1 * (high - low), high))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(slope * mean + offset, -30, 30)))
        x, w = np.column_stack([mean, np.ones(len(mean))]), p * (1 - p) + 1e-9
        theta = np.array([slope, offset]) + np.linalg.solve((x * w[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (labels - p) - 0.01 * np.array([slope, offset]))
        slope, offset = np.clip(theta, -60, 60)
    return LineModel(model.emit, model.stay, bar, (float(slope), float(offset)) if slope > 0 else (1.0, 0.0))


def document_means(model: LineModel, features: np.ndarray, first: np.ndarray, weight: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document (number of each line's): its content share by Viterbi labels and its mean marginal, both weighted by length."""
    n, w = int(doc.max(initial=-1)) + 1, weight + 1e-6
    content = np.bincount(doc, weights=weight * viterbi(model, features, first), minlength=n)
    good = np.bincount(doc, weights=w * forward_backward(model, features, first)[0], minlength=n)
    return content / np.maximum(np.bincount(doc, weights=weight, minlength=n), 1), good / np.maximum(np.bincount(doc, weights=w, minlength=n), 1e-300)


def train_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, runs: int = TRAIN_RUNS) -> LineModel:
    """Fit on up to `sample` labelled documents of the table, chosen by hash, never those with crc32(doc_id) mod 5 = 0.

    Null labels and ids teach nothing; several labels of an id count as the smallest; of several texts of
    an id the one of least hash is read. Of the sampled documents' runs of TRAIN_LINES lines, at most
    `runs` (by hash) come to the driver, whatever the length of the documents.
    """
    attach(docs.sparkSession)
    taught = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    present = docs.select(F.col("doc_id").alias("_id")).distinct()
    taught = taught.groupBy("doc_id").agg(F.min("quality").alias("_quality")).join(present, F.col("doc_id") == F.col("_id"), "left_semi")
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "_quality")
    width = len(FEATURES) + 1

    def run(batches):
        for batch in batches:
            for rows, data, marks in _text.text_runs(batch):
                table = line_table(data, marks)
                numbers = np.column_stack([table.features, table.weight]).astype(np.float32)
                count = np.diff(table.first)
                heads = _text.ranges(np.zeros(len(count), np.int64), -(-count // TRAIN_LINES))
                of = np.repeat(np.arange(len(count)), -(-count // TRAIN_LINES))
                begin = table.first[of] + TRAIN_LINES * heads
                sizes = np.minimum(begin + TRAIN_LINES, table.first[of + 1]) - begin
                take = pa.array(of + rows.start)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes * width)]).astype(np.int32)), pa.array(numbers.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_quality").take(take).cast(pa.int32()), pa.array(heads), lists], ["id", "quality", "part", "numbers"])

    few = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    few = few.groupBy("_id", "_quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = few.select("_id", "_quality", "text").mapInArrow(run, "id long, quality int, part long, numbers array<float>")
    got = found.orderBy(F.xxhash64("id", "part"), "id", "part").limit(runs).toArrow().to_pandas().sort_values(["id", "part"], kind="stable")
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(1, np.int64), np.zeros(0))
    sizes = got["numbers"].map(len).to_numpy() // width
    numbers = np.concatenate(got["numbers"].to_list()).reshape(-1, width).astype(float)
    first, quality = np.concatenate([[0], np.cumsum(sizes)]), (got["quality"].to_numpy() > 0).astype(int)
    model = fit(numbers[:, :-1], first, quality)
    ids, doc = np.unique(got["id"].to_numpy(), return_inverse=True)
    share, mean = document_means(model, numbers[:, :-1], first, numbers[:, -1], np.repeat(doc, sizes))
    label = np.zeros(len(ids), int)
    label[doc] = quality
    return calibrate(model, share, mean, label)
