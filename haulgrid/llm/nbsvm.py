"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a
linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haulgrid.llm.common import in_slices, texts
from haulgrid.llm.ngrams import WordIds, calibrate, char_grams, collect_features, labelled_sample, shape_grams, sigmoid, word_grams

BITS = 18
_STATE: dict = {}


def indicators(text: str) -> np.ndarray:
    """Distinct buckets of a whole text's n-grams: of words, of word shapes and of characters.

    Words take the lower half of the buckets, shapes and characters a quarter each. Repeats go by writing each
    position to its bucket and keeping those that read themselves back: no sort.
    """
    if not _STATE:
        _STATE["ids"], _STATE["seen"] = WordIds(), np.zeros(1 << BITS, np.int32)
    ids, seen = _STATE["ids"], _STATE["seen"]
    own = ids.of(text.encode("utf-8").split())
    half = 1 << (BITS - 1)
    parts = [char_grams(text, BITS - 2, (1, 2)) + np.uint32(half)]
    if len(own):
        parts.append(shape_grams(own, ids.shapes, BITS - 2) + np.uint32(half + half // 2))
        parts.append(word_grams(ids.hashes[own], BITS - 1))
    at = np.concatenate(parts)
    place = np.arange(len(at), dtype=np.int32)
    seen[at] = place
    return at[seen[at] == place]


class NbSvm:
    """Weights of the indicators: ``ratio`` (log-count ratio) and ``weight`` (of the scaled and
    length-normalised indicator), bias and calibration."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, a: float, b: float):
        self.scaled, self.square, self.bias, self.a, self.b = ratio * weight, ratio * ratio, bias, a, b

    def margin(self, at: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[at].sum()))
        return (float(self.scaled[at].sum()) / norm if norm else 0.0) + self.bias

    def score(self, text: str) -> float:
        return sigmoid(self.a * self.margin(indicators(text)) + self.b)

    @classmethod
    def fit(cls, rows: list, alpha: float = 1.0, cost: float = 1.0, epochs: int = 30, tolerance: float = 1e-3) -> NbSvm:
        """Ratios and weights from all folds but one; the margins of the fold left out set the
        calibration. With a single class or no rows: a constant score (the smoothed share)."""
        zero = np.zeros(1 << BITS)
        if len({r[0] for r in rows}) < 2:
            y = np.array([r[0] for r in rows])
            return cls(zero, zero, 0.0, *calibrate(np.zeros(len(y)), y))
        train, held = [r for r in rows if r[1] != 0], [r for r in rows if r[1] == 0]
        if len({r[0] for r in train}) < 2 or len({r[0] for r in held}) < 2:
            train = held = rows
        p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
        for y, _, at, _ in train:
            (p if y == 1 else q)[at] += 1
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        xs = []
        for _, _, at, _ in train:
            x = ratio[at]
            norm = np.sqrt(x @ x)
            xs.append(x / norm if norm else x)
        sign = np.array([1.0 if r[0] == 1 else -1.0 for r in train])
        dual, w, bias = np.zeros(len(train)), zero.copy(), 0.0
        curve = np.array([x @ x + 1.0 for x in xs])  # the bias is a feature that is always 1
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            worst = 0.0
            for k in rng.permutation(len(train)):
                at, x = train[k][2], xs[k]
                grad = sign[k] * (w[at] @ x + bias) - 1
                new = min(max(dual[k] - grad / curve[k], 0.0), cost)
                if step := new - dual[k]:
                    worst = max(worst, abs(step))
                    w[at] += step * sign[k] * x
                    bias += step * sign[k]
                    dual[k] = new
            if worst < tolerance:
                break
        model = cls(ratio, w, bias, 1.0, 0.0)
        margin = np.array([model.margin(r[2]) for r in held])
        model.a, model.b = calibrate(margin, np.array([r[0] for r in held]))
        model.scaled, model.square = model.scaled.astype(np.float32), model.square.astype(np.float32)
        return model


def fit_nbsvm(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, where=None) -> NbSvm:
    """Learn from at most ``max_rows`` labelled rows that meet ``where``."""
    sample = labelled_sample(docs, labels, label, max_rows, where)
    return NbSvm.fit(collect_features(sample, lambda t: ((at := indicators(t)), np.zeros(0))))


def nbsvm_scores(docs: DataFrame, model: NbSvm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text, row by row in Arrow batches.

    Only the text is read. Null text: that of an empty text, a score like any other. Null ids,
    ties and repeated rows pass row by row; empty table: empty result.
    """

    def run(batches):
        for b in in_slices(batches):
            scores = [model.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = texts(docs, id_col=id_col, text_col=text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
