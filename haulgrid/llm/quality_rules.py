"""Quality rules: a calibrated n-gram logistic regression behind a few base counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haulgrid.llm.common import in_slices, texts
from haulgrid.llm.ngrams import WordIds, calibrate, char_grams, collect_features, labelled_sample, sigmoid, word_grams

WORD_BITS = CHAR_BITS = 17
#: Characters that count as symbols, and those between words.
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"


def repeat_words(ids: np.ndarray, n: int = 3) -> int:
    """Words that lie in an n-word window found twice or more, the first one included."""
    m = len(ids) - n + 1
    if m < 2:
        return 0
    key = ids[:m]
    for k in range(1, n):
        top = int(ids.max()) + 1
        if (int(key.max()) + 1) * top >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + ids[k:m + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    for k in range(n):
        cover[k:m + k] |= twice
    return int(cover.sum())


def base_counts(text: str, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += bool(line.strip(BLANKS))
        else:
            lines.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat_words(ids),
    )


def grams(text: str, ids: WordIds, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = word_grams(ids.hashes[own], WORD_BITS) if len(own) else np.zeros(0, np.uint32)
    return words, char_grams(text, CHAR_BITS)


class QualityModel:
    """Logistic regression on mean-pooled hashed n-grams: the logit is the mean weight of a
    text's word n-grams plus that of its character n-grams. Fitted by Adagrad, then calibrated
    (Platt) on a fold that the weights have not seen."""

    def __init__(self, word: np.ndarray, char: np.ndarray, bias: float, a: float, b: float):
        self.word, self.char, self.bias, self.a, self.b = word, char, bias, a, b

    def probability(self, words: np.ndarray, chars: np.ndarray) -> float:
        z = self.bias
        z += float(self.word[words].mean()) if len(words) else 0.0
        z += float(self.char[chars].mean()) if len(chars) else 0.0
        return sigmoid(self.a * z + self.b)

    @classmethod
    def fit(cls, rows: list, epochs: int = 12, rate: float = 0.5) -> QualityModel | None:
        """None if the rows do not hold both classes: then there is no verdict to learn."""
        train = [r for r in rows if r[1] != 0] or rows
        held = [r for r in rows if r[1] == 0]
        if len({r[0] for r in train}) < 2:
            return None
        size = (1 << WORD_BITS) + (1 << CHAR_BITS)
        w, g = np.zeros(size, np.float64), np.full(size, 1e-8)
        bias, rng = 0.0, np.random.default_rng(0)
        for _ in range(epochs):
            for k in rng.permutation(len(train)):
                y, _, i, v = train[k]
                err = sigmoid(float(w[i] @ v) + bias) - (y == 1)
                step = err * v
                g[i] += step * step
                w[i] -= rate * step / np.sqrt(g[i])
                bias -= 0.05 * err
        check = held if len({r[0] for r in held}) == 2 else train
        margin = np.array([float(w[i] @ v) + bias for _, _, i, v in check])
        a, b = calibrate(margin, np.array([r[0] for r in check]))
        w = w.astype(np.float32)
        return cls(w[:1 << WORD_BITS], w[1 << WORD_BITS:], bias, a, b)


def _pooled(text: str) -> tuple[np.ndarray, np.ndarray]:
    ids = _worker_ids()
    words, chars = grams(text, ids, ids.of(text.encode("utf-8").split()))
    parts = []
    for at, base in ((words, 0), (chars, 1 << WORD_BITS)):
        bucket, n = np.unique(at, return_counts=True)
        parts.append((bucket.astype(np.uint32) + np.uint32(base), n / max(1, len(at))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


_IDS: list[WordIds] = []


def _worker_ids() -> WordIds:
    if not _IDS:
        _IDS.append(WordIds())
    return _IDS[0]


def fit_quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000) -> QualityModel | None:
    """Learn from at most ``max_rows`` labelled rows (see :func:`labelled_sample`)."""
    return QualityModel.fit(collect_features(labelled_sample(docs, labels, label, max_rows), _pooled))


def quality_rules(
    docs: DataFrame,
    model: QualityModel | None,
    keep_at: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts, probability and verdict for every whole text.

    Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    probability, kept; one row per input row, made in Arrow batches without a shuffle.

    * null text: no words, so base_failed. Null ids, ties and repeated rows pass row by row.
    * no model (labels empty or of one class): probability is null and the base rules decide.
    * empty table: empty result. Extra columns are not read.
    """

    def run(batches):
        ids = _worker_ids()
        for b in in_slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                words = text.encode("utf-8").split()
                own = ids.of(words)
                counts = base_counts(text, words, own)
                n, repeated = counts[0], counts[4]
                failed = n < min_words or 100 * repeated > max_repeat_percent * n
                p = model.probability(*grams(text, ids, own)) if model else None
                out.append((*counts, failed, p, not failed and (p is None or p >= keep_at)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            cols = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    rows = texts(docs, id_col=id_col, text_col=text_col)
    kinds = [dict(rows.dtypes)["doc_id"], *["bigint"] * 5, "boolean", "double", "boolean"]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def keep_good(docs: DataFrame, model: QualityModel | None, keep_at: float = 0.5, min_words: int = 50,
              max_repeat_percent: int = 50, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns as they are, in one
    pass over the rows without a join. A null text is one without words."""
    names = docs.columns

    def run(batches):
        ids = _worker_ids()
        for b in in_slices(batches):
            good = []
            for text in b.column(names.index(text_col)).to_pylist():
                text = text or ""
                own = ids.of(text.encode("utf-8").split())
                n = len(own)
                ok = n >= min_words and 100 * repeat_words(own) <= max_repeat_percent * n
                good.append(ok and (model is None or model.probability(*grams(text, ids, own)) >= keep_at))
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
