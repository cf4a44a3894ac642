"""Hashed word and character n-grams of whole texts, in NumPy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import in_slices, texts

_MULT = np.uint32(0x9E3779B1)


_RUN = re.compile(r"(.)\1+", re.S)
SAME = 12345  # what a repeated word becomes


def shape(word: bytes) -> bytes:
    """A word with letters as A or a, digits as 0, other characters kept, and runs collapsed."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word.decode("utf-8"))
    return _RUN.sub(r"\1", kinds).encode("utf-8")


class WordIds(dict):
    """Exact small ids of words (bytes), a 32-bit hash of each and one of its shape; emptied between texts once
    it holds ``limit`` words, so memory is bounded by the limit and the longest text."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.hashes, self.shapes = np.zeros(1024, np.uint32), np.zeros(1024, np.uint32)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        if k == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.shapes = np.concatenate((self.shapes, np.zeros_like(self.shapes)))
        self.hashes[k] = xxhash.xxh32_intdigest(word)
        self.shapes[k] = xxhash.xxh32_intdigest(shape(word))
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_grams(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of word unigrams and bigrams. A word that repeats the one before it makes the
    same bigram whatever the word is, so stuttering is one feature, not one for each word."""
    shift = np.uint32(32 - bits)
    two = hashes[:-1] * np.uint32(0x85EBCA77) + hashes[1:] * np.uint32(0xC2B2AE3D) + np.uint32(1)
    two[hashes[:-1] == hashes[1:]] = SAME
    return np.concatenate((hashes * _MULT, two * _MULT)) >> shift


def shape_grams(ids: np.ndarray, shapes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the 1- to 3-grams of word shapes; a word equal to the one before it has a
    shape of its own, so stuttering shows whatever the word."""
    one = shapes[ids]
    one[1:][ids[1:] == ids[:-1]] = SAME
    two = one[:-1] * np.uint32(31) + one[1:] * np.uint32(0x85EBCA77) + np.uint32(5)
    three = two[:-1] * np.uint32(131) + one[2:] * np.uint32(0xC2B2AE3D) + np.uint32(9) if len(one) > 2 else one[:0]
    return np.concatenate((one, two, three)) * _MULT >> np.uint32(32 - bits)


def char_grams(text: str, bits: int, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Buckets of the character n-grams of a text, white space included."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = []
    for n in sizes:
        if len(c) >= n:
            h = c[:len(c) - n + 1] + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            for k in range(1, n):
                h = h * np.uint32(0x01000193) ^ c[k:len(c) - n + 1 + k]
            out.append(h * _MULT >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where=None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, fold, text) of at most ``max_rows`` labelled rows, those with the smallest hash of
    the id: the documented bound of what the models learn from. Rows with a null id or label
    teach nothing. Of rows that repeat an id, the text with the smallest hash teaches for all:
    the bound holds however often an id repeats. ``fold`` is a hash of the id too."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y")).dropna()
    if where is not None:
        known = known.filter(where)
    known = known.distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id", "y").limit(max_rows)
    rows = texts(docs, id_col=id_col, text_col=text_col).join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select(
        F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(4)).cast("int").alias("fold"), "text")


def collect_features(sample: DataFrame, features) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(y, fold, buckets, values) of every sampled row, made on the executors; at most as many
    rows as the sample's bound and as many buckets a row as the hash has."""

    def run(batches):
        for b in in_slices(batches):
            made = [features(t) for t in b.column("text").to_pylist()]
            cols = [b.column("y"), b.column("fold"),
                    pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["y", "fold", "i", "v"])

    rows = sample.mapInArrow(run, "y int, fold int, i binary, v binary").collect()
    rows.sort(key=lambda r: (r.y, r.fold, bytes(r.i), bytes(r.v)))  # the model doesn't depend on the order of tasks
    return [(r.y, r.fold, np.frombuffer(r.i, "<u4"), np.frombuffer(r.v, "<f4")) for r in rows]


def calibrate(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt scaling: (a, b) so that sigmoid(a * margin + b) is the probability of y = 1, by
    Newton steps on Platt's smoothed targets. Without both classes: the constant share."""
    pos, neg = float((y == 1).sum()), float((y != 1).sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log(pos / neg))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - t * z).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        h11, h12, h22 = (w * margin * margin).sum() + 1e-6, (w * margin).sum(), w.sum() + 1e-6
        g1, g2 = (g * margin).sum(), g.sum()
        det = h11 * h22 - h12 * h12
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * da, b - step * db) > now:
            step /= 2
        a, b = a - step * da, b - step * db
        if abs(step * da) + abs(step * db) < 1e-7:
            break
    return float(a), float(b)


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
