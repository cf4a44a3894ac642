"""Byte-level BPE encoding and decoding with a two-tier lookup."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from haulgrid.llm.common import in_slices, texts
from haulgrid.llm.pretokens import PieceMemo


class PerfectHash:
    """Minimal perfect hash of a fixed key set (hash and displace).

    Keys fall into buckets of about four; buckets, largest first, look for the displacement
    that sends all their keys to free slots. n keys use exactly the slots 0..n-1.
    """

    def __init__(self, keys: list[bytes], seed: int = 7):
        n = self.n = len(keys)
        self.seed = seed
        self.n_buckets = max(1, n // 4)
        first, second, step = self._mix(keys)
        order = np.argsort(first, kind="stable")
        ends = np.searchsorted(first[order], np.arange(self.n_buckets + 1))
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        sizes = np.diff(ends)
        for b in np.argsort(-sizes, kind="stable")[:np.count_nonzero(sizes > 1)]:
            own, d = order[ends[b]:ends[b + 1]], 0
            while True:  # 256 displacements at a time
                tried = np.arange(d, d + 256)[:, None]
                at = (second[own] + tried * step[own] + tried // n) % n
                line = np.sort(at, axis=1)
                good = ~taken[at].any(axis=1) & (line[:, 1:] != line[:, :-1]).all(axis=1)
                if good.any():
                    break
                d += 256
            k = int(good.argmax())
            self.shift[b], self.slot_of[own] = d + k, at[k]
            taken[at[k]] = True
        # a bucket of one key names its slot outright
        alone, free = np.flatnonzero(sizes == 1), np.flatnonzero(~taken)
        self.shift[alone] = -1 - free[:len(alone)]
        self.slot_of[order[ends[alone]]] = free[:len(alone)]

    def _mix(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_128_intdigest(k, self.seed) & 0xFFFFFFFFFFFFFFFF for k in keys), np.uint64, len(keys))
        g = h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))
        n = np.uint64(max(1, self.n))
        return (
            (h % np.uint64(self.n_buckets)).astype(np.int64),
            ((h >> np.uint64(20)) % n).astype(np.int64),
            (1 + (g >> np.uint64(20)) % np.uint64(max(1, self.n - 1))).astype(np.int64),
        )

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; for a key outside the set, the slot of some other key."""
        if not self.n:
            return np.full(len(keys), -1)
        first, second, step = self._mix(keys)
        d = self.shift[first]
        return np.where(d < 0, -1 - d, (second + d * step + d // self.n) % self.n)


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of mergeable neighbours over a doubly linked byte list.

    The pair of lowest rank merges first, of equal ranks the leftmost. A heap entry whose
    pieces have changed since it was pushed is skipped. O(n log n), so one pre-token may be as
    long as a document.
    """
    n = len(word)
    end = list(range(1, n + 1))  # piece i is word[i:end[i]]; end[i] is also the next piece
    left = list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[left[i]:stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [x.split() for x in lines if x.strip()]
        self.ranks = {base64.b64decode(k): int(v) for k, v in pairs}
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.key_at = [b""] * len(keys)
        self.id_at = [b""] * len(keys)
        for k, slot in zip(keys, self.hash.slot_of.tolist(), strict=True):
            self.key_at[slot], self.id_at[slot] = k, self.ranks[k].to_bytes(4, "little")
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.encode = PieceMemo(self._encode_pieces, self._encode_whole).ids

    def _pretokens(self, parts: set[str]) -> dict[str, bytes]:
        """First tier: the whole pre-token is in the vocabulary. Second tier: merges."""
        words = list(parts)
        raw = [p.encode("utf-8") for p in words]
        return {
            p: self.id_at[slot] if self.key_at[slot] == word else np.array(merge_bytes(word, self.ranks), "<u4").tobytes()
            for p, word, slot in zip(words, raw, self.hash.slots(raw).tolist(), strict=True)
        }

    def _encode_whole(self, text: str) -> bytes:
        parts = self.find(text)
        return b"".join(map(self._pretokens(set(parts)).__getitem__, parts))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        split = [self.find(p) for p in pieces]
        known = self._pretokens({t for s in split for t in s}).__getitem__
        return [known(s[0]) if len(s) == 1 else b"".join(map(known, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def _id_type(rows: DataFrame) -> str:
    return dict(rows.dtypes)["doc_id"]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text: doc_id, ids (binary: little-endian unsigned 32-bit integers).

    Null text: empty, so no ids. Repeated rows, ties and null ids pass through row by row.
    Very long texts are encoded whole. ``path`` must exist on every worker.
    """

    def run(batches):
        c = codec(path, pattern)
        for b in in_slices(batches):
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = texts(docs, id_col=id_col, text_col=text_col)
    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, ids binary")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Decode (doc_id, ids) to (doc_id, text binary). Null ids decode to an empty text."""

    def run(batches):
        c = codec(path, pattern)
        for b in in_slices(batches):
            back = [c.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, text binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the text: doc_id, n_tokens, ids (binary), decoded
    (binary). Edge cases as in :func:`bpe_encode`."""

    def run(batches):
        c = codec(path, pattern)
        for b in in_slices(batches):
            ids = [c.encode(t) for t in b.column("text").to_pylist()]
            cols = [
                b.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([c.decode(x) for x in ids], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

    rows = texts(docs, id_col=id_col, text_col=text_col)
    return rows.mapInArrow(run, f"doc_id {_id_type(rows)}, n_tokens bigint, ids binary, decoded binary")
