"""Token ids in binary shards: one wavelet matrix per shard.

File format, little-endian (``WMX1``): magic (4 bytes), header length (u32), JSON header, then
sections, each compressed with zstd, at the offsets that the header gives:

* ``doc_ids`` i64 and ``doc_null`` u8 (ids that are null), ``lengths`` i64: the documents, in order;
* ``plane0`` .. ``plane{w-1}``: bit-planes from the highest bit down, eight positions a byte;
* ``rank0`` .. : set bits before every 512th position of a plane, u32.

``zeros`` in the header holds each plane's number of zero bits.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.llm.common import in_slices, materialize, texts
from haulgrid.llm.pretokens import PieceMemo, in_groups

MAGIC = b"WMX1"
BLOCK = 512
#: Punctuation that often ends a word.
CLOSING = ".,;:!?%&$*#|)"


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of ids below 2**width."""

    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.ranks, self.zeros, self.n = planes, ranks, zeros, n
        self.width = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        n, rest = len(ids), ids
        planes, ranks, zeros = [], [], []
        for level in range(width):
            bit = (rest & rest.dtype.type(1 << (width - 1 - level))) != 0
            packed = np.packbits(bit, bitorder="little")
            blocks = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
            blocks[:len(packed)] = packed
            ones = np.bitwise_count(blocks).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
            planes.append(packed)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
            unset = ~bit
            zeros.append(int(np.count_nonzero(unset)))
            parted = np.empty_like(rest)
            np.compress(unset, rest, out=parted[:zeros[-1]])
            np.compress(bit, rest, out=parted[zeros[-1]:])
            rest = parted
        return cls(planes, ranks, zeros, n)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Set bits before position i of a plane."""
        block = i // BLOCK
        start, whole = block * (BLOCK // 8), i >> 3
        count = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][start:whole]).sum())
        return count + (int(self.planes[level][whole] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) bits of that value in a plane, for an array of k."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = np.searchsorted(before, k, side="right") - 1
        own, at = np.unique(block, return_inverse=True)
        octets = np.zeros((len(before) - 1, BLOCK // 8), np.uint8)
        octets.reshape(-1)[:len(self.planes[level])] = self.planes[level]
        bits = np.unpackbits(octets[own], axis=1, bitorder="little") == bit
        if not bit:
            bits &= own[:, None] * BLOCK + np.arange(BLOCK) < self.n
        first = np.concatenate(([0], np.cumsum(bits.sum(1))[:-1]))
        found = np.flatnonzero(bits)[first[at] + k - before[block]]
        return block * BLOCK + found % BLOCK

    def _path(self, token: int, i: int) -> int:
        """Where the prefix [0, i) ends among the positions that share the token's bits."""
        for level in range(self.width):
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if token >> (self.width - 1 - level) & 1 else i - ones
        return i

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in [start, stop)."""
        stop = self.n if stop is None else min(stop, self.n)
        if token >> self.width or start >= stop:
            return 0
        return self._path(token, stop) - self._path(token, start)

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return int(self.positions(token, k, k + 1)[0])

    def positions(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the occurrences ``first`` to ``last`` (exclusive) of a token: select from
        the lowest plane up, for all of them at once."""
        n = self.count(token)
        last = n if last is None else min(last, n)
        if first >= last:
            return np.zeros(0, np.int64)
        at = self._path(token, 0) + np.arange(first, last)
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence: the stable partitions undone from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        got = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            got[self.zeros[level]:] |= kind(1 << (self.width - 1 - level))
            up = np.empty_like(got)
            up[np.concatenate((np.flatnonzero(~bit), np.flatnonzero(bit)))] = got
            got = up
        return got


class Shard:
    """One file: documents in order and the wavelet matrix of their ids."""

    def __init__(self, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def dump(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        m = self.matrix
        sections = {
            "doc_ids": np.array([d or 0 for d in self.doc_ids], "<i8"),
            "doc_null": np.array([d is None for d in self.doc_ids], np.uint8),
            "lengths": self.lengths.astype("<i8"),
        }
        sections |= {f"plane{k}": p for k, p in enumerate(m.planes)}
        sections |= {f"rank{k}": r.astype("<u4") for k, r in enumerate(m.ranks)}
        body, at = [], {}
        end = 0
        for name, data in sections.items():
            packed = pack(data.tobytes())
            at[name] = [end, len(packed)]
            end += len(packed)
            body.append(packed)
        head = json.dumps({"n": m.n, "width": m.width, "zeros": m.zeros, "sections": at}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *body])

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        if blob[:4] != MAGIC:
            raise ValueError("not a WMX1 shard")
        size = struct.unpack_from("<I", blob, 4)[0]
        head, start = json.loads(blob[8:8 + size]), 8 + size
        unpack = zstandard.ZstdDecompressor().decompress

        def part(name: str, kind: str) -> np.ndarray:
            at, length = head["sections"][name]
            return np.frombuffer(unpack(blob[start + at:start + at + length]), kind)

        planes = [part(f"plane{k}", np.uint8) for k in range(head["width"])]
        ranks = [part(f"rank{k}", "<u4") for k in range(head["width"])]
        ids = [None if gone else d for d, gone in zip(part("doc_ids", "<i8").tolist(), part("doc_null", np.uint8), strict=True)]
        return cls(ids, part("lengths", "<i8"), WaveletMatrix(planes, ranks, head["zeros"], head["n"]))


def _byte_letters() -> dict[str, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _library(path: str) -> Callable[[list[str]], list[bytes]]:
    """Encoder over the tokenizers library for a byte-level BPE file.

    Merges never cross a pre-token, so the library is asked once for each distinct piece of
    text that a worker meets, not for each occurrence; a test holds the ids against the
    library's own encoding of whole texts. New pieces go to the library as one string with a line end
    between each two, which before anything but white space is a pre-token of its own. Texts that
    hold a special token's string go to the library whole, which finds it as it always does.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    added = tuple(t.content for t in model.get_added_tokens_decoder().values())

    def flat(text: str) -> np.ndarray:
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    line_end = flat("\n")
    if len(line_end) != 1:
        raise ValueError("a line end must be one token")

    end, cores = line_end.tobytes(), {}
    tokenize, raw_id = model.model.tokenize, [k.to_bytes(4, "little") for k in range(model.get_vocab_size())]
    spelled = str.maketrans(_byte_letters())

    def encode_cores(new: list[str]) -> None:
        """A core of letters is one pre-token and goes to the library's merges alone; any other
        goes through all of the library."""
        mixed = []
        for c in new:
            word = c[1:] if c[0] == " " else c
            if word.isalpha():
                plain = c.replace(" ", "\u0120") if c.isascii() else c.encode("utf-8").decode("latin-1").translate(spelled)
                cores[c] = b"".join([raw_id[t.id] for t in tokenize(plain)])
            else:
                mixed.append(c)
        if mixed:
            ids = flat("\n".join(mixed))
            raw, edges = ids.tobytes(), [-4, *(4 * np.flatnonzero(ids == line_end[0])).tolist(), 4 * len(ids)]
            cores.update(zip(mixed, (raw[a + 4:z] for a, z in zip(edges, edges[1:], strict=False)), strict=True))

    def many(pieces: list[str]) -> list[bytes]:
        # closing punctuation after a letter or digit is a pre-token of its own
        bare = [p[1:] if p[0] == "\n" else p for p in pieces]
        short = [p.rstrip(CLOSING) for p in bare]
        short = [c if c and c[-1].isalnum() else p for c, p in zip(short, bare, strict=True)]
        tails = [p[len(c):] for c, p in zip(short, bare, strict=True)]
        if len(cores) > 300_000:
            cores.clear()
        if new := [c for c in {*short, *tails} if c and c not in cores]:
            encode_cores(new)
        cores[""] = b""
        return [
            (end if p[0] == "\n" else b"") + cores[c] + cores[t]
            for p, c, t in zip(pieces, short, tails, strict=True)
        ]

    return PieceMemo(many, lambda text: flat(text).tobytes(), limit=600_000, apart=added).ids_many


def library_encoder(path: str) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    """What gives a worker its encoder; all tasks of a worker share one."""
    return lambda: _library(path)


def write_shards(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    end_id: int,
    width: int = 16,
    shard_tokens: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, str]:
    """Encode, order by id and write shards; returns the table of shards and its path.

    Range partitioning puts ids in ascending order over the tasks; ties of one id are spread
    by a hash of the text, so one id with very many rows stays divisible. Each task cuts its
    documents into shards of about ``shard_tokens`` ids (a longer document is a shard of its
    own) and holds one shard in memory. Spark's own committer writes the shards, one row each,
    so a lost task leaves nothing half written and any store that Spark knows will do.
    """
    rows = texts(docs, id_col=id_col, text_col=text_col).withColumn("tie", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        encode = encoder()
        end = np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        held, lengths, ids = [], [], []

        def shard() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), "<u4")
            if len(flat) and int(flat.max()) >> width:
                raise ValueError(f"an id does not fit {width} bits")
            flat = flat.astype(np.uint16) if width <= 16 else flat
            n = np.array(lengths, np.int64)
            blob = Shard(held[:], n, WaveletMatrix.build(flat, width)).dump()
            cols = [[part], [seq], [len(flat)], [len(held)], [blob]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)],
                ["part", "seq", "n_tokens", "n_docs", "blob"],
            )

        size = 0
        for b in in_slices(batches):
            coded = (one for some in in_groups(b.column("text").to_pylist()) for one in encode(some))
            for doc, one in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                one += end
                held.append(doc)
                ids.append(one)
                lengths.append(len(one) // 4)
                size += lengths[-1]
                if size >= shard_tokens:
                    yield shard()
                    held, lengths, ids, size, seq = [], [], [], 0, seq + 1
        if held:
            yield shard()

    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = ordered.mapInArrow(run, "part bigint, seq bigint, n_tokens bigint, n_docs bigint, blob binary")
    return materialize(shards, "wavelet")


def _bases(shards: DataFrame) -> DataFrame:
    """part, seq, base: the number of ids in all shards before, by a running sum over the shards
    of a task, then over tasks; both sums see only the counts, one row each."""
    sizes = shards.select("part", "seq", "n_tokens")
    per_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    part_base = per_part.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq")
    bases = sizes.select("part", "seq", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("seq_base"))
    return bases.join(part_base, "part").select("part", "seq", (F.col("part_base") + F.col("seq_base")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32. ``start`` counts
    the ids of all documents before it."""

    def run(batches):
        for b in batches:
            for part, seq, blob in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "blob")), strict=True):
                s = Shard.load(blob)
                raw = memoryview(s.matrix.ids().astype("<u4").tobytes())
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(s.doc_ids, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    local = shards.select("part", "seq", "blob").mapInArrow(
        run, "part bigint, seq bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return local.join(_bases(shards), ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def find_tokens(shards: DataFrame, tokens: tuple[int, ...]) -> DataFrame:
    """Occurrences of tokens from rank and select of each shard: token, base (ids before the
    shard), n, positions within the shard (ascending). Shards without a token have no row."""

    def run(batches):
        for b in batches:
            for part, seq, blob in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "blob")), strict=True):
                m = Shard.load(blob).matrix
                for token in tokens:
                    if n := m.count(token):
                        at = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(m.positions(token)))
                        cols = [*(pa.array([v], pa.int64()) for v in (part, seq, token, n)), at]
                        yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "token", "n", "positions"])

    found = shards.select("part", "seq", "blob").mapInArrow(run, "part bigint, seq bigint, token bigint, n bigint, positions array<bigint>")
    return found.join(_bases(shards), ["part", "seq"]).select("token", "base", "n", "positions")


def wavelet_output(docs: DataFrame, path: str, end_id: int = 2, **more) -> DataFrame:
    """Write ``docs`` as shards and return what the shards say of each document.

    Null text: only the end id (special tokens' strings in a text become their ids, as in the
    library). Null ids come first, repeated rows keep a place each (order
    among equal rows is free, and their contents are equal). Empty table: no shards, no rows.
    """
    shards, _ = write_shards(docs, library_encoder(path), end_id, **more)
    return read_documents(shards)
