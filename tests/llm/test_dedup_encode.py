import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulgrid.llm.bpe import PerfectHash, bpe_decode, bpe_encode, bpe_round_trip, codec, merge_bytes
from haulgrid.llm.exact_dedup import exact_dedup
from haulgrid.llm.simhash import components, fingerprint, simhash_components, tiled_links
from haulgrid.llm.wavelet import Shard, WaveletMatrix, find_tokens, library_encoder, read_documents, write_shards

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  x", "naïve café 日本語 🙂🙂", "it's we'll I'D", "a" * 3000, "  12345 67", "\x00\x1c\x85​﻿", "<|endoftext|> y",
       "tab\tand\r\nreturn ", "x" * 40 + " " * 500 + "y", "Āā́ ١٢٣ ½", "!!??..,,"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, fp string, tile int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "h", "fp", 1) for i, t in rows], SCHEMA)


def test_exact_dedup_against_brute_force(spark):
    rows = [(i, random.Random(i).choice(ODD + [None])) for i in range(200)] + [(None, "only null id"), (5000, "twin"), (5000, "twin")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        group = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert r.group_size == len(group)
        assert r.keep_id == max((i for i in group if i is not None), default=None)
    for k in by:
        assert sum(r.kept for r in got if r.text_sha256 == hashlib.sha256(k.encode()).hexdigest()) == 1


def test_exact_dedup_keeps_colliding_texts_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(70)]
    got = exact_dedup(frame(spark, rows), keep="smallest", digest=lambda c: F.lit("same").cast("binary")).collect()
    assert {r.keep_id for r in got} == set(range(7)) and all(r.group_size == 10 for r in got)


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 17, 4000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = PerfectHash(keys)
        assert sorted(h.slot_of.tolist()) == list(range(n))
        assert (h.slots(keys) == h.slot_of).all()


def test_merges_equal_tiktoken_on_odd_words():
    c = codec(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdeéß日 ") for _ in range(rnd.randint(1, 40))) for _ in range(400)] + ODD
    for w in words:
        assert np.frombuffer(c.encode(w), "<u4").tolist() == own.encode_ordinary(w)
        if w:
            assert b"".join(c.bytes_of[i] for i in merge_bytes(w.encode(), c.ranks)) == w.encode()


def test_bpe_equals_tiktoken_and_round_trips(spark):
    rows = [*enumerate(ODD), (None, "null id"), (900, None), (901, "twin"), (901, "twin")]
    c = codec(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    got = bpe_round_trip(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in got) == sorted((i or -1, (t or "").encode()) for i, t in rows)
    for r in got:
        ids = own.encode_ordinary(bytes(r.decoded).decode())
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
    back = bpe_decode(bpe_encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.text) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe_encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_wavelet_matrix_against_the_plain_sequence(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 999).astype(np.uint16)
    m = Shard.load(Shard([1], np.array([n]), WaveletMatrix.build(ids, 10)).dump()).matrix
    assert (m.ids() == ids).all()
    for i in rng.integers(0, max(n, 1), 50 if n else 0).tolist():
        assert m.access(i) == ids[i]
        t, stop = int(ids[i]), int(rng.integers(0, n + 1))
        assert m.count(t) == (ids == t).sum() and m.count(t, 3, stop) == (ids[3:stop] == t).sum()
        where = np.flatnonzero(ids == t)
        k = int(rng.integers(0, len(where)))
        assert m.locate(t, k) == where[k] and (m.positions(t) == where).all()
    assert m.count(1000) == 0 and m.count(5000) == 0


def test_wavelet_files_hold_the_library_ids(spark):
    rnd = random.Random(5)
    rows = [*enumerate(ODD), (40, None), (41, "twin"), (41, "twin"), *((i, " ".join(rnd.choice(ODD) for _ in range(5))) for i in range(50, 80))]
    rnd.shuffle(rows)
    shards, _ = write_shards(frame(spark, rows), library_encoder(JSON), 2, shard_tokens=3000)
    got = sorted(read_documents(shards).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(JSON)
    flat, start = [], 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda x: x[0]), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        flat += ids
    tokens = (2, flat[3], 50256, 49999)
    found = sorted((r.token, r.base + p) for r in find_tokens(shards, tokens).collect() for p in r.positions)
    assert found == sorted((t, k) for k, t in enumerate(flat) if t in tokens) and flat.count(50256) > 5
    empty, _ = write_shards(frame(spark, []), library_encoder(JSON), 2)
    assert read_documents(empty).count() == 0


def test_pieces_of_text_hold_the_ids_of_whole_texts():
    """The memo cuts and spells texts by itself: held against the library on random strings."""
    rnd, t, encode = random.Random(12), Tokenizer.from_file(JSON), library_encoder(JSON)()
    letters = ["a", "b", "Z", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "é", "ß", "日", "🙂", "\u00a0", "\u0301", "\r\n", "1", "23", "<|endoftext|>", "<|", "x\u200b", "ǅ", "%", ")", "?!"]
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(6000)]
    for k in range(0, len(made), 500):
        some = made[k:k + 500]
        for text, ids in zip(some, encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_by_its_definition():
    rnd = random.Random(2)
    for t in [*ODD, *(" ".join(rnd.choice("alpha Beta gamma Ünder x") for _ in range(n)) for n in (1, 2, 3, 50, 400, 700))]:
        assert fingerprint(t) == slow_fingerprint(t)


def brute_components(fps, radius=2):
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


@pytest.mark.parametrize("blocks", [4, 8, 16])
def test_tiled_links_and_components_against_all_pairs(spark, blocks):
    rng = random.Random(blocks)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= (1 << rng.randrange(64)) if rng.random() < 0.6 else 0
    want = brute_components(sorted(fps))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp bigint")
    roots = {r.node: r.root for r in components(tiled_links(df, 2, tile_rows=4, blocks=blocks)).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(signed[f], signed[f]), set()).add(f)
    by = {}
    for f, t in want.items():
        by.setdefault(t, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_simhash_query_edges(spark):
    rnd = random.Random(9)
    base = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randrange(50)) for _ in range(400)]
    rows = [(7, " ".join(base)), (3, " ".join(base)), (9, " ".join(base[:-1])), (11, None), (12, ""), (13, " \n"), (None, "solo text of its own"), (20, "x"), (20, "x")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_components(frame(spark, rows)).collect()}
    ids = {k[0]: v for k, v in got.items()}
    assert ids[7] == ids[3] == 3 and ids[11] == ids[12] == ids[13] == 11 and ids[20] == 20 and ids[None] is None
    assert simhash_components(frame(spark, [])).count() == 0
