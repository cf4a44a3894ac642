"""SimHash near-duplicates: tiled exact comparison, then connected components."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import drop_path, in_slices, materialize, texts

#: Bits of a tile key that one block's population count takes, by number of blocks: enough for
#: the count plus the radius, so a step outside the range never meets a real count.
FIELD = {4: 5, 8: 4, 16: 3}
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, words_in_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text over word shingles, repeats included.

    A-Z are lower-cased and words end at ASCII white space. A bit is set if it is set in over
    half of the shingle hashes (XXH64). No words: zero.
    """
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    n = len(words) - k + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    octets = h.view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in in_slices(batches):
            fps = np.array([fingerprint(t, words_in_shingle, seed) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = texts(docs, id_col=id_col, text_col=text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def _steps(blocks: int, radius: int) -> list[int]:
    """Tile keys within the radius of a tile, as differences; one of each pair of opposites."""
    shift, found = FIELD[blocks], set()

    def walk(i: int, left: int, code: int) -> None:
        if i == blocks:
            if code >= 0:
                found.add(code)
            return
        for d in range(-left, left + 1):
            walk(i + 1, left - abs(d), code + (d << shift * i))

    walk(0, radius, 0)
    return sorted(found)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b of one tile pair, reduced to as many as join the same vertices."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = np.arange(len(nodes))
    i, j = at[:len(a)], at[len(a):]
    while True:
        low = np.minimum(up[i], up[j])
        new = up.copy()
        np.minimum.at(new, up[i], low)
        np.minimum.at(new, up[j], low)
        new = new[new]
        if (new == up).all():
            break
        up = new
    keep = up != np.arange(len(nodes))
    return nodes[keep], nodes[up[keep]]


def tiled_links(fps: DataFrame, radius: int = 2, tile_rows: int = 512, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fps.fp`` within ``radius`` bits.

    A tile holds fingerprints with the same population counts of each block of bits. Two
    fingerprints at d bits have block counts that differ by at most d in sum, so tile pairs
    beyond the radius are skipped unread; all others are compared in full with exclusive-or and
    bit counts. Large tiles are split into chunks of about ``tile_rows``, each chunk pair being
    work of its own. More blocks make finer tiles: the number follows the number of
    fingerprints, the links don't depend on it. A tile pair returns a spanning forest of its
    links, so a group of n near copies gives about n rows, not n squared.
    """
    if blocks is None:
        n = fps.count()
        blocks = 4 if n < 2_000_000 else 8 if n < 2_000_000_000 else 16
    shift, bits = FIELD[blocks], 64 // blocks
    mask = (1 << bits) - 1
    key = sum(
        F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit(mask))).cast("bigint") * F.lit(1 << shift * i)
        for i in range(blocks)
    )
    keyed = fps.select("fp", key.alias("tile"))
    per_tile = keyed.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("bigint").alias("chunks"))
    packed = (
        keyed.join(per_tile, "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles, path = materialize(packed, "tiles")
    # the steps meet thin keys first; fingerprints come along only for tile pairs that exist
    steps = F.array(*[F.lit(s).cast("bigint") for s in _steps(blocks, radius)])
    keys = tiles.select("tile", "chunk")
    left = keys.select(F.col("tile").alias("left"), F.col("chunk").alias("i"), F.explode(steps).alias("step"))
    left = left.withColumn("tile", F.col("left") + F.col("step"))
    pairs = left.join(keys, "tile").filter((F.col("step") != 0) | (F.col("i") <= F.col("chunk"))).select("left", "i", "tile", "chunk")
    pairs = pairs.join(tiles.select(F.col("tile").alias("left"), F.col("chunk").alias("i"), F.col("fps").alias("x")), ["left", "i"])
    pairs = pairs.join(tiles, ["tile", "chunk"]).select("x", "fps")

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            x, y = batch.column("x"), batch.column("fps")
            xs, ys = x.flatten().to_numpy(), y.flatten().to_numpy()
            xo, yo = np.cumsum([0, *x.value_lengths().to_pylist()]), np.cumsum([0, *y.value_lengths().to_pylist()])
            for k in range(len(x)):
                a, b = xs[xo[k]:xo[k + 1]], ys[yo[k]:yo[k + 1]]
                i, j = np.nonzero(np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= radius)
                apart = a[i] != b[j]
                if apart.any():
                    p, q = _forest(a[i[apart]], b[j[apart]])
                    out_a.append(p)
                    out_b.append(q)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): node, root (smallest node of its component).

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each is a map-side
    aggregation for the smallest neighbour and a join that adaptive execution may split, so a
    node with very many neighbours is no task of its own. Rounds end when the set of edges no
    longer changes; edges live in the shared folder, not in lineage.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(low, "a")
        if large:
            new = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return new.filter("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    # every edge points from its larger to its smaller node
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, path = materialize(down, "edges")
    before = state(edges)
    for _ in range(max_rounds):
        large, large_path = materialize(star(edges, True), "edges")
        drop_path(edges.sparkSession, path)
        edges, path = materialize(star(large, False), "edges")
        drop_path(edges.sparkSession, large_path)
        if (now := state(edges)) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def simhash_components(docs: DataFrame, radius: int = 2, words_in_shingle: int = 3, seed: int = 42,
                       id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Fingerprint every text and link those within ``radius`` bits, transitively.

    Result: doc_id, fp (signed long), fingerprint (16 hex digits), component_id (smallest
    doc_id reachable, the document itself included); one row per input row.

    * null or empty text, or white space only: fingerprint zero, linked like any other.
    * null id: never a component's smallest id unless all ids of the component are null.
    * repeated rows: each is returned. Empty table: empty result.
    """
    prints, path = materialize(fingerprints(docs, words_in_shingle, seed, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    distinct, distinct_path = materialize(distinct, "distinct")
    roots = components(tiled_links(distinct.select("fp"), radius, **more))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    by_root = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = labelled.join(by_root, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id. Rows that
    repeat an id count as one document, so one of them stays; rows without an id can't be told
    apart and stay."""
    first = labelled.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(first, F.col(id_col) == F.col("_id"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
