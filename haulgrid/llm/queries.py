"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.llm.bpe import bpe_round_trip
from haulgrid.llm.common import table
from haulgrid.llm.exact_dedup import exact_dedup
from haulgrid.llm.html_text import extract_pages
from haulgrid.llm.line_dedup import duplicate_lines
from haulgrid.llm.mixing import mix_sources
from haulgrid.llm.nbsvm import fit_nbsvm, nbsvm_scores
from haulgrid.llm.pii import pseudonymize
from haulgrid.llm.quality_rules import fit_quality_model, quality_rules
from haulgrid.llm.simhash import simhash_components
from haulgrid.llm.wavelet import wavelet_output


def op1_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as wavelet shards and read back; null text: the end id alone, empty table: no rows."""
    return wavelet_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; null text: size 0, null source: a source of its own, last."""
    mix = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3, seed=1)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns only from rows with crc32(doc_id as text) mod 4 other than 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_nbsvm(docs, labels, "quality", max_rows=4000, where=~held_out)
    out = nbsvm_scores(docs, model)
    return out.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, kept row and digest of every document; null text counts as empty, repeated rows keep a row each."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that an earlier like line makes redundant; null text: one empty line."""
    drops = duplicate_lines(table(spark, sf_dir, "documents"), threshold=1, min_chars=20, least_words=8, fold_short=True)
    return drops.select("doc_id", "n_lines", "n_dropped", F.array_join("dropped", ",").alias("dropped"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; no words: fingerprint zero, null ids last as smallest id."""
    return simhash_components(table(spark, sf_dir, "documents"), radius=2, words_in_shingle=3, seed=42).drop("fp")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document; null text: no ids."""
    out = bpe_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null text: no words, so rejected; no usable labels: the base rules alone."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality_model(docs, table(spark, sf_dir, "labels"), "quality", max_rows=4000))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.haulgrid.pii.secret`` (a name that Spark redacts); without
    it, a public one that protects nothing and makes runs comparable."""
    key = spark.conf.get("spark.haulgrid.pii.secret", "public key of the example")
    return pseudonymize(table(spark, sf_dir, "documents"), spark.createDataFrame([(key,)], "key string"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null or empty html: an empty text."""
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_wavelet_output, op2_mix_sources, op3_nbsvm, op4_exact_dedup, op5_line_dedup, op6_simhash, op7_bpe, op8_quality_rules, op9_pii, op10_html_text)
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) AS marks,
                   (('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + CAST(0.5 AS DOUBLE))
                       / CAST(4503599627370496 AS DOUBLE) AS u
            FROM documents
        ), keyed AS (
            SELECT *, -ln(u) / (CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(10 AS DOUBLE) * marks / (size + 1))) AS key FROM sized
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight
            FROM keyed GROUP BY source
        ), ahead AS (
            SELECT *, CAST(3 * source_size AS DOUBLE) AS cap,
                   coalesce(sum(CAST(3 * source_size AS DOUBLE)) OVER before, 0) AS caps_before,
                   coalesce(sum(weight) OVER before, 0) AS weight_before,
                   sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
            FROM sources
            WINDOW before AS (ORDER BY 3 * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), fixed AS (
            SELECT *, cap <= (total - caps_before) / (weights - weight_before) * weight AS capped FROM ahead
        ), wanted AS (
            SELECT source, source_size,
                   CASE WHEN capped THEN cap ELSE
                       (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) * weight / sum(weight) FILTER (NOT capped) OVER () END AS target
            FROM fixed
        ), placed AS (
            SELECT k.doc_id, k.size, w.source_size, w.target, floor(w.target / greatest(w.source_size, 1)) AS epochs,
                   sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
            FROM keyed k JOIN wanted w ON k.source IS NOT DISTINCT FROM w.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * (epochs + CAST(2 * (target - epochs * source_size - before) >= size AS INTEGER)) AS BIGINT) AS taken
        FROM placed
    """,
    # one edit leaves the first or the second half of a line, or of its words, as it was
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents
        ), counted AS (
            SELECT doc_id, pos, line, length(line) AS n FROM lines WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]')
        ), firsts AS (
            SELECT line, n, string_split(line, ' ') AS w, min({d: doc_id, p: pos}) AS first FROM counted GROUP BY ALL
        ), by_chars AS (
            SELECT DISTINCT b.line FROM firsts a JOIN firsts b
            ON b.n BETWEEN a.n - 1 AND a.n + 1 AND a.first < b.first
               AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2)
                    OR right(a.line, least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) // 2))
            WHERE a.n >= 20 AND b.n >= 20 AND levenshtein(a.line, b.line) <= 1
        ), halves AS (
            SELECT line, w, first, len(w) AS m, unnest([len(w), len(w) - 1]) AS o FROM firsts WHERE n >= 20 AND len(w) >= 8
        ), keys AS (
            SELECT line, w, first, m, o, 1 AS side, w[1:o // 2] AS half FROM halves WHERE o >= 8
            UNION ALL SELECT line, w, first, m, o, 2, w[m - o + o // 2 + 1:m] FROM halves WHERE o >= 8
        ), pairs AS (
            SELECT DISTINCT a.line AS la, a.w AS wa, a.first AS fa, b.line AS lb, b.w AS wb, b.first AS fb, least(a.m, b.m) AS lo, greatest(a.m, b.m) AS hi
            FROM keys a JOIN keys b ON a.o = b.o AND a.side = b.side AND a.half = b.half AND a.o = a.m AND a.line <> b.line
        ), by_words AS (
            SELECT CASE WHEN fa < fb THEN lb ELSE la END AS line FROM pairs
            WHERE coalesce(nullif(list_position(list_transform(range(1, lo + 1), lambda i: wa[i] = wb[i]), false), 0) - 1, lo)
                + coalesce(nullif(list_position(list_transform(range(1, lo + 1), lambda i: wa[-i] = wb[-i]), false), 0) - 1, lo) >= hi - 1
        ), near AS (
            SELECT line FROM by_chars UNION SELECT line FROM by_words
        ), gone AS (
            SELECT l.doc_id, l.pos FROM counted l JOIN firsts f ON l.line = f.line
            WHERE {d: l.doc_id, p: l.pos} <> f.first OR l.line IN (SELECT line FROM near)
        ), per_doc AS (
            SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS dropped FROM gone GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS INTEGER) AS n_lines,
               CAST(coalesce(g.n, 0) AS INTEGER) AS n_dropped, coalesce(g.dropped, '') AS dropped
        FROM documents d LEFT JOIN per_doc g ON d.doc_id = g.doc_id
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
