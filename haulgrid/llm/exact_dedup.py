"""Exact deduplication over whole texts, in built-in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import texts


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    digest: Callable[[Column], Column] = _md5,
) -> DataFrame:
    """Group equal texts and name the row of each group that stays.

    Rows are grouped by a 128-bit content hash *and* the text itself, so the grouping compares
    bytes and two texts that share a hash stay apart. Map-side aggregation folds the copies of
    a text into one row per map task before anything is shuffled, however large the group.
    Members then find their group by (hash, sha256), both thin; should two different texts ever
    share that pair, the query fails rather than merge them.

    Result: doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    * null text: an empty text. Null id: sorts below all others; it stays only if the whole
      group has null ids.
    * repeated rows (same id, same text): each is returned and counted in group_size, exactly
      one of them has kept = true.
    * empty table: empty result. Extra columns are not read.
    """
    rows = texts(docs, id_col=id_col, text_col=text_col)
    best = F.max if keep == "largest" else F.min
    sha = F.sha2(F.col("text").cast("binary"), 256)
    groups = (
        rows.groupBy(digest(F.col("text")).alias("h"), "text")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", sha.alias("text_sha256"), "keep_id", "group_size")
    )
    groups = groups.groupBy("h", "text_sha256").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts share both digests")).cast("bigint"))
        .otherwise(F.max("keep_id")).alias("keep_id"),
        F.max("group_size").alias("group_size"),
    )
    members = (
        rows.select("doc_id", digest(F.col("text")).alias("h"), sha.alias("text_sha256"))
        .groupBy("h", "text_sha256", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # a key of its own makes both sides plain exchanges, so adaptive execution may split a hot one
    key = F.concat("h", F.unhex("text_sha256")).alias("k")
    groups = groups.select(key, "keep_id", "group_size")
    return (
        members.select(key, "text_sha256", "doc_id", "copies").join(groups, "k")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
