"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
MARKS = r"[#*$%&|<>!]"


def quality_weight(text: Column, size: Column) -> Column:
    """Default document quality weight, in (0, 1]: falls with marks per word."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * F.regexp_count(text, F.lit(MARKS)) / (size + F.lit(1)))


def targets(sources: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Target of each source (columns source, source_size, ...), in words.

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all
    sizes by weight; no target exceeds ``cap`` times its source's size, and what lies above is
    shared again by weight. That ends with every source at its cap or at one common level times
    its weight. The capped ones have the smallest cap per weight, so one running sum over the
    sources in that order finds the level. Sources of size zero get target zero. One row per
    source passes through one task; rows of documents never do.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    listed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    listed = listed.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    whole = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    listed = listed.withColumn("capped", F.col("limit") <= level * F.col("weight"))
    spare = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    return listed.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(spare * F.col("weight") / open_weight)).drop(
        "weight", "limit", "capped")


def mix_sources(
    docs: DataFrame,
    weights: tuple = (1, 2, 3),
    cap: int = 3,
    seed: int = 1,
    quality=quality_weight,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often a mix takes each document.

    Every document gets the key -ln(u) / quality with u drawn from a hash of its id. A source
    whose target is k times its size and a rest is taken k times whole; then its documents are
    taken once more in key order while that brings their words nearer to the rest. So words
    taken differ from the target by at most half a document, and no document is taken more than
    ``cap`` times.

    Prefix sums are distributed: keys fall into bins, about the square root of the row count,
    sums per (source, bin) are aggregated map-side, a running sum over bins gives each bin's
    start, and only within a bin are documents sorted. A source with a third of all rows is as
    many small groups as there are bins.

    Result: doc_id, source, size (words), source_size, target, copies, taken (= size * copies).

    * null text: size 0, taken 0. Null source: a source of its own, last in order.
    * null ids share one key; ties and repeated rows are ordered by key, id and size, and rows
      that agree in all three are alike, so reruns agree. Empty table: empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    u = (number.cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), u.alias("u"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "source", "size", (-F.log("u") / quality(F.col("text"), F.col("size"))).alias("key"))
    thin, _ = materialize(rows, "mix-keys")
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n = sources.agg(F.sum("n")).first()[0] or 0
    bins = max(16, math.isqrt(n))
    name = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless")]
    binned = thin.select("*", *name, F.floor(F.col("key") / (F.col("key") + 1) * bins).alias("bin"))
    per_bin = binned.groupBy("name", "nameless", "bin").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("name", "nameless").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    starts = per_bin.select("name", "nameless", "bin", (F.sum("words").over(up_to) - F.col("words")).alias("start"))
    wanted = targets(sources.drop("n"), weights, cap).select("source_size", "target", *name)
    wanted = wanted.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    wanted = wanted.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = starts.join(wanted, ["name", "nameless"])
    inside = Window.partitionBy("name", "nameless", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.join(plan, ["name", "nameless", "bin"])
    ahead = F.col("start") + F.sum("size").over(inside) - F.col("size")
    copies = (F.col("epochs") + (F.lit(2) * (F.col("rest") - ahead) >= F.col("size")).cast("int")).cast("bigint")
    return placed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.least(copies, F.lit(1))).alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; rows that repeat an id are taken
    alike (as often as the most taken of them)."""
    plan = mix.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    rows = docs.join(plan, F.col(id_col).eqNullSafe(F.col("_id")))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select(*docs.columns)
