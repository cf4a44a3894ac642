"""Comparison of designs over day rows (depot, date, design, ...) and routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgrid.sources.fixtures import DESIGNS

DAY = ("depot", "date", "design")


def _n() -> Column:
    return F.count(F.lit(1))


def design_pivot(df: DataFrame, value: str, index: Sequence[str] = ("depot", "date"), designs: Sequence[str] = DESIGNS, how: str = "avg") -> DataFrame:
    """One column per design; the value list is given, so no pass collects it."""
    return df.groupBy(*index).pivot("design", list(designs)).agg(getattr(F, how)(value))


def pair_differences(df: DataFrame, value: str, pairs: Sequence[tuple[str, str]], index: Sequence[str] = ("depot", "date")) -> DataFrame:
    """Rows (index..., comp, a, b, d) of each pair with both values."""
    wide = design_pivot(df, value, index, sorted({x for p in pairs for x in p}))
    each = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("comp"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])
    out = wide.select(*index, F.explode(each).alias("p")).select(*index, "p.comp", "p.a", "p.b", (F.col("p.a") - F.col("p.b")).alias("d"))
    return out.filter(F.col("d").isNotNull())


def design_pairs(designs: DataFrame) -> DataFrame:
    """Unordered pairs of designs."""
    return designs.select(F.col("design").alias("a")).join(designs.select(F.col("design").alias("b")), F.col("a") < F.col("b"))


def fix_index(df: DataFrame, **columns: str) -> DataFrame:
    """For each name=source, 100 * source over FIX's value on the same depot-day: one window
    instead of a join with itself."""
    w = Window.partitionBy("depot", "date")
    base = {n: F.max(F.when(F.col("design") == "FIX", F.col(c))).over(w) for n, c in columns.items()}
    return df.withColumns({n: F.try_divide(F.col(columns[n]) * 100, base[n]) for n in columns})


def road_day(routes: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Kilometres, minutes and routes of each variant, day and design."""
    return routes.groupBy("variant", *DAY).agg(
        F.sum(F.col("route_km") + F.col("intra_km") * multiplier).alias("road_km"), F.sum("route_min").alias("road_min"), _n().alias("routes"))


def road_day_join(metrics: DataFrame, road: DataFrame) -> DataFrame:
    """Day rows with their road totals (missing ones stay null) and indices against FIX."""
    road = road.filter("variant = 'base'").select(*DAY, "road_km", "road_min", "routes")
    return fix_index(metrics.join(road, list(DAY), "left"), ridx="road_km", midx="road_min", sidx="total_km")


def road_cost_table(road: DataFrame) -> DataFrame:
    out = road.filter("variant = 'base'").groupBy("depot", "design").agg(
        F.avg("road_km").alias("km"), F.avg("road_min").alias("mn"), F.avg("routes").alias("routes"))
    return out.withColumn("km_route", F.col("km") / F.col("routes"))


def relative_effect(df: DataFrame, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean percent difference of each pair, and the mean difference."""
    return pair_differences(df, value, pairs).groupBy("comp").agg(
        (F.avg(F.try_divide(F.col("a"), F.col("b")) - 1) * 100).alias("effect"), F.avg("d").alias("mean_diff"), _n().alias("n_days"))


def intra_share(routes: DataFrame, multipliers: Sequence[float] = (0.0, 1.0, 2.0)) -> DataFrame:
    """FIX kilometres and their within-cell share for each multiplier: the multipliers are
    columns of one pass, not copies of the rows."""
    fix = routes.filter("variant = 'base' AND design = 'FIX'")
    sums = fix.groupBy("depot").agg(F.sum("route_km").alias("r"), F.sum("intra_km").alias("i"))
    each = F.array(*[F.lit(float(m)) for m in multipliers])
    km = F.col("r") + F.col("i") * F.col("multiplier")
    return sums.withColumn("multiplier", F.explode(each)).select("depot", "multiplier", km.alias("km"), (100 * (1 - F.col("r") / km)).alias("intra_share"))


def seed_noise(road: DataFrame, a: str = "base", b: str = "seed1") -> DataFrame:
    """Differences of day kilometres between two seeds."""
    left = road.filter(F.col("variant") == a).select(*DAY, F.col("road_km").alias("km0"))
    both = left.join(road.filter(F.col("variant") == b).select(*DAY, F.col("road_km").alias("km1")), list(DAY))
    d = F.col("km1") - F.col("km0")
    return both.groupBy("depot").agg(
        F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.median(F.abs(d) / F.col("km0") * 100).alias("rel_median"),
        F.percentile(F.abs(d) / F.col("km0") * 100, 0.95).alias("rel_p95"))


def breakeven(df: DataFrame, a: str = "PEN1000", b: str = "DWS") -> DataFrame:
    """Extra metres and seconds per retained parcel, over days with continuity."""
    def at(design: str, c: str) -> Column:
        return F.max(F.when(F.col("design") == design, F.col(c)))

    day = df.groupBy("depot", "date").agg(
        (at(a, "road_km") - at(b, "road_km")).alias("dk"), (at(a, "road_min") - at(b, "road_min")).alias("dm"),
        (at(a, "cont") - at(b, "cont")).alias("dc"), at("FIX", "V").alias("V")).filter("dc IS NOT NULL")
    out = day.agg(_n().alias("n_days"), F.avg("dk").alias("dk"), F.avg("dm").alias("dm"), F.avg(F.col("dc") * F.col("V")).alias("parcels"))
    return out.select("*", F.try_divide(F.col("dk") * 1000, F.col("parcels")).alias("m_per_parcel"), F.try_divide(F.col("dm") * 60, F.col("parcels")).alias("s_per_parcel"))


def design_means(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("design",)) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def design_rank(df: DataFrame, value: str) -> DataFrame:
    """Ranks of designs within a depot-day, ties averaged, and the design ranked first."""
    day = Window.partitionBy("depot", "date")
    tie = Window.partitionBy("depot", "date", value)
    ranked = df.filter(F.col(value).isNotNull()).withColumn(
        "rank", F.rank().over(day.orderBy(value)) + (F.count(F.lit(1)).over(tie) - 1) / F.lit(2.0))
    best = F.min(F.struct(F.col(value), F.col("design"))).over(day)["design"]
    return ranked.select("depot", "date", "design", "rank", best.alias("best"))


def plan_age(metrics: DataFrame, keys: Sequence[str] = ("design",)) -> DataFrame:
    """Monthly means by test month of a plan's age measures."""
    return metrics.groupBy(*keys, F.month("date").alias("test")).agg(
        F.avg("inband").alias("inband"), F.avg("moved_share").alias("moved_share"))
