"""Roster feasibility of monthly, observed and daily numbers of districts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.functions import geo
from haulgrid.operators.stability import depot_day

PERCENT = ("feasible_monthly", "under_load", "over_load", "feasible_observed", "feasible_daily_roster")


def rosters(d: DataFrame, target: float = 70.0) -> DataFrame:
    """Districts of each depot and month: mean weekday volume over the target."""
    return rosters_of(depot_day(d.filter("dow < 5")), target)


def rosters_of(days: DataFrame, target) -> DataFrame:
    """The same of weekdays' volumes (depot, date, m, V)."""
    return days.groupBy("depot", "m").agg(F.avg("V").alias("mean_v")).withColumn("K", geo.roster("mean_v", target))


def feasibility(d: DataFrame, target: float = 70.0, low: float = 60.0, high: float = 80.0) -> DataFrame:
    """Flags for each weekday that has a month before it."""
    days = depot_day(d.filter("dow < 5")).drop("dow")
    before = rosters(d, target).select("depot", (F.col("m") + 1).alias("m"), F.col("K").alias("K_month"))
    v = F.col("V")

    def fits(k):
        return (v >= F.lit(low) * k) & (v <= F.lit(high) * k)

    down, up = (F.greatest(F.lit(1), f(v / F.lit(target)).cast("int")) for f in (F.floor, F.ceil))
    return days.join(before, ["depot", "m"]).select(
        "depot", "date", F.col("m").alias("month"), "V", "K_month", F.col("k_obs").alias("k_observed"),
        fits(F.col("K_month")).alias("feasible_monthly"), (v < F.lit(low) * F.col("K_month")).alias("under_load"),
        (v > F.lit(high) * F.col("K_month")).alias("over_load"), fits(F.col("k_obs")).alias("feasible_observed"),
        (fits(down) | fits(up)).alias("feasible_daily_roster"))


def feasibility_summary(days: DataFrame) -> DataFrame:
    """Percentages by depot and over all, in one pass with a rollup."""
    share = [(F.avg(F.col(c).cast("int")) * 100).alias(c) for c in PERCENT]
    out = days.rollup("depot").agg(F.grouping("depot").alias("total"), F.count(F.lit(1)).alias("test_days"), *share)
    return out.withColumn("depot", F.when(F.col("total") == 1, "All").otherwise(F.col("depot"))).drop("total")


def infeasible_certificate(d: DataFrame, k: int, delta: float = 1 / 7) -> DataFrame:
    """Days on which one unit alone exceeds a district's upper bound."""
    unit = d.groupBy("depot", "date", "bu").agg(F.count(F.lit(1)).alias("n"))
    day = unit.groupBy("depot", "date").agg(F.max("n").alias("max_bu"), F.sum("n").alias("V"))
    top = F.col("V") / F.lit(float(k)) * F.lit(1 + delta)
    return day.select("depot", "date", "V", "max_bu", (F.col("max_bu") / top).alias("max_bu_over_hi"), (F.col("max_bu") > top).alias("infeasible"))
