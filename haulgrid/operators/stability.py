"""Workload stability over parcels (depot, date, m, dow, t, cid, x, y, bu, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _n():
    return F.count(F.lit(1))


def weekdays(d: DataFrame) -> DataFrame:
    return d.filter("dow < 5")


def depot_day(d: DataFrame) -> DataFrame:
    """Volume and couriers of each depot-day."""
    return d.groupBy("depot", "date").agg(_n().alias("V"), F.countDistinct("cid").alias("k_obs"), F.min("m").alias("m"), F.min("dow").alias("dow"))


def depot_profile(d: DataFrame) -> DataFrame:
    """Days, median volume and couriers by depot and weekday flag."""
    return depot_day(d).groupBy("depot", (F.col("dow") < 5).alias("weekday")).agg(
        _n().alias("days"), F.median("V").alias("V"), F.median("k_obs").alias("k"), F.count_if(F.col("dow") == 6).alias("sundays"))


def courier_day_location(d: DataFrame) -> DataFrame:
    """Coordinate-wise median location of each courier-day."""
    return d.groupBy("depot", "cid", "date").agg(F.median("x").alias("x"), F.median("y").alias("y"))


def displacement(d: DataFrame) -> DataFrame:
    """Distance of each courier-day's location from the courier's working day before."""
    w = Window.partitionBy("depot", "cid").orderBy("date")
    return courier_day_location(d).withColumn("disp", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))


def drift(d: DataFrame) -> DataFrame:
    """Median, upper quartile and share above 2 km (of all courier-days) of the displacement."""
    return displacement(d).groupBy("depot").agg(
        F.median("disp").alias("drift_med"), F.percentile("disp", 0.75).alias("drift_p75"),
        (F.avg(F.coalesce((F.col("disp") > 2000).cast("int"), F.lit(0))) * 100).alias("drift_gt2km"))


def bu_purity(d: DataFrame) -> DataFrame:
    """Share of parcels delivered by each unit's busiest courier, by month, averaged over months."""
    per = d.groupBy("depot", "m", "bu", "cid").agg(_n().alias("n"))
    unit = per.groupBy("depot", "m", "bu").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    month = unit.groupBy("depot", "m").agg((F.sum("top") / F.sum("n")).alias("p"))
    return month.groupBy("depot").agg((F.avg("p") * 100).alias("purity"))


def bu_mode(d: DataFrame) -> DataFrame:
    """Busiest courier of each unit and month; of equals the smallest id."""
    per = d.groupBy("depot", "m", "bu", "cid").agg(_n().alias("n"))
    return per.groupBy("depot", "m", "bu").agg(F.min(F.struct(-F.col("n"), F.col("cid")))["cid"].alias("mode_cid"))


def mode_share(d: DataFrame) -> DataFrame:
    """Share of a month's parcels that go to the unit's busiest courier of the month before,
    of those in units that have one; mean over months."""
    before = bu_mode(d).select("depot", (F.col("m") + 1).alias("m"), "bu", "mode_cid")
    counts = d.groupBy("depot", "m", "bu", "cid").agg(_n().alias("n"))  # one row per group before the join
    month = counts.join(before, ["depot", "m", "bu"]).groupBy("depot", "m").agg(
        (F.sum(F.when(F.col("cid") == F.col("mode_cid"), F.col("n")).otherwise(0)) / F.sum("n")).alias("s"))
    return month.groupBy("depot").agg((F.avg("s") * 100).alias("prev_month_mode_share"))


def bu_cv(d: DataFrame, least: float = 2.0) -> DataFrame:
    """Median coefficient of variation of daily demand over units with a mean of ``least`` or
    more, days without demand counted as zero: from sums, without a pivot."""
    days = d.groupBy("depot").agg(F.countDistinct("date").alias("days"))
    daily = d.groupBy("depot", "bu", "date").agg(_n().alias("n"))
    unit = daily.groupBy("depot", "bu").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("s2")).join(days, "depot")
    unit = unit.withColumn("mu", F.col("s") / F.col("days")).filter(F.col("mu") >= least)
    var = (F.col("s2") - F.col("s") * F.col("s") / F.col("days")) / (F.col("days") - 1)
    return unit.withColumn("cv", F.sqrt(F.greatest(var, F.lit(0.0))) / F.col("mu")).groupBy("depot").agg(F.median("cv").alias("bu_cv_med"))


def workload(d: DataFrame) -> DataFrame:
    """Median parcels of a courier-day, and median over days of their sample CV."""
    per = d.groupBy("depot", "date", "cid").agg(_n().alias("w"))
    day = per.groupBy("depot", "date").agg((F.stddev_samp("w") / F.avg("w")).alias("cv"))
    return per.groupBy("depot").agg(F.median("w").alias("w_med")).join(day.groupBy("depot").agg(F.median("cv").alias("w_cv")), "depot")


def stability(d: DataFrame) -> DataFrame:
    """All stability measures, one row per depot."""
    d = weekdays(d)
    out = d.groupBy("depot").agg(_n().alias("parcels"), F.countDistinct("cid").alias("couriers"))
    for part in (drift(d), bu_purity(d), mode_share(d), bu_cv(d), workload(d)):
        out = out.join(part, "depot", "left")
    return out


def path_length(s: DataFrame, key: str = "event_id") -> DataFrame:
    """Kilometres along the scans of each courier-day in time order."""
    w = Window.partitionBy("depot", "date", "cid").orderBy("t", key)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return s.withColumn("step", step).groupBy("depot", "date", "cid").agg(_n().alias("n"), (F.coalesce(F.sum("step"), F.lit(0.0)) / 1000).alias("actual_km"))


def revisits(s: DataFrame, key: str = "event_id") -> DataFrame:
    """Stops (changes of unit), distinct units and their difference for each courier-day."""
    w = Window.partitionBy("depot", "date", "cid").orderBy("t", key)
    moved = s.withColumn("before", F.lag("bu").over(w)).filter(F.col("before").isNull() | (F.col("bu") != F.col("before")))
    return moved.groupBy("depot", "date", "cid").agg(
        _n().alias("visits"), F.countDistinct("bu").alias("stops"), (_n() - F.countDistinct("bu")).alias("revisits"))


def scan_span(s: DataFrame) -> DataFrame:
    """Minutes from the first to the last scan of each courier-day."""
    micro = F.unix_micros(F.col("t").cast("timestamp"))
    return s.groupBy("depot", "date", "cid").agg(((F.max(micro) - F.min(micro)) / F.lit(60e6)).alias("span_min"))


def sampled_courier_days(d: DataFrame, size: int = 150, least: int = 10, seed: str = "7") -> DataFrame:
    """A fixed sample of courier-days with enough parcels: those with the smallest digests."""
    per = d.groupBy("depot", "date", "cid").agg(_n().alias("n")).filter(F.col("n") >= least)
    order = F.md5(F.concat_ws("|", F.lit(seed), "depot", F.col("date").cast("string"), F.col("cid").cast("string")).cast("binary"))
    w = Window.partitionBy("depot").orderBy("h")
    return per.withColumn("h", order).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).drop("h", "rank")
