"""District measures over assignments (depot, date, design, bu, k, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ("depot", "date", "design")


def _n() -> Column:
    return F.count(F.lit(1))


def band(load: Column, mu: Column, delta: float, slack: float = 1e-6) -> Column:
    return load.between(mu * (1 - delta) - slack, mu * (1 + delta) + slack)


def bu_demand(d: DataFrame) -> DataFrame:
    """Mean daily parcels of each unit over the days of its depot and month."""
    days = d.groupBy("depot", "m").agg(F.countDistinct("date").alias("days"))
    return d.groupBy("depot", "m", "bu").agg(_n().alias("n")).join(days, ["depot", "m"]).select(
        "depot", "m", "bu", (F.col("n") / F.col("days")).alias("w"))


def bu_position(units: DataFrame) -> DataFrame:
    """Position of each unit in the string order of its depot and training month."""
    return units.select("*", (F.row_number().over(Window.partitionBy("depot", "train").orderBy("bu")) - 1).alias("pos"))


def bu_union(d: DataFrame) -> DataFrame:
    """Units of a training month and the month after it."""
    train = d.select("depot", F.col("m").alias("train"), "bu")
    test = d.filter("m > 1").select("depot", (F.col("m") - 1).alias("train"), "bu")
    return train.union(test).distinct()


def district_load(a: DataFrame, k: int) -> DataFrame:
    """Load of each of the k districts of a day and design, empty ones included."""
    load = a.groupBy(*DAY, "k").agg(F.sum("n").alias("load"))
    every = a.select(*DAY).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    return every.join(load, [*DAY, "k"], "left").withColumn("load", F.coalesce("load", F.lit(0)))


def plan_balance(loads: DataFrame, keys: tuple = ("depot", "date", "design"), eps: float = 0.05) -> DataFrame:
    """Largest relative deviation from the mean load, and shares within bands around it."""
    mean = loads.groupBy(*keys).agg(F.avg("load").alias("tg"))
    dev = F.abs(F.col("load") - F.col("tg"))
    return loads.join(mean, list(keys)).groupBy(*keys).agg(
        (F.max(dev) / F.max("tg")).alias("plan_maxdev"),
        F.avg((dev <= F.col("tg") * eps + 1e-9).cast("int")).alias("plan_share_in5"),
        F.avg((dev <= F.col("tg") / 7 + 1e-9).cast("int")).alias("plan_share_in14"))


def district_metrics(loads: DataFrame, delta: float = 1 / 7, low: float = 60.0, high: float = 80.0) -> DataFrame:
    """CV, in-band shares and largest deviation of district loads, by day and design."""
    mean = loads.groupBy(*DAY).agg(F.avg("load").alias("mu"))
    x, mu = F.col("load").cast("double"), F.col("mu")
    return loads.join(mean, list(DAY)).groupBy(*DAY).agg(
        (F.stddev_pop("load") / F.avg("load")).alias("cv"), F.avg(band(x, mu, delta).cast("int")).alias("inband"),
        F.avg(band(x, mu, 0.05, 0.0).cast("int")).alias("in5"), F.avg(x.between(low, high).cast("int")).alias("inband_abs"),
        (F.max(F.abs(x - mu)) / F.max(mu)).alias("maxdev"))


def inband_recompute(loads: DataFrame, k: int, delta: float = 1 / 7) -> DataFrame:
    """In-band share from stored loads without rows of empty districts: those are counted as
    k minus the rows, in band only if zero is."""
    total = loads.groupBy(*DAY).agg((F.sum("load") / F.lit(float(k))).alias("mu"))
    x, mu = F.col("load").cast("double"), F.col("mu")
    zero = band(F.lit(0.0), F.max("mu"), delta).cast("int")
    return loads.join(total, list(DAY)).groupBy(*DAY).agg(
        ((F.sum(band(x, mu, delta).cast("int")) + (F.lit(k) - _n()) * zero) / F.lit(float(k))).alias("inband"))


def parcels_by_district(d: DataFrame, a: DataFrame) -> DataFrame:
    """Parcels with the district that a design gives their unit that day. Designs that go by
    courier (OPR) are not part of ``a`` here."""
    return d.join(a.select("depot", "date", "design", "bu", "k"), ["depot", "date", "bu"])


def compactness(p: DataFrame) -> DataFrame:
    """Mean over districts of the mean distance to the coordinate-wise median."""
    mid = p.groupBy(*DAY, "k").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    own = p.join(mid, [*DAY, "k"]).groupBy(*DAY, "k").agg(F.avg(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).alias("c"))
    return own.groupBy(*DAY).agg(F.avg("c").alias("comp_m"))


def district_centroids(p: DataFrame) -> DataFrame:
    return p.groupBy(*DAY, "k").agg(_n().alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def weighted_centroid(units: DataFrame) -> DataFrame:
    """Demand-weighted centre of each district of (depot, design, k, w, x, y)."""
    return units.groupBy("depot", "design", "k").agg(
        (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("cx"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("cy"))


def continuity(a: DataFrame) -> DataFrame:
    """Of parcels whose unit was served before in the same month, the share with the same
    district as on the unit's last day; null where no unit was."""
    w = Window.partitionBy("depot", "m", "design", "bu").orderBy("date")
    seen = a.withColumn("before", F.lag("k").over(w))
    return seen.groupBy(*DAY).agg(
        (F.sum(F.when(F.col("before") == F.col("k"), F.col("n")).when(F.col("before").isNotNull(), 0))
         / F.sum(F.when(F.col("before").isNotNull(), F.col("n")))).alias("cont"))


def continuity_couriers(own: DataFrame) -> DataFrame:
    """The same for couriers: against the largest courier id of the unit's last day."""
    last = own.groupBy("depot", "m", "date", "bu").agg(F.max("k").alias("last"))
    w = Window.partitionBy("depot", "m", "bu").orderBy("date")
    before = last.withColumn("before", F.lag("last").over(w)).drop("last")
    return own.join(before, ["depot", "m", "date", "bu"]).groupBy("depot", "date").agg(
        (F.sum(F.when(F.col("before") == F.col("k"), F.col("n")).when(F.col("before").isNotNull(), 0))
         / F.sum(F.when(F.col("before").isNotNull(), F.col("n")))).alias("cont"))


def moved_share(a: DataFrame, base: str = "FIX") -> DataFrame:
    """Demand in units whose district differs from the base design's, as a share."""
    fix = a.filter(F.col("design") == base).select("depot", "date", "bu", F.col("k").alias("k0"))
    return a.join(fix, ["depot", "date", "bu"]).groupBy(*DAY).agg(
        (F.sum(F.when(F.col("k") != F.col("k0"), F.col("n")).otherwise(0)) / F.sum("n")).alias("moved_share"))


def stem_total(metrics: DataFrame, cent: DataFrame, depots: DataFrame) -> DataFrame:
    """Stem kilometres (twice the way to each district's centre) and tour plus stem."""
    stem = cent.join(depots, "depot").groupBy(*DAY).agg(
        (F.sum(F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")) * 2) / 1000).alias("stem_km"))
    return metrics.join(stem, list(DAY), "left").withColumn("total_km", F.col("tour_km") + F.col("stem_km"))


def nearest_centroid(points: DataFrame, cent: DataFrame) -> DataFrame:
    """Index of the nearest centre by squared distance, ties to the smaller index. The centres
    are a few rows per depot, joined on the depot."""
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    near = points.join(cent, "depot").groupBy(*points.columns).agg(F.min(F.struct(d2.alias("d2"), F.col("k").alias("k"))).alias("best"))
    return near.select(*points.columns, F.col("best.k").alias("k"))


def hex_neighbors(units: DataFrame) -> DataFrame:
    """Pairs of adjacent units (depot, bu, neighbor): six axial steps and an equi join."""
    steps = F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))])
    out = units.select("depot", "bu", "q", "r", F.explode(steps).alias("s"))
    out = out.select("depot", "bu", (F.col("q") + F.col("s.dq")).alias("q"), (F.col("r") + F.col("s.dr")).alias("r"))
    return out.join(units.select("depot", "q", "r", F.col("bu").alias("neighbor")), ["depot", "q", "r"]).select("depot", "bu", "neighbor")


def hex_envelope(d: DataFrame, keys: tuple, side: float = 1000.0, smin: float = 750.0, smax: float = 2000.0, exact: bool = False) -> DataFrame:
    """Service envelope of each group: snapped mean and a clamped side that covers its points."""
    from haulgrid.functions import geo

    mean = d.groupBy(*keys).agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    cx, cy = geo.hex_snap("ax", "ay", side)
    mean = mean.select(*keys, cx.alias("ex"), cy.alias("ey"))
    far = geo.hex_norm("x", "y", "ex", "ey") if exact else F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) * F.lit(2 / geo.S3)
    need = d.join(mean, list(keys)).groupBy(*keys, "ex", "ey").agg(F.max(far).alias("need"))
    return need.select(*keys, "ex", "ey", F.least(F.greatest("need", F.lit(smin)), F.lit(smax)).alias("side"))


def outside_rate(d: DataFrame, keys: tuple, total: tuple = ("depot",)) -> DataFrame:
    """Percent of parcels outside the envelope of their group."""
    from haulgrid.functions import geo

    env = hex_envelope(d, keys)
    out = ~geo.inside_hex("x", "y", "ex", "ey", "side")
    return d.join(env, list(keys)).groupBy(*total).agg((F.avg(out.cast("int")) * 100).alias("otr"))
