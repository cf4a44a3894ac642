"""Paired and cluster statistics as window and aggregate plans.

All take rows (scope, id, x): paired differences x of one comparison. Pairwise statistics
(Walsh averages, Kendall) join a comparison's days with themselves: hundreds of days, not
parcels, so the join is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _n() -> Column:
    return F.count(F.lit(1))


#: Most values of a scope (days): their pairs are ordered by one task.
MAX_DAYS = 5_000


def hodges_lehmann(x: DataFrame, z: float = Z95) -> DataFrame:
    """Median of Walsh averages and the order-statistic interval around it. A scope of more than
    MAX_DAYS days is refused."""
    sizes = x.groupBy("scope").agg(_n().alias("n"))
    refused = F.raise_error(F.lit(f"a scope has more than {MAX_DAYS} days"))
    x = x.join(sizes.select("scope", F.when(F.col("n") > MAX_DAYS, refused.cast("int")).alias("_n")), "scope").filter(F.col("_n").isNull()).drop("_n")
    day = Window.partitionBy("scope").orderBy("x", "id")
    rows = x.withColumn("i", F.row_number().over(day))
    a, b = rows.alias("a"), rows.alias("b")
    walsh = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.i") <= F.col("b.i"))).select(
        F.col("a.scope").alias("scope"), ((F.col("a.x") + F.col("b.x")) / 2).alias("w"))
    size = x.groupBy("scope").agg(_n().cast("double").alias("n"))
    k = F.floor(F.col("n") * (F.col("n") + 1) / 4 - z * F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24))
    size = size.withColumn("k", F.greatest(k, F.lit(0))).withColumn("walsh", F.col("n") * (F.col("n") + 1) / 2)
    placed = walsh.withColumn("r", F.row_number().over(Window.partitionBy("scope").orderBy("w")) - 1).join(size, "scope")
    return placed.groupBy("scope").agg(
        F.first("n").cast("bigint").alias("n"), F.median("w").alias("hl"), F.max(F.when(F.col("r") == F.col("k"), F.col("w"))).alias("ci_lo"),
        F.max(F.when(F.col("r") == F.least(F.col("walsh") - 1 - F.col("k"), F.col("walsh") - 1), F.col("w"))).alias("ci_hi"))


def wilcoxon(x: DataFrame) -> DataFrame:
    """Signed-rank sums with average ranks, zeros dropped, and the statistic W."""
    nz = x.filter("x <> 0").withColumn("a", F.abs("x"))
    rank = F.rank().over(Window.partitionBy("scope").orderBy("a")) + (F.count(F.lit(1)).over(Window.partitionBy("scope", "a")) - 1) / F.lit(2.0)
    sums = nz.withColumn("r", rank).groupBy("scope").agg(
        _n().alias("n_nonzero"), F.sum(F.when(F.col("x") > 0, F.col("r")).otherwise(0.0)).alias("r_plus"),
        F.sum(F.when(F.col("x") < 0, F.col("r")).otherwise(0.0)).alias("r_minus"))
    return sums.withColumn("W", F.least("r_plus", "r_minus"))


def rank_biserial(x: DataFrame) -> DataFrame:
    """(R+ - R-) / (R+ + R-) with ordinal ranks of |x|, ties by id."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.abs("x"), "id"))
    nz = x.filter("x <> 0").withColumn("r", rank)
    return nz.groupBy("scope").agg((F.sum(F.signum("x") * F.col("r")) / F.sum("r")).alias("r_rb"))


def bonferroni(tests: DataFrame, m: int | None = None) -> DataFrame:
    """min(p * m, 1); m is given or the number of tests."""
    count = F.lit(m) if m else F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    return tests.withColumn("p_bonf", F.least(F.col("p") * count, F.lit(1.0)))


def benjamini_hochberg(tests: DataFrame, key: str = "test") -> DataFrame:
    """q-values: the running minimum of p * m / rank from the largest p. A family of tests is a
    handful of rows, so one task orders it."""
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    ranked = tests.withColumn("i", F.row_number().over(Window.orderBy("p", key)))
    scaled = ranked.withColumn("s", F.col("p") * m / F.col("i"))
    low = F.min("s").over(Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn("q_bh", F.least(low, F.lit(1.0))).drop("i", "s")


def family_summary(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant tests, those that are not, and the smallest effect among the significant."""
    sig = F.col("p_bonf") < alpha
    return tests.agg(
        F.count_if(sig).alias("n_significant"), _n().alias("n_tests"),
        F.array_join(F.sort_array(F.collect_list(F.when(~sig, F.col("test")))), ",").alias("not_significant"),
        F.min(F.when(sig, F.abs("effect"))).alias("min_effect"))


def week_sums(d: DataFrame) -> DataFrame:
    """Sum and count of differences by comparison and ISO week, for all depots and each."""
    each = F.array(F.lit("All"), F.col("depot"))
    rows = d.withColumn("scope", F.explode(each)).withColumn("week", F.weekofyear("date"))
    return rows.groupBy("comp", "scope", "week").agg(F.sum("d").alias("sum_d"), F.count("d").alias("n_d"))


def months_same_sign(d: DataFrame) -> DataFrame:
    """How many monthly means share the sign of the overall mean, as 'a/b'."""
    month = d.groupBy("comp", F.month("date").alias("m")).agg(F.avg("d").alias("mm"))
    whole = d.groupBy("comp").agg(F.avg("d").alias("mean_diff"))
    return month.join(whole, "comp").groupBy("comp").agg(F.concat(
        F.count_if(F.signum("mm") == F.signum("mean_diff")).cast("string"), F.lit("/"), _n().cast("string")).alias("months"))


def average_ranks(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Columns <c>_rank with ties averaged within the keys."""
    for c in columns:
        w = Window.partitionBy(*keys)
        df = df.withColumn(f"{c}_rank", F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / F.lit(2.0))
    return df


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return average_ranks(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), keys, a, b).groupBy(*keys).agg(F.corr(f"{a}_rank", f"{b}_rank").alias("rho"))


def pair_agreement(both: DataFrame) -> DataFrame:
    """Sign agreement and correlation of two kinds of difference (comp, d1, d2)."""
    return both.groupBy("comp").agg(
        (F.avg((F.signum("d1") == F.signum("d2")).cast("int")) * 100).alias("sign_agree"), F.corr("d1", "d2").alias("corr"),
        F.avg("d1").alias("mean1"), F.avg("d2").alias("mean2"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b of two measures over the designs of each depot-day."""
    x, y = df.alias("x"), df.alias("y")
    pairs = x.join(y, (F.col("x.depot") == F.col("y.depot")) & (F.col("x.date") == F.col("y.date")) & (F.col("x.design") < F.col("y.design")))
    sa, sb = F.signum(F.col(f"x.{a}") - F.col(f"y.{a}")), F.signum(F.col(f"x.{b}") - F.col(f"y.{b}"))
    sums = pairs.select(F.col("x.depot").alias("depot"), F.col("x.date").alias("date"), sa.alias("sa"), sb.alias("sb")).groupBy("depot", "date").agg(
        F.sum(F.col("sa") * F.col("sb")).alias("s"), F.sum(F.abs("sa")).alias("na"), F.sum(F.abs("sb")).alias("nb"))
    return sums.select("depot", "date", F.try_divide(F.col("s"), F.sqrt(F.col("na") * F.col("nb"))).alias("tau"))


def kendall_summary(df: DataFrame, a: str, b: str) -> DataFrame:
    """Median of the days' tau-b (days without one left out), and the percentage of depot-days on
    which both measures are lowest for the same design, ties to the first design by name."""
    def lowest(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct(c, "design")))

    best = df.groupBy("depot", "date").agg(lowest(a).alias("x"), lowest(b).alias("y"))
    same = best.agg((F.avg((F.col("x.design") == F.col("y.design")).cast("int")) * 100).alias("same_best"), _n().alias("days"))
    return kendall(df, a, b).agg(F.median("tau").alias("tau_median")).crossJoin(same)


def month_means(d: DataFrame) -> DataFrame:
    """Mean difference by comparison, scope (all depots and each) and month."""
    rows = d.withColumn("scope", F.explode(F.array(F.lit("All"), F.col("depot"))))
    return rows.groupBy("comp", "scope", F.month("date").alias("month")).agg(F.avg("d").alias("mean_d"))
