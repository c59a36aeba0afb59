"""Statistics over daily series: trend lines, lagged correlation, influence. A series is (key columns, position, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.session import staged


def daily_score(pos: Column, neg: Column, neu: Column) -> Column:
    """(positive - negative) / all, 0 without any."""
    return F.coalesce(F.try_divide(pos - neg, pos + neg + neu), F.lit(0.0))


def trend(series: DataFrame, keys: list[str], x: str, y: str, least: int = 14, ahead: int = 7) -> DataFrame:
    """OLS line of each series: (keys, n, slope, intercept, r2, residual_std, direction, forecast ARRAY<STRUCT<step, value, low, high>>); shorter series are left out.

    residual_std is that of the population; the band is 1.96 of it. A constant series has slope 0 and r2 1.
    """
    s = series.where(F.col(y).isNotNull())
    a = s.groupBy(*keys).agg(F.count("*").alias("n"), F.max(x).alias("_last"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(x, y).alias("_cov"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    a = a.where(F.col("n") >= least).withColumn("slope", F.coalesce(F.try_divide(F.col("_cov"), F.col("_vx")), F.lit(0.0)))
    a = a.withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    a = a.withColumn("residual_std", F.sqrt(F.greatest(F.lit(0.0), F.col("_vy") - F.col("slope") * F.col("_cov"))))
    a = a.withColumn("r2", F.when(F.col("_vy") == 0, 1.0).otherwise(F.col("slope") * F.col("_cov") / F.col("_vy")))
    a = a.withColumn("direction", F.when(F.col("slope") * 7 > 0.1, "up").when(F.col("slope") * 7 < -0.1, "down").otherwise("stable"))
    value = lambda k: F.col("intercept") + F.col("slope") * (F.col("_last") + k)
    band = F.col("residual_std") * 1.96
    a = a.withColumn("forecast", F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda k: F.struct(k.alias("step"), value(k).alias("value"), (value(k) - band).alias("low"), (value(k) + band).alias("high"))))
    return a.drop("_last", "_mx", "_my", "_cov", "_vx", "_vy")


def positions(df: DataFrame, keys: list[str], order: str, into: str = "pos") -> DataFrame:
    """The number of each row in its series, from 0."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def lagged_correlation(series: DataFrame, key: str, pos: str, value: str, max_lag: int = 3) -> DataFrame:
    """(a, b, lag, r, n) for each pair a < b of series and each lag 0 .. max_lag: Pearson of a with b shifted back by lag positions.

    Series are joined on position, so what is joined is days times pairs of series; pairs with a constant side have no r and no row.
    """
    s = series.select(F.col(key).alias("k"), F.col(pos).alias("p"), F.col(value).alias("v"))
    lags = s.select(F.col("k").alias("a"), "p", F.col("v").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")).withColumn("q", F.col("p") + F.col("lag"))
    j = lags.join(s.select(F.col("k").alias("b"), F.col("p").alias("q"), F.col("v").alias("y")), "q").where(F.col("a") < F.col("b"))
    g = j.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.withColumn("r", F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).where(F.col("r").isNotNull() & (F.col("n") > 1)).select("a", "b", "lag", "r", "n")


def strongest_lag(correlations: DataFrame) -> DataFrame:
    """For each pair the lag of the greatest |r|, of several the least."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag"))).alias("m")
    return correlations.groupBy("a", "b").agg(best).select("a", "b", "m.lag", "m.r")


def edges(strongest: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, lag, r, relation): pairs that move together."""
    return strongest.where(F.abs("r") > least).withColumn("relation", F.when(F.col("lag") > 0, "leads").otherwise("follows"))


def influence(edge: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, influence): the sum of |r| times its mean over the edges that leave a node; 0 without any."""
    g = edge.groupBy(F.col("a").alias(key)).agg((F.sum(F.abs("r")) * F.avg(F.abs("r"))).alias("influence"))
    return nodes.select(key).distinct().join(g, key, "left").fillna(0.0, ["influence"])


def margin_of_error(n: Column) -> Column:
    return F.try_divide(F.lit(1.96 * 0.5), F.sqrt(n.cast("double")))


def power_band(n: Column) -> Column:
    return F.when(n > 1000, 0.95).when(n > 100, 0.80).otherwise(0.50)


def upper_median(values: Column) -> Column:
    """The element in the middle of the sorted array, the upper of the two where their number is even; NULL for none."""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def upper_median_of(df: DataFrame, column: str, buckets: int = 1_000, most: int = 10_000) -> float | None:
    """The value in the middle of a numeric column, the upper of the two where their number is even; NULLs left out, None for none.

    Equal values are counted first. Then the interval that holds the middle is cut into `buckets` again and again until few
    different values are left in it, so that what reaches the driver is bounded whatever the rows, and nothing is sorted.
    """
    h = staged(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("k")), "values")
    lo, hi, rows = h.agg(F.min("v"), F.max("v"), F.sum("k")).first()
    if rows is None:
        return None
    left = rows // 2  # rows that come before the one wanted, within lo .. hi
    while True:
        inside = h.where((F.col("v") >= lo) & (F.col("v") <= hi))
        if lo == hi or inside.count() <= most:
            break
        width = hi / buckets - lo / buckets
        place = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).alias("b")
        for b in inside.groupBy(place).agg(F.sum("k").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect():
            if left < b.k:
                lo, hi = b.lo, b.hi
                break
            left -= b.k
    for r in inside.orderBy("v").collect():
        if left < r.k:
            return r.v
        left -= r.k
    return None
