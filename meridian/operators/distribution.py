"""Distribution summaries that stay sort-based: values are counted first, then ranked by running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = {"median_value": 50, "p10_value": 10, "p25_value": 25, "p75_value": 75, "p90_value": 90}


def _stats() -> list[Column]:
    v = F.col("__v")
    # a sum of decimals doesn't depend on the order of its rows, so neither does a mean at the edge of rounding
    mean = F.round(F.sum(v.cast("decimal(28,10)")).cast("double") / F.count(v), 4)
    return [F.count("*").alias("count_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), mean.alias("avg_value"), F.round(F.stddev_samp(v), 4).alias("stdev_value")]


def distribution(rows: DataFrame, value: str, strata: list[str]) -> DataFrame:
    """Count, least, largest, mean, sample deviation and percentiles per stratum.

    A percentile is the smallest value whose cumulative share of all rows (missing values included,
    ranked last) reaches it; the largest value where none does. Rows with a missing stratum are left out.
    """
    known = rows.select(*strata, F.col(value).cast("double").alias("__v"))
    for s in strata:
        known = known.filter(F.col(s).isNotNull())
    keys = strata or [F.lit(0).alias("__all")]
    # running totals over distinct values, by stratum
    counted = known.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    names = strata or ["__all"]
    upto = F.sum("__n").over(Window.partitionBy(*names).orderBy(F.asc_nulls_last("__v")))
    total = F.sum("__n").over(Window.partitionBy(*names))
    top = F.max("__v").over(Window.partitionBy(*names))
    ranked = counted.withColumns({"__upto": upto, "__total": total, "__top": top})
    points = ranked.groupBy(*names).agg(*[F.min(F.when(F.col("__upto") * 100 >= p * F.col("__total"), F.col("__v")).otherwise(F.col("__top"))).alias(n) for n, p in POINTS.items()])
    stats = known.groupBy(*keys).agg(*_stats())
    return stats.join(points, names).select(*strata, "count_value", "min_value", "max_value", "avg_value", "stdev_value", *POINTS)


def rank_distribution(rows: DataFrame, value: str, strata: list[str]) -> DataFrame:
    """As :func:`distribution`, with percentiles by rank / (n + 1): the largest value at or below the point, -9999 where there is none.

    Ranks come from counted values: a value's first rank is one more than how many rows are below it.
    """
    known = rows.select(*strata, F.col(value).cast("double").alias("__v"))
    keys = strata or [F.lit(0).alias("__all")]
    names = strata or ["__all"]
    counted = known.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    first = F.sum("__n").over(Window.partitionBy(*names).orderBy("__v")) - F.col("__n") + 1
    total = F.sum("__n").over(Window.partitionBy(*names))
    ranked = counted.withColumns({"__r": first, "__t": total + 1})
    points = ranked.groupBy(*names).agg(*[F.max(F.when(F.col("__r") * 100 <= p * F.col("__t"), F.col("__v")).otherwise(-9999.0)).alias(n) for n, p in POINTS.items()])
    stats = known.groupBy(*keys).agg(*_stats())
    return stats.join(points, names).select(*strata, "count_value", "min_value", "max_value", "avg_value", "stdev_value", *POINTS)
