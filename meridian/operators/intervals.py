"""Interval operators on dates: observation periods, eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside_period(rows: DataFrame, periods: DataFrame, start: str, end: str | None = None, keep: bool = False) -> DataFrame:
    """Rows whose start lies inside an observation period of their person; once for each such period.

    Where an end is named, it (the start, if it is missing) bounds the row instead at the period's end.

    ``keep`` adds the period as op_start_date and op_end_date.
    """
    p = periods.select(F.col("person_id").alias("__p"), F.col("observation_period_start_date").alias("op_start_date"), F.col("observation_period_end_date").alias("op_end_date"))
    last = F.coalesce(end, start) if end else F.col(start)
    on = (F.col("person_id") == F.col("__p")) & (F.col(start) >= F.col("op_start_date")) & (last <= F.col("op_end_date"))
    found = rows.join(p, on).drop("__p")
    return found if keep else found.drop("op_start_date", "op_end_date")


def outside_period(rows: DataFrame, periods: DataFrame, start: str) -> DataFrame:
    """Rows whose start lies in no observation period of their person."""
    p = periods.select(F.col("person_id").alias("__p"), "observation_period_start_date", "observation_period_end_date")
    on = (F.col("person_id") == F.col("__p")) & (F.col(start) >= F.col("observation_period_start_date")) & (F.col(start) <= F.col("observation_period_end_date"))
    return rows.join(p, on, "left_anti")


def merge_eras(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, agg: dict[str, Column] | None = None, pad: bool = True) -> DataFrame:
    """Joins intervals of one key that overlap or are at most ``gap`` days apart: one sort per key, no self join.

    ``pad=False`` ignores the gap (intervals merge only where they meet).
    """
    reach = gap if pad else 0
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__reach", F.max(F.date_add(F.col(end), reach)).over(before))
    numbered = marked.withColumn("__era", F.sum(F.when(F.col("__reach") >= F.col(start), 0).otherwise(1)).over(upto))
    more = [c.alias(n) for n, c in (agg or {}).items()]
    return numbered.groupBy(*keys, "__era").agg(F.min(start).alias(start), F.max(end).alias(end), *more).drop("__era")
