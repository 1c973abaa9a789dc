"""Runs analyses one by one into a store, merges them into the two result tables, and derives concept counts and the dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapter import Cdm
from . import engine
from .registry import ANALYSES, DOMAINS

#: Analyses whose largest count of a concept (first stratum) is its record count, those whose sum over the first stratum is (second stratum), and those that count persons.
MAX_OF_FIRST = (2, 4, 5, 201, 225, 301, 325, 401, 425, 501, 505, 525, 601, 625, 701, 725, 801, 825, 826, 827, 901, 1001, 1201, 1425, 1801, 1825, 1826, 1827, 2101, 2125, 2301)
SUM_OF_SECOND = (405, 605, 705, 805, 807, 1805, 1807, 2105)
PERSONS_OF_FIRST = (200, 400, 600, 700, 800, 900, 1000, 1800, 2100)

SMALL_CELL = 5  # cells with no more persons or records are not shown


class Outcome(NamedTuple):
    results: DataFrame
    distributions: DataFrame
    done: list[int]
    failed: list[tuple[int, str]]


def is_distribution(number: int) -> bool:
    return ANALYSES[number].family.startswith("DIST")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run(cdm: Cdm, store: str, ids: Iterable[int] | None = None, small_cell: int | None = SMALL_CELL, resume: bool = False, skip: Iterable[int] = (), log: Callable[[str], None] = lambda line: None) -> Outcome:
    """Runs analyses into ``store`` (a folder that all executors share) and merges what ran.

    One that fails is noted with its error and the others go on; an unknown number fails. ``resume``
    takes analyses that an earlier run has finished as they lie there; ``skip`` leaves some out. In the
    merged tables cells of at most ``small_cell`` are left out (None keeps all).
    """
    spark = cdm.spark
    done: list[int] = []
    failed: list[tuple[int, str]] = []
    for number in sorted(ANALYSES) if ids is None else ids:
        path = f"{store}/analysis={number}"
        if number in skip:
            log(f"{number} skipped")
        elif resume and _exists(spark, f"{path}/_SUCCESS"):
            done.append(number)
        else:
            try:
                if number not in ANALYSES:
                    raise ValueError(f"no analysis {number}")
                engine.run(cdm, [number]).write.mode("overwrite").parquet(path)
                done.append(number)
                log(f"{number} done")
            except Exception as error:  # the run goes on, the caller learns what failed
                failed.append((number, f"{type(error).__name__}: {(str(error).splitlines() or [''])[0][:200]}"))
                log(f"{number} failed: {failed[-1][1]}")
    return Outcome(merged(spark, store, [n for n in done if not is_distribution(n)], small_cell, False), merged(spark, store, [n for n in done if is_distribution(n)], small_cell, True), done, failed)


_COUNTS = "analysis_id int, " + ", ".join(f"stratum_{i} string" for i in range(1, 6)) + ", count_value long"
_DISTS = "analysis_id int, stratum_1 string, stratum_2 string, count_value long, " + ", ".join(f"{n}_value double" for n in ("min", "max", "avg", "stdev", "median", "p10", "p25", "p75", "p90"))


def merged(spark: SparkSession, store: str, numbers: list[int], small_cell: int | None, distributions: bool) -> DataFrame:
    """The stored results of some analyses as one table, without small cells; empty where there are none."""
    schema = _DISTS if distributions else _COUNTS
    if not numbers:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{store}/analysis={n}" for n in numbers])
    return rows if small_cell is None else rows.filter(F.col("count_value") > small_cell)


def concept_counts(results: DataFrame, cdm: Cdm) -> DataFrame:
    """Record and person counts of every concept and ancestor, its own and with its descendants.

    Only pairs whose descendant was counted are joined. A concept that both kinds of record counts
    have, with different values, counts its descendants once for either (as the published counts do).
    """
    first = results.filter(F.col("analysis_id").isin(*MAX_OF_FIRST)).groupBy(F.col("stratum_1").alias("c")).agg(F.max("count_value").alias("n"))
    second = results.filter(F.col("analysis_id").isin(*SUM_OF_SECOND)).groupBy(F.col("stratum_2").alias("c")).agg(F.sum("count_value").alias("n"))
    records = first.unionByName(second).distinct()
    persons = results.filter(F.col("analysis_id").isin(*PERSONS_OF_FIRST)).groupBy(F.col("stratum_1").alias("c")).agg(F.max("count_value").alias("n"))
    counted = records.select("c").union(persons.select("c")).distinct()
    above = cdm["concept_ancestor"].select(F.col("ancestor_concept_id").cast("string").alias("a"), F.col("descendant_concept_id").cast("string").alias("c"))
    pairs = above.join(counted, "c", "left_semi").select("a", "c").union(counted.select(F.col("c").alias("a"), "c")).distinct()
    own = records.groupBy("c").agg(F.max("n").alias("r"), F.count("*").alias("kinds"))
    below = pairs.join(records, "c").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("d"))
    people = persons.select("c", F.col("n").alias("p"))
    people_below = pairs.join(persons, "c").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("dp"))
    every = cdm["concept_ancestor"].select(F.col("ancestor_concept_id").alias("c")).union(cdm["concept"].select("concept_id")).select(F.col("c").cast("string").alias("c")).distinct()
    joined = every.join(own, "c", "left").join(below, "c", "left").join(people, "c", "left").join(people_below, "c", "left")
    none = F.lit(0).cast("long")
    return joined.select(
        F.col("c").cast("long").alias("concept_id"), F.coalesce("r", none).alias("record_count"), (F.coalesce("d", none) * F.coalesce("kinds", F.lit(1))).alias("descendant_record_count"),
        F.coalesce("p", none).alias("person_count"), F.coalesce("dp", none).alias("descendant_person_count"),
    )


def dictionary(spark: SparkSession) -> DataFrame:
    """One row per analysis: its number, what it counts and of which table, its strata by name, and whether it is a distribution."""
    area = {d.table: name for name, d in DOMAINS.items()}
    rows = []
    for a in sorted(ANALYSES.values()):
        what = "distribution of " + (a.value or "last event to death") if is_distribution(a.id) else {"COUNT": "records", "COUNTD": f"distinct {a.entity}"}.get(a.family, a.family.lower())
        keys = [*a.keys, *[None] * 5][:5]
        rows.append((a.id, f"{what} of {a.table}" + (f" by {', '.join(a.keys)}" if a.keys else ""), *keys, int(is_distribution(a.id)), area.get(a.table, a.table)))
    return spark.createDataFrame(rows, "analysis_id int, analysis_name string, stratum_1_name string, stratum_2_name string, stratum_3_name string, stratum_4_name string, stratum_5_name string, distribution int, category string")


def counted_analyses() -> list[int]:
    """The analyses that concept counts read, of those there are."""
    return [i for i in (*MAX_OF_FIRST, *SUM_OF_SECOND, *PERSONS_OF_FIRST) if i in ANALYSES]

