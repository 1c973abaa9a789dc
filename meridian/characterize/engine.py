"""Runs analyses as DataFrames: one function per family, one result shape per kind."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.distribution import distribution, rank_distribution
from ..operators.intervals import inside_period, outside_period
from ..sources.adapter import Cdm
from .registry import ANALYSES, DOMAINS, END, MAPPED, START, Analysis

STRATA = [f"stratum_{i}" for i in range(1, 6)]


def spark_sql(text: str) -> str:
    return re.sub(r"DAYS\((\w+), (\w+)\)", r"datediff(\2, \1)", text)


def expr(text: str) -> Column:
    return F.expr(spark_sql(text))


def _first(rows: DataFrame, table: str) -> DataFrame:
    start = f"{table}_start_date"
    order = Window.partitionBy("person_id").orderBy(start, f"{table}_id")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def _inside(cdm: Cdm, table: str) -> DataFrame:
    """A table's rows inside observation, with the columns that analyses read: joined once for all of them."""
    texts = " ".join(" ".join([*a.keys, a.where, a.value, a.entity, *a.extra]) for a in ANALYSES.values() if a.table == table) + " person_id provider_id care_site_id"
    rows = cdm[table]
    return inside_period(rows, cdm["observation_period"], START[table]).select(*[c for c in rows.columns if re.search(rf"\b{c}\b", texts)])


def frame(cdm: Cdm, a: Analysis) -> DataFrame:
    """The rows that an analysis looks at."""
    rows = cdm[a.table]
    if a.extra[:1] == ("first period",):
        rows = _first(rows, a.table)
    if a.op and a.extra[:1] == ("ends inside",):
        rows = inside_period(rows, cdm["observation_period"], START[a.table], END[a.table])
    elif a.op:
        rows = cdm.derived(f"{a.table} inside observation", lambda: _inside(cdm, a.table))
    if a.person:
        rows = rows.join(cdm["person"].select("person_id", "gender_concept_id", "year_of_birth"), "person_id")
    if a.extra[:1] == ("join",):
        _, other, key = a.extra
        rows = rows.join(cdm[other].drop(*(set(cdm[other].columns) & set(rows.columns) - {key})), key)
    if a.extra[:1] == ("join on",):
        _, other, left, right = a.extra
        rows = rows.join(cdm[other].withColumnRenamed(right, left).drop("person_id"), left)
    if a.extra[:1] == ("anti",):
        rows = rows.join(cdm[a.extra[1]], "person_id", "left_anti")
    return rows.filter(spark_sql(a.where)) if a.where else rows


def results(a: Analysis, rows: DataFrame, strata: list[Column], count: Column) -> DataFrame:
    """Rows in the shape of the results table."""
    padded = [*strata, *[F.lit(None)] * (len(STRATA) - len(strata))]
    return rows.select(F.lit(a.id).alias("analysis_id"), *[s.cast("string").alias(n) for s, n in zip(padded, STRATA, strict=True)], count.cast("long").alias("count_value"))


def _grouped(a: Analysis, rows: DataFrame, keys: list[Column], count: Column) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    counted = rows.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)]).groupBy(*names).agg(count.alias("n"))
    return results(a, counted, [F.col(n) for n in names], F.col("n"))


def ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(n.cast("double") / of, 6).cast("decimal(12,6)")).cast("string")


def count(cdm: Cdm, a: Analysis) -> DataFrame:
    return _grouped(a, frame(cdm, a), [expr(k) for k in a.keys], F.count("*"))


def count_distinct(cdm: Cdm, a: Analysis) -> DataFrame:
    return _grouped(a, frame(cdm, a), [expr(k) for k in a.keys], F.countDistinct(a.entity))


def orphan(cdm: Cdm, a: Analysis) -> DataFrame:
    parent, key = a.extra
    known = ("person_id",) if "person_id" in cdm[a.table].columns else ()  # what is counted are person ids
    lost = cdm[a.table].dropna(subset=[key, *known]).join(cdm[parent].select(key), key, "left_anti")
    return results(a, lost.agg(F.count("*").alias("n")), [], F.col("n"))


def outside(cdm: Cdm, a: Analysis) -> DataFrame:
    rows = outside_period(cdm[a.table], cdm["observation_period"], START[a.table])
    return results(a, rows.agg(F.count("*").alias("n")), [], F.col("n"))


def proportion(cdm: Cdm, a: Analysis) -> DataFrame:
    rows = cdm[a.table]
    lost = outside_period(rows, cdm["observation_period"], START[a.table])
    size = F.countDistinct("person_id") if a.extra == ("persons",) else F.count("*")
    both = lost.agg(size.alias("n")).crossJoin(rows.agg(size.alias("d")))  # one row each
    return results(a, both, [ratio(F.col("n"), F.col("d")), F.col("n"), F.col("d")], F.signum("n"))


def at_least(cdm: Cdm, a: Analysis) -> DataFrame:
    (concept,) = a.keys
    per_person = frame(cdm, a).groupBy(concept, "person_id").agg(F.count("*").alias("x"))
    by_count = per_person.groupBy(concept, "x").agg(F.count("*").alias("n"))
    more = F.sum("n").over(Window.partitionBy(concept).orderBy(F.desc("x")))
    return results(a, by_count.withColumn("m", more), [F.col(concept), F.col("x")], F.col("m"))


def top_pairs(cdm: Cdm, a: Analysis, k: int = 10) -> DataFrame:
    """For every concept the k others that most of its persons have too, then by cases and id. A person's records are counted per concept before they are paired."""
    (concept,) = a.keys
    own = cdm[a.table].filter(F.col(concept) != 0).groupBy("person_id", F.col(concept).alias("c")).agg(F.count("*").alias("n"))
    left, right = own.withColumnsRenamed({"c": "c1", "n": "n1"}), own.withColumnsRenamed({"c": "c2", "n": "n2"})
    pairs = left.join(right, "person_id").filter("c1 <> c2").groupBy("c1", "c2").agg(F.count("*").alias("persons"), F.sum(F.col("n1") * F.col("n2")).alias("cases"))
    rank = F.row_number().over(Window.partitionBy("c1").orderBy(F.desc("persons"), F.desc("cases"), "c2"))
    best = pairs.withColumn("place", rank).filter(F.col("place") <= k)
    return results(a, best, [F.col(c) for c in ("c1", "c2", "place", "persons", "cases")], F.col("persons"))


def source(cdm: Cdm, a: Analysis, name: str = "meridian", version: str = "1") -> DataFrame:
    """The database: its name, the version of the analyses, the day of the run, all persons."""
    return results(a, cdm[a.table].agg(F.countDistinct("person_id").alias("n")), [F.lit(name), F.lit(version), F.current_date()], F.col("n"))


def source_distribution(cdm: Cdm, name: str = "meridian") -> DataFrame:
    """The database among the distributions: all persons, without statistics."""
    none = [F.lit(None).cast("double").alias(f"{n}_value") for n in ("min", "max", "avg", "stdev", "median", "p10", "p25", "p75", "p90")]
    return cdm["person"].agg(F.countDistinct("person_id").alias("count_value")).select(F.lit(0).alias("analysis_id"), F.lit(name).alias("stratum_1"), F.lit(None).cast("string").alias("stratum_2"), "count_value", *none)


def every_record(cdm: Cdm, a: Analysis) -> DataFrame:
    """Records, once for each period that holds them, and those outside all periods."""
    rows = cdm[a.table]
    both = rows.join(cdm["observation_period"].withColumnRenamed("person_id", "__p"), (F.col("person_id") == F.col("__p")) & F.col(START[a.table]).between(F.col("observation_period_start_date"), F.col("observation_period_end_date")), "left")
    return results(a, both.agg(F.count("*").alias("n")), [], F.col("n"))


def periods(cdm: Cdm, a: Analysis) -> DataFrame:
    each = cdm[a.table].groupBy("person_id").agg(F.count("*").alias("k"))
    return _grouped(a, each, [F.col("k")], F.count("*"))


def calendar(cdm: Cdm, a: Analysis) -> DataFrame:
    """Persons by calendar year or month that a period covers whole, or touches: every period lists its own units instead of meeting a calendar.

    ``started``: only units in which some period starts, and known persons.
    """
    unit, mode, *more = a.extra
    start, end = F.col(f"{a.table}_start_date"), F.col(f"{a.table}_end_date")
    rows = cdm[a.table].filter(start <= end)
    first, last = F.trunc(start, unit), F.trunc(end, unit)
    step = F.expr(f"interval 1 {unit}")
    listed = rows.select("person_id", start.alias("s"), end.alias("e"), F.explode(F.sequence(first, last, step)).alias("u"))
    if mode == "covered":
        listed = listed.filter((F.col("s") <= F.col("u")) & (F.col("e") >= F.date_add((F.col("u") + step).cast("date"), -1)))
    if "started" in more:
        starts = cdm[a.table].select(F.trunc(start, unit).alias("u")).distinct()  # as many as there are years or months
        listed = listed.join(F.broadcast(starts), "u", "left_semi").join(cdm["person"].select("person_id"), "person_id", "left_semi")
    key = F.year("u") if unit == "year" else F.year("u") * 100 + F.month("u")
    keys = [key]
    if "by person" in more:
        listed = listed.join(cdm["person"].select("person_id", "gender_concept_id", "year_of_birth"), "person_id")
        keys += [F.col("gender_concept_id"), F.floor((key - F.col("year_of_birth")) / 10)]
    return _grouped(a, listed, keys, F.countDistinct("person_id"))


def union_count(cdm: Cdm, a: Analysis) -> DataFrame:
    """Records of every domain by the visit's concept (0 where none is known)."""
    key, concept = a.extra
    visits = cdm[a.table].select(F.col(key).alias("v"), F.col(concept).alias("c"))
    parts = []
    for t in ("drug_exposure", "condition_occurrence", "device_exposure", "procedure_occurrence", "measurement", "observation"):
        own = cdm[t].select(F.col("visit_occurrence_id").alias("v"))
        parts.append(own.join(visits, "v", "left").select(F.coalesce("c", F.lit(0)).alias("c"), F.lit(t).alias("t")))
    parts.append(cdm[a.table].select(F.coalesce(concept, F.lit(0)).alias("c"), F.lit(a.table).alias("t")))
    return _grouped(a, reduce(DataFrame.unionByName, parts), [F.col("c"), F.col("t")], F.count("*"))


def no_value(cdm: Cdm, a: Analysis) -> DataFrame:
    valued = F.coalesce(expr(a.extra[0]), F.lit(False))
    each = frame(cdm, a).groupBy(*a.keys).agg(F.count(F.when(~valued, 1)).alias("n"), F.count("*").alias("d"))
    return results(a, each, [F.col(a.keys[0]), F.col("n"), ratio(F.col("n"), F.col("d"))], F.col("d"))


def unmapped(cdm: Cdm, a: Analysis) -> DataFrame:
    """Source values of what was mapped to concept 0, by table and column; of the columns that a table has."""
    parts = []
    for table, value, concept in MAPPED:
        rows = cdm[table]
        if concept in rows.columns:
            found = F.col(value) if value in rows.columns else F.lit(None)
            parts.append(rows.filter(F.col(concept) == 0).select(F.lit(table).alias("t"), F.lit(value).alias("f"), found.cast("string").alias("v")))
    return _grouped(a, reduce(DataFrame.unionByName, parts), [F.col("t"), F.col("f"), F.col("v")], F.count("*"))


def domains(cdm: Cdm, a: Analysis) -> DataFrame:
    found = None
    for name in a.extra:
        d = DOMAINS[name]
        own = inside_period(cdm[d.table], cdm["observation_period"], d.start).select("person_id")
        found = own.distinct() if found is None else found.join(own, "person_id", "left_semi")
    return results(a, found.agg(F.count("*").alias("n")), [], F.col("n"))


OVERLAPPING = ("condition_occurrence", "drug_exposure", "device_exposure", "measurement", "death", "procedure_occurrence", "observation")


def overlap(cdm: Cdm, a: Analysis) -> DataFrame:
    """Persons that have at least the domains of each of 127 combinations: one mask per person, each mask lists what it contains."""
    flags = reduce(DataFrame.unionByName, [cdm[t].select("person_id", F.lit(1 << (6 - i)).alias("bit")) for i, t in enumerate(OVERLAPPING)])
    masks = flags.groupBy("person_id").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))  # at most 127 rows
    held = masks.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(127)))).filter(F.col("mask").bitwiseAND(F.col("b")) == F.col("b")).groupBy("b").agg(F.sum("n").alias("n"))
    every = cdm["person"].agg(F.countDistinct("person_id").alias("d")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(127))))
    each = every.join(held, "b", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return results(a, each, [F.lpad(F.bin("b"), 7, "0"), ratio(F.col("n"), F.col("d"))], F.col("n"))


def _values(cdm: Cdm, a: Analysis) -> tuple[DataFrame, list[str]]:
    kind = a.extra[0] if a.extra else ""
    if kind == "distinct per person":
        return frame(cdm, a).groupBy("person_id").agg(F.countDistinct(a.value).alias("value")), []
    if kind == "age at first":
        concept = a.keys[0]
        first = frame(cdm, a).groupBy("person_id", concept).agg(F.min(F.year(a.value)).alias("y")).join(cdm["person"], "person_id")
        return first.select(F.col(concept).alias("k0"), F.col("gender_concept_id").alias("k1"), (F.col("y") - F.col("year_of_birth")).alias("value")), ["k0", "k1"]
    if kind == "age at earliest":
        first = frame(cdm, a).groupBy("person_id").agg(F.min(F.year(a.value)).alias("y")).join(cdm["person"], "person_id")
        return first.select(F.col(a.keys[0]).alias("k0"), (F.col("y") - F.col("year_of_birth")).alias("value")), ["k0"]
    if a.value == "last":
        last = inside_period(cdm[a.extra[0]], cdm["observation_period"], a.extra[1]).groupBy("person_id").agg(F.max(a.extra[1]).alias("last"))
        return frame(cdm, a).join(last, "person_id").select(F.datediff("last", "death_date").alias("value")), []
    names = [f"k{i}" for i in range(len(a.keys))]
    return frame(cdm, a).select(*[expr(k).alias(n) for k, n in zip(a.keys, names, strict=True)], expr(a.value).alias("value")), names


def _placed(made: DataFrame, names: list[str], number: Column) -> DataFrame:
    strata = [F.col(n).cast("string") for n in names] + [F.lit(None).cast("string")] * (2 - len(names))
    return made.select(number.cast("int").alias("analysis_id"), strata[0].alias("stratum_1"), strata[1].alias("stratum_2"), *[c for c in made.columns if c.endswith("_value")])


def dist(cdm: Cdm, a: Analysis) -> DataFrame:
    rows, names = _values(cdm, a)
    if a.valued:
        rows = rows.filter("value IS NOT NULL")
    made = (rank_distribution if a.family == "DIST9999" else distribution)(rows, "value", names)
    return _placed(made, names, F.lit(a.id))


_OWN_VALUES = ("distinct per person", "age at first", "age at earliest")


def _alike(a: Analysis):
    """What distributions of one frame share; None for those that prepare their values."""
    if a.family != "DIST" or a.extra[:1] in [(x,) for x in _OWN_VALUES] or a.value == "last":
        return None
    return a.table, a.keys, a.where, a.op, a.person, a.extra, a.valued


def dists_together(cdm: Cdm, group: list[Analysis]) -> DataFrame:
    """Distributions of several values of the same rows: read, joined, counted and ranked once."""
    a = group[0]
    names = [f"k{i}" for i in range(len(a.keys))]
    values = F.array(*[F.struct(F.lit(x.id).alias("id"), expr(x.value).cast("double").alias("v")) for x in group])
    rows = frame(cdm, a).select(*[expr(k).alias(n) for k, n in zip(a.keys, names, strict=True)], F.explode(values).alias("x")).select(*names, F.col("x.id").alias("__id"), F.col("x.v").alias("value"))
    if a.valued:
        rows = rows.filter("value IS NOT NULL")
    return _placed(distribution(rows, "value", ["__id", *names]), names, F.col("__id"))


FAMILIES = {
    "SOURCE": source, "ALL": every_record, "COUNT": count, "COUNTD": count_distinct, "ORPHAN": orphan, "OUTSIDE": outside, "PROP": proportion, "ATLEAST": at_least, "TOPK": top_pairs, "PERIODS": periods, "CALENDAR": calendar,
    "UNIONCOUNT": union_count, "NOVALUE": no_value, "UNMAPPED": unmapped, "DOMAINS": domains, "OVERLAP": overlap, "DIST": dist, "DIST9999": dist,
}


def run(cdm: Cdm, ids: list[int], small_cell: int | None = None) -> DataFrame:
    """Analyses of one shape (counts or distributions) as one tall table; cells of at most ``small_cell`` go."""
    groups: dict = {}
    for i in ids:
        groups.setdefault(_alike(ANALYSES[i]) or i, []).append(ANALYSES[i])
    made = reduce(DataFrame.unionByName, [dists_together(cdm, g) if len(g) > 1 else FAMILIES[g[0].family](cdm, g[0]) for g in groups.values()])
    return made if small_cell is None else made.filter(F.col("count_value") > small_cell)
