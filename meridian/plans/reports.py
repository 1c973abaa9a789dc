"""Report queries over the tall results of the analyses: five patterns, each one function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _of(results: DataFrame, analysis_id: int) -> DataFrame:
    return results.filter(F.col("analysis_id") == analysis_id)


def _number(column: str) -> Column:
    return F.expr(f"try_cast({column} AS bigint)")


def _persons(results: DataFrame) -> DataFrame:
    """One row: all persons."""
    return _of(results, 1).select(F.col("count_value").alias("persons"))


def share_of_persons(results: DataFrame, analysis_id: int) -> DataFrame:
    """Counts by stratum with their share of all persons."""
    rows = _of(results, analysis_id).select(_number("stratum_1").alias("stratum"), "count_value")
    return rows.crossJoin(F.broadcast(_persons(results))).select("stratum", "count_value", F.round(F.col("count_value").cast("double") / F.col("persons"), 5).alias("share"))


def cumulative_share(results: DataFrame, analysis_id: int) -> DataFrame:
    """Share of persons with at least so many days (strata are stretches of 30): a running total from the top, no self join."""
    rows = share_of_persons(results, analysis_id)
    above = F.sum("count_value").over(Window.orderBy(F.desc("stratum")))  # strata of one analysis: a short list
    return rows.crossJoin(F.broadcast(_persons(results))).select((F.col("stratum") * 30).alias("days"), F.round(above.cast("double") / F.col("persons"), 5).alias("share"))


def concept_counts(results: DataFrame, concept: DataFrame, analysis_id: int, concept_id: int | None = None) -> DataFrame:
    """Counts with the names of their concepts (of the second stratum, for one concept or all)."""
    rows = _of(results, analysis_id)
    if concept_id is not None:
        rows = rows.filter(F.col("stratum_1") == str(concept_id))
    label = concept.select(F.col("concept_id").cast("string").alias("stratum_1"), "concept_name")
    return rows.join(label, "stratum_1").select(_number("stratum_1").alias("concept_id"), "concept_name", "stratum_2", "count_value")


def distribution_lookup(dist: DataFrame, concept: DataFrame, analysis_id: int, concept_id: int | None = None) -> DataFrame:
    """Seven statistics per stratum with concept names of the last stratum."""
    rows = dist.filter(F.col("analysis_id") == analysis_id)
    if concept_id is not None:
        rows = rows.filter(F.col("stratum_1") == str(concept_id))
    label = concept.select(F.col("concept_id").cast("string").alias("__c"), F.col("concept_name").alias("category"))
    rows = rows.join(label, F.coalesce("stratum_2", "stratum_1") == F.col("__c"), "left")
    return rows.select("stratum_1", "stratum_2", "category", *[c for c in dist.columns if c.endswith("_value") and c not in ("count_value", "avg_value", "stdev_value")])


def prevalence_by_month(results: DataFrame, analysis_id: int, concept_id: int | None = None) -> DataFrame:
    """Persons per thousand observed in each month."""
    rows = _of(results, analysis_id)
    if concept_id is not None:
        rows = rows.filter(F.col("stratum_1") == str(concept_id))
    seen = _of(results, 117).select(F.col("stratum_1").alias("month"), F.col("count_value").alias("observed"))
    return rows.join(seen, F.col("stratum_2") == F.col("month")).select(_number("stratum_1").alias("concept_id"), _number("month").alias("month"), F.round(1000.0 * F.col("count_value").cast("double") / F.col("observed"), 5).alias("prevalence_1000pp"))


def prevalence_by_gender_age_year(results: DataFrame, concept: DataFrame, analysis_id: int, concept_id: int | None = None) -> DataFrame:
    """Persons per thousand of the same gender, age decile and year under observation."""
    rows = _of(results, analysis_id)
    if concept_id is not None:
        rows = rows.filter(F.col("stratum_1") == str(concept_id))
    rows = rows.filter(F.col("stratum_3").isin("8507", "8532"))
    seen = _of(results, 116).select(F.col("stratum_1").alias("y"), F.col("stratum_2").alias("g"), F.col("stratum_3").alias("d"), F.col("count_value").alias("observed"))
    names = concept.select(F.col("concept_id").cast("string").alias("g"), F.col("concept_name").alias("gender"))
    joined = rows.join(seen, (F.col("stratum_2") == F.col("y")) & (F.col("stratum_3") == F.col("g")) & (F.col("stratum_4") == F.col("d"))).join(names, "g")
    low = _number("d") * 10
    return joined.select(_number("stratum_1").alias("concept_id"), F.concat_ws("-", low.cast("string"), (low + 9).cast("string")).alias("age_decile"), "gender", _number("y").alias("year"), F.round(1000.0 * F.col("count_value").cast("double") / F.col("observed"), 5).alias("prevalence_1000pp"))


def frequency(results: DataFrame, concept: DataFrame, analysis_id: int, concept_id: int | None = None) -> DataFrame:
    """Share of all persons with at least x records of a concept."""
    rows = concept_counts(results, concept, analysis_id, concept_id).crossJoin(F.broadcast(_persons(results)))
    return rows.select("concept_id", "concept_name", _number("stratum_2").alias("x"), F.round(100.0 * F.col("count_value").cast("double") / F.col("persons"), 4).alias("percent"))


#: The hierarchy of a domain's treemap, and the names that its path shows from the top (a condition's second level stands there twice).
PATHS = {
    "Condition": (4, 3, 2, 2, 0),
    "Drug": (4, 3, 2, 1, 0),
    "Drug Era": (3, 2, 1, 0),
    "Measurement": (3, 2, 1, 0),
    "Observation": (3, 2, 1, 0),
    "Procedure": (3, 2, 1, 0),
}
#: By domain: hierarchy (none: plain concept names), analyses of persons and of records or (eras) of lengths, whether shares are rounded.
TREEMAPS = {
    "condition": ("Condition", 400, 401, True),
    "conditionera": ("Condition", 1000, 1007, True),
    "drug": ("Drug", 700, 701, True),
    "drugera": ("Drug Era", 900, 907, False),
    "measurement": ("Measurement", 1800, 1801, False),
    "observation": ("Observation", 800, 801, False),
    "procedure": ("Procedure", 600, 601, False),
    "visit": (None, 200, 201, False),
}


def treemap(results: DataFrame, dist: DataFrame | None, levels: DataFrame, domain: str) -> DataFrame:
    """Concepts with their path through the hierarchy, persons, their share, and records per person or the mean length of an era.

    ``levels``: the concept hierarchy, or (visits) the concepts. Concepts that are not in it are left out.
    """
    shape, persons_id, other_id, rounded = TREEMAPS[domain]
    people = _of(results, persons_id).select(F.col("stratum_1").alias("c"), F.col("count_value").alias("num_persons"))
    if shape:
        names = ["concept_name" if i == 0 else f"level{i}_concept_name" for i in PATHS[shape]]
        path = F.concat_ws("||", *[F.coalesce(n, F.lit("NA")) for n in names])
        tree = levels.filter(F.col("treemap") == shape).select(F.col("concept_id").cast("string").alias("c"), path.alias("concept_path"))
    else:
        tree = levels.select(F.col("concept_id").cast("string").alias("c"), F.col("concept_name").alias("concept_path"))

    def shown(x: Column) -> Column:
        return F.round(x, 5) if rounded else x

    rows = people.join(tree, "c").crossJoin(F.broadcast(_persons(results)))
    share = shown(F.col("num_persons").cast("double") / F.col("persons")).alias("percent_persons")
    if domain.endswith("era"):
        lengths = dist.filter(F.col("analysis_id") == other_id).select(F.col("stratum_1").alias("c"), "avg_value")
        return rows.join(lengths, "c").select(_number("c").alias("concept_id"), "concept_path", "num_persons", share, shown(F.col("avg_value")).alias("length_of_era"))
    records = _of(results, other_id).select(F.col("stratum_1").alias("c"), F.col("count_value").alias("records"))
    each = shown(F.col("records").cast("double") / F.col("num_persons")).alias("records_per_person")
    return rows.join(records, "c").select(_number("c").alias("concept_id"), "concept_path", "num_persons", share, each)


#: Distributions of distinct concepts per person.
CONCEPTS_PER_PERSON = {403: "Condition occurrence", 603: "Procedure occurrence", 703: "Drug exposure", 803: "Observation", 903: "Drug era", 1003: "Condition era", 1803: "Measurement"}


def concepts_per_person(dist: DataFrame) -> DataFrame:
    """Seven statistics of the number of distinct concepts of a person, by table; one pass over the distributions."""
    name = F.create_map(*[x for k, v in CONCEPTS_PER_PERSON.items() for x in (F.lit(k), F.lit(v))])
    rows = dist.filter(F.col("analysis_id").isin(list(CONCEPTS_PER_PERSON)))
    return rows.select(name[F.col("analysis_id")].alias("category"), *[f"{n}_value" for n in ("min", "p10", "p25", "median", "p75", "p90", "max")]).distinct()


def condition_types(results: DataFrame, concept: DataFrame, concept_id: int | None = None) -> DataFrame:
    """Records of conditions by type; types of claims are gathered by setting and by primary and secondary diagnosis."""
    name = F.col("concept_name")
    setting = F.when(name.startswith("Inpatient"), "Inpatient").when(name.startswith("Outpatient"), "Outpatient")
    primary = name.contains("primary") | name.contains("1st position")
    group_id = F.when(setting.isNull(), F.col("concept_id")).otherwise(F.when(setting == "Inpatient", 10).otherwise(20) + F.when(primary, 1).otherwise(2))
    group_name = F.when(setting.isNull(), name).otherwise(F.concat(F.lit("Claim- "), setting, F.lit(": "), F.when(primary, "Primary diagnosis").otherwise("Secondary diagnosis")))
    types = concept.filter(F.lower("vocabulary_id") == "condition type").select(F.col("concept_id").cast("string").alias("stratum_2"), group_id.cast("long").alias("__id"), group_name.alias("__name"))
    rows = _of(results, 405)
    if concept_id is not None:
        rows = rows.filter(F.col("stratum_1") == str(concept_id))
    label = concept.select(F.col("concept_id").cast("string").alias("stratum_1"), F.col("concept_id").alias("condition_concept_id"), F.col("concept_name").alias("condition_concept_name"))
    grouped = rows.join(label, "stratum_1").join(F.broadcast(types), "stratum_2").groupBy("condition_concept_id", "condition_concept_name", "__id", "__name")
    return grouped.agg(F.sum("count_value").alias("count_value")).withColumnsRenamed({"__id": "concept_id", "__name": "concept_name"})


DENSITY = {220: "Visit occurrence", 420: "Condition occurrence", 502: "Death", 620: "Procedure occurrence", 720: "Drug exposure", 820: "Observation", 920: "Drug era", 1020: "Condition era", 111: "Observation period", 1820: "Measurement"}


def total_records(results: DataFrame) -> DataFrame:
    """Records of each table by month, one pass over the results."""
    name = F.create_map(*[x for k, v in DENSITY.items() for x in (F.lit(k), F.lit(v))])
    rows = results.filter(F.col("analysis_id").isin(list(DENSITY)))
    return rows.select(name[F.col("analysis_id")].alias("table_name"), _number("stratum_1").alias("month"), "count_value")


def records_per_person(results: DataFrame) -> DataFrame:
    """The same per person under observation in that month."""
    seen = _of(results, 117).select(_number("stratum_1").alias("month"), F.col("count_value").alias("observed"))
    return total_records(results).join(seen, "month").select("table_name", "month", F.round(F.col("count_value").cast("double") / F.col("observed"), 5).alias("records_per_person"))


def values_to_norm(results: DataFrame, concept: DataFrame, concept_id: int | None = None) -> DataFrame:
    """Records below, within and above the normal range, by concept and unit."""
    label = concept.select(F.col("concept_id").cast("string").alias("stratum_1"), "concept_name")
    rows = _of(results, 1818).join(label, "stratum_1")
    if concept_id is not None:
        rows = rows.filter(F.col("stratum_1") == str(concept_id))
    return rows.select(_number("stratum_1").alias("concept_id"), "concept_name", F.col("stratum_2").alias("unit"), F.col("stratum_3").alias("place"), "count_value")


def deaths_by_month(results: DataFrame) -> DataFrame:
    """Deaths per thousand persons observed in each month."""
    seen = _of(results, 117).select(F.col("stratum_1").alias("m"), F.col("count_value").alias("observed"))
    rows = _of(results, 502).join(seen, F.col("stratum_1") == F.col("m"))
    return rows.select(_number("m").alias("month"), F.round(1000.0 * F.col("count_value").cast("double") / F.col("observed"), 5).alias("prevalence_1000pp"))


def deaths_by_gender_age_year(results: DataFrame, concept: DataFrame) -> DataFrame:
    """Deaths per thousand persons of the same gender, age decile and year under observation."""
    dead = _of(results, 504).select(F.lit("0").alias("stratum_1"), F.col("stratum_1").alias("stratum_2"), F.col("stratum_2").alias("stratum_3"), F.col("stratum_3").alias("stratum_4"), "count_value", "analysis_id")
    both = dead.unionByName(_of(results, 116).select(*dead.columns))
    return prevalence_by_gender_age_year(both, concept, 504).drop("concept_id")


def first_kinds(results: DataFrame, concept: DataFrame, analysis_id: int) -> DataFrame:
    """Counts with the concept of the first stratum."""
    label = concept.select("concept_id", "concept_name")
    return _of(results, analysis_id).join(label, _number("stratum_1") == F.col("concept_id")).select("concept_id", "concept_name", "count_value")


def concept_kinds(results: DataFrame, concept: DataFrame, analysis_id: int, concept_id: int | None = None) -> DataFrame:
    """Counts of a concept by kind (type, unit, operator, value), both by name; kinds that are no concept are left out."""
    kind = concept.select(F.col("concept_id").alias("kind_id"), F.col("concept_name").alias("kind_name"))
    rows = concept_counts(results, concept, analysis_id, concept_id)
    return rows.join(kind, _number("stratum_2") == F.col("kind_id")).select("concept_id", "concept_name", "kind_id", "kind_name", "count_value")


def extent(results: DataFrame, analysis_id: int, step: int = 1) -> DataFrame:
    """Least and greatest stratum and the width of one, all in the unit of the width; nulls without results."""
    stratum = _number("stratum_1")
    return _of(results, analysis_id).agg((F.min(stratum) * step).alias("min_value"), (F.max(stratum) * step).alias("max_value"), F.lit(step).alias("interval_size"))


def from_least(rows: DataFrame) -> DataFrame:
    """Strata counted from the least one."""
    least = rows.agg(F.min("stratum").alias("__least"))
    return rows.crossJoin(F.broadcast(least)).select((F.col("stratum") - F.col("__least")).alias("stratum"), *[c for c in rows.columns if c != "stratum"])  # one row


def by_decile(dist: DataFrame, analysis_id: int) -> DataFrame:
    """Seven statistics by ten years of age."""
    low = _number("stratum_1") * 10
    rows = dist.filter(F.col("analysis_id") == analysis_id)
    return rows.select(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")).alias("category"), *[f"{n}_value" for n in ("min", "p10", "p25", "median", "p75", "p90", "max")])


def population(results: DataFrame) -> DataFrame:
    return _persons(results)
