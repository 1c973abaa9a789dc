"""Operators on tiny frames, and registered queries against their SQL on the driver's smallest tables."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meridian.characterize.registry import ANALYSES
from meridian.cohort import generate as G
from meridian.cohort.criteria import SPECS, compare, four_places, whole_number
from meridian.operators.distribution import distribution, rank_distribution
from meridian.operators.intervals import inside_period, merge_eras, outside_period
from meridian.plans import sqltemplate as T
from meridian.sources import storage

SF = "/root/testdata/sf0.001"
D = dt.date


def test_eras_touching_nested_and_apart(spark):
    rows = [(1, D(2020, 1, 1), D(2020, 1, 31)), (1, D(2020, 1, 5), D(2020, 1, 6)), (1, D(2020, 2, 1), D(2020, 2, 5)), (1, D(2020, 3, 10), D(2020, 3, 11)), (2, D(2020, 1, 1), D(2020, 1, 1))]
    frame = spark.createDataFrame(rows, "p int, s date, e date")
    near = sorted(map(tuple, merge_eras(frame, ["p"], "s", "e", 1).collect()))
    assert near == [(1, D(2020, 1, 1), D(2020, 2, 5)), (1, D(2020, 3, 10), D(2020, 3, 11)), (2, D(2020, 1, 1), D(2020, 1, 1))]
    assert merge_eras(frame, ["p"], "s", "e", 1, pad=False).count() == 4
    assert merge_eras(frame.limit(0), ["p"], "s", "e").count() == 0


def test_periods(spark):
    ops = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 6, 1)), (1, D(2020, 5, 1), D(2020, 9, 1))], "person_id int, observation_period_start_date date, observation_period_end_date date")
    rows = spark.createDataFrame([(1, D(2020, 5, 15)), (1, D(2021, 1, 1)), (2, D(2020, 1, 2)), (1, None)], "person_id int, d date")
    assert inside_period(rows, ops, "d").count() == 2  # once for each period that holds it
    assert outside_period(rows, ops, "d").count() == 3


def test_percentiles_count_missing_values(spark):
    rows = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("a", None), ("b", 1.0), (None, 9.0)], "k string, v double")
    got = {r.k: r for r in distribution(rows, "v", ["k"]).collect()}
    assert set(got) == {"a", "b"} and (got["a"].count_value, got["a"].median_value, got["a"].p90_value, got["a"].max_value) == (3, 7.0, 7.0, 7.0)
    assert got["b"].stdev_value is None
    (r,) = rank_distribution(rows.filter("k = 'a' and v is not null"), "v", []).collect()
    assert (r.p10_value, r.median_value, r.p90_value) == (-9999.0, 5.0, 7.0)


def test_numbers():
    assert (whole_number("-3.9"), whole_number(None), four_places(1.00005)) == (-3, 0, 1.0001)
    with pytest.raises(ValueError):
        whole_number(1 << 31)
    with pytest.raises(ValueError):
        compare(F.lit(1), "near", F.lit(1), None)


class Tiny(dict):
    """Clinical tables given as frames."""

    def __init__(self, spark, **tables):
        super().__init__(tables)
        self.spark = spark


@pytest.fixture(scope="module")
def tiny(spark):
    conditions = [(1, 1, 10, D(2020, 3, 1), None), (2, 1, 10, D(2020, 2, 1), D(2020, 2, 3)), (3, 2, 10, D(2020, 2, 1), None), (4, 2, 11, D(2020, 2, 10), None), (5, 3, 10, D(2019, 1, 1), None)]
    return Tiny(
        spark,
        concept=spark.createDataFrame([(10, None), (11, None), (12, "D")], "concept_id long, invalid_reason string"),
        concept_ancestor=spark.createDataFrame([(10, 10), (10, 12)], "ancestor_concept_id long, descendant_concept_id long"),
        person=spark.createDataFrame([(1, 8507, 1980, 1, 1), (2, 8532, 1990, 1, 1), (3, 8532, 2000, 1, 1)], "person_id long, gender_concept_id long, year_of_birth int, race_concept_id long, ethnicity_concept_id long"),
        observation_period=spark.createDataFrame([(i, i, D(2020, 1, 1), D(2020, 12, 31)) for i in (1, 2, 3)], "observation_period_id long, person_id long, observation_period_start_date date, observation_period_end_date date"),
        condition_occurrence=spark.createDataFrame([(*r, 0, None, None) for r in conditions], "condition_occurrence_id long, person_id long, condition_concept_id long, condition_start_date date, condition_end_date date, condition_source_concept_id long, visit_occurrence_id long, stop_reason string"),
    )


def _definition(limit="All", prior=0, **more):
    return {"ConceptSets": [{"id": 0, "expression": {"items": [{"concept": {"CONCEPT_ID": 10}, "includeDescendants": True}]}}, {"id": 1, "expression": {"items": [{"concept": {"CONCEPT_ID": 11}}]}}],
            "PrimaryCriteria": {"CriteriaList": [{"ConditionOccurrence": {"CodesetId": 0}}], "ObservationWindow": {"PriorDays": prior, "PostDays": 0}, "PrimaryCriteriaLimit": {"Type": limit}}, **more}


def _rows(tiny, definition):
    return sorted((r.subject_id, r.cohort_start_date, r.cohort_end_date) for r in G.generate(tiny, definition).collect())


def test_limits_and_windows(tiny):
    year_end = D(2020, 12, 31)
    assert _rows(tiny, _definition("First")) == [(1, D(2020, 2, 1), year_end), (2, D(2020, 2, 1), year_end)]
    assert _rows(tiny, _definition("Last")) == [(1, D(2020, 3, 1), year_end), (2, D(2020, 2, 1), year_end)]
    assert _rows(tiny, _definition(prior=40)) == [(1, D(2020, 3, 1), year_end)]
    with pytest.raises(ValueError):
        _rows(tiny, _definition(limit=""))


def test_exits_and_counts(tiny):
    offset = {"EndStrategy": {"DateOffset": {"DateField": "EndDate", "Offset": 10}}}
    assert _rows(tiny, _definition(**offset)) == [(1, D(2020, 2, 1), D(2020, 2, 13)), (1, D(2020, 3, 1), D(2020, 3, 12)), (2, D(2020, 2, 1), D(2020, 2, 12))]
    none = {"Criteria": {"ConditionOccurrence": {"CodesetId": 1}}, "StartWindow": {"Start": {"Days": 0, "Coeff": 1}, "End": {"Days": 30, "Coeff": 1}}, "Occurrence": {"Type": 0, "Count": 0}}
    rule = lambda c: {"InclusionRules": [{"name": "r", "expression": {"Type": "ALL", "CriteriaList": [c]}}]}
    assert {r[0] for r in _rows(tiny, _definition(**rule(none)))} == {1}
    some = none | {"Occurrence": {"Type": 2, "Count": 1}}
    assert {r[0] for r in _rows(tiny, _definition(**rule(some)))} == {2}
    with pytest.raises(ValueError):
        _rows(tiny, _definition(InclusionRules=[{"name": "r", "expression": {"Type": "SOME", "CriteriaList": [none]}}]))


def test_first_is_found_before_other_filters(tiny):
    first = {"ConditionOccurrence": {"CodesetId": 0, "First": True, "OccurrenceStartDate": {"Op": "gt", "Value": "2020-02-15"}}}
    d = _definition()
    d["PrimaryCriteria"]["CriteriaList"] = [first]
    assert _rows(tiny, d) == []


def test_templates():
    assert T.render("{DEFAULT @a = 1}SELECT @a, @ab {@c == 'x' & @a != 2} ? {YES} : {NO}", ab=[1, 2], c="x") == "SELECT 1, 1,2 YES"
    assert T.render("{@x IN (1,2)}?{a{@y}?{b}:{c}}:{d}", x=2, y=False) == "ac"
    assert T.split("SELECT ';' AS a; SELECT CASE WHEN 1=1 THEN 2 END; -- x;\nSELECT [a;b]") == ["SELECT ';' AS a", "SELECT CASE WHEN 1=1 THEN 2 END", "-- x;\nSELECT [a;b]"]
    assert T.to_spark("SELECT DATEDIFF(dd, a, DATEADD(day, 1, b)), CAST(x AS VARCHAR(255))") == "SELECT date_diff(date_add(b, 1), a), CAST(x AS STRING)"


def test_conforming_load(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "Visit_Occurrence_ID int, other string").write.parquet(str(tmp_path / "v"))
    rows = storage.load(spark, str(tmp_path / "v"), "visit_occurrence")
    assert rows.columns == list(storage.COLUMNS["visit_occurrence"]) and rows.first().visit_occurrence_id == 1 and rows.first().person_id is None
    assert storage.load(spark, str(tmp_path / "none"), "visit_occurrence").count() == 0


def test_all_analyses_and_criteria_are_there():
    assert len(ANALYSES) == 294 and len(SPECS) == 17  # and CustomEra, which merges others
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    return "NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["cohort_flagship", "cohort_drug_era_exit", "cohort_rule_statistics", "criteria_drugexposure", "criteria_observationperiod", "achilles_person_counts", "achilles_death_dist", "achilles_cost_dist", "vocab_compare", "report_condition_treemap", "interval_era_merge"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    done = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in done.description]
    assert sorted(names) == cols
    assert sorted(tuple(_plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in done.fetchall())
