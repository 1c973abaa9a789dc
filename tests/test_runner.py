"""The runner of analyses, script translation, and what definitions must not contain."""

import pytest

from meridian.characterize import runner
from meridian.cohort import criteria, generate
from meridian.plans import sqltemplate
from meridian.sources.adapter import Cdm

SF = "/root/testdata/sf0.001"


def test_runner_notes_failures_resumes_and_cuts_small_cells(spark, tmp_path):
    cdm, store = Cdm(spark, SF), str(tmp_path / "store")
    said = []
    first = runner.run(cdm, store, [1, 3, 9999, 506, 2], small_cell=None, skip=[2], log=said.append)
    assert first.done == [1, 3, 506] and [n for n, _ in first.failed] == [9999] and "2 skipped" in said
    assert {r.analysis_id for r in first.results.collect()} == {1, 3} and {r.analysis_id for r in first.distributions.collect()} == {506}
    said.clear()
    again = runner.run(cdm, store, [1, 3, 506], resume=True, small_cell=2, log=said.append)
    assert said == [] and again.done == [1, 3, 506]
    assert min(r.count_value for r in again.results.collect()) > 2 < max(r.count_value for r in first.results.collect())
    assert runner.run(cdm, store, []).results.count() == 0
    names = runner.dictionary(spark)
    assert names.count() == len(runner.ANALYSES) and names.filter("analysis_id = 404").first().stratum_3_name == "gender_concept_id"


def test_date_arithmetic_in_every_unit():
    say = sqltemplate.to_spark
    assert say("SELECT DATEADD(yy, 2, d), DATEADD(q, n + 1, d), DATEADD(month, 1, d), DATEADD(wk, 1, d), DATEADD(dd, -1, d)") == "SELECT add_months(d, 12 * (2)), add_months(d, 3 * (n + 1)), add_months(d, 1), date_add(d, 7 * (1)), date_add(d, -1)"
    assert say("SELECT DATEDIFF(year, a, b), DATEDIFF(mm, a, b)") == "SELECT (year(b) - year(a)), ((year(b) - year(a)) * 12 + month(b) - month(a))"
    with pytest.raises(ValueError, match="fortnight"):
        say("SELECT DATEADD(fortnight, 1, d)")


def test_quotes_stay_and_temporary_tables_are_made():
    script = "IF OBJECT_ID('tempdb..#a', 'U') IS NOT NULL DROP TABLE #a; SELECT 'it''s; #a LEN(x)' AS t INTO #a FROM s; WITH q AS (SELECT 1 AS x) SELECT x INTO r FROM q; INSERT INTO #a SELECT TOP 3 y FROM z -- LEN(y) #b"
    assert sqltemplate.split(sqltemplate.to_spark(script, "s1_")) == [
        "DROP VIEW IF EXISTS s1_a",
        "CREATE OR REPLACE TEMPORARY VIEW s1_a AS SELECT 'it''s; #a LEN(x)' AS t FROM s",
        "CREATE TABLE r AS WITH q AS (SELECT 1 AS x) SELECT x FROM q",
        "INSERT INTO s1_a SELECT y FROM z /* LEN(y) #b */ LIMIT 3",
    ]
    assert sqltemplate.unused("SELECT @a FROM @bc", a=1, b=2, bc=3) == ["b"]


def test_fields_that_mean_nothing_are_errors():
    assert criteria.unknown_fields("Episode", {"CodesetId": 1, "OccurrenceStartDate": {"Op": "gt"}, "EpisodeNumber": None}) == ["OccurrenceStartDate"]
    assert criteria.unknown_fields("DrugExposure", {"EffectiveDrugDose": {}, "DoseUnitCS": {}, "DrugTypeExclude": True, "DrugSourceConcept": 3, "Age": {}}) == []
    assert criteria.unknown_fields("VisitOccurrence", {"PlaceOfServiceLocation": 2, "PlaceOfService": []}) == []


def test_columns_of_distinct_counts():
    columns = {"a_condition_concept_id", "a_start", "a_end", "a_visit", "a_unit_concept_id", "a_condition_source_concept_id"}
    for name in ("DOMAIN_CONCEPT", "START_DATE", "END_DATE", "VISIT_ID", "UNIT", "DURATION", "DOMAIN_SOURCE_CONCEPT"):
        assert generate._counted_column({"ConditionOccurrence": {}}, name, columns) is not None
    with pytest.raises(ValueError, match="RANGE_LOW"):
        generate._counted_column({"ConditionOccurrence": {}}, "RANGE_LOW", columns)
