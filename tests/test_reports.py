"""Hierarchies, report bundles, result tables and the inclusion report."""

import pytest

from meridian.characterize import runner
from meridian.cohort import generate as G
from meridian.cohort.queries import ATTRITION, FLAGSHIP
from meridian.operators import hierarchy
from meridian.operators import vocabulary as V
from meridian.plans import bundles
from meridian.sources import storage
from meridian.sources.adapter import Cdm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cdm(spark):
    return Cdm(spark, SF)


def test_hierarchies_go_up_by_the_largest_id(cdm):
    rows = {(r.treemap, r.concept_id): r for r in hierarchy.concept_hierarchy(cdm).collect()}
    a = rows["Condition", 3001]
    assert (a.level1_concept_name, a.level2_concept_name, a.level3_concept_name, a.level4_concept_name) == ("Condition group 1", "All conditions", "Disorders", "Findings")
    b = rows["Drug", 4003]
    assert (b.level1_concept_name, b.level2_concept_name, b.level3_concept_name, b.level4_concept_name) == ("Drug 3", "Drug class 1", "Drugs of a kind", "All drugs")
    c = rows["Drug Era", 4003]
    assert (c.level1_concept_name, c.level3_concept_name, c.level4_concept_name) == ("Drug class 1", "All drugs", None)
    d = rows["Measurement", 9001]
    assert (d.level1_concept_name, d.level2_concept_name, d.level3_concept_name) == ("Lab tests", "Any test", None)
    e = rows["Procedure", 5001]  # 5001 % 3 = 0
    assert (e.concept_name, e.level1_concept_name, e.level3_concept_name) == ("CPT4 names P1: Procedure 1", "Repair of a joint", "Surgery")
    assert rows["Procedure", 5000].level1_concept_name is None and rows["Observation", 9102].level1_concept_name is None
    assert set(x for x, _ in rows) == set(hierarchy.TREEMAPS)


def test_bundles(cdm, tmp_path):
    numbers = {1, 2, 3, 101, 108, 109, 110, 113, 4, 5, 104, 106, 107, 200, 201, 116, 117, *bundles.DRILLDOWNS["visit"].values()}
    out = runner.run(cdm, str(tmp_path / "store"), sorted(numbers), small_cell=None)
    assert not out.failed
    source = bundles.Source(out.results, out.distributions, cdm["concept"], hierarchy.concept_hierarchy(cdm))
    persons = out.results.filter("analysis_id = 1").first().count_value
    person = {k: bundles.records(v) for k, v in bundles.page(source, "person").items()}
    assert person["summary"] == [{"persons": persons}] and sum(r["countValue"] for r in person["gender"]) == persons
    assert min(r["stratum"] for r in person["yearOfBirth"]) == 0 and person["yearOfBirthStats"][0]["intervalSize"] == 1
    periods = {k: bundles.records(v) for k, v in bundles.page(source, "observationperiod").items()}
    assert all(periods.values()) and periods["observationLengthStats"][0]["maxValue"] % 30 == 0
    assert all(isinstance(bundles.records(v), list) for v in bundles.page(source, "dashboard").values())
    assert {r["conceptId"] for r in bundles.records(bundles.treemap(source, "visit"))} == {9201, 9202, 9203}
    one = bundles.drilldown(source, "visit", 9201)
    assert {r["conceptId"] for r in bundles.records(one["prevalenceByMonth"])} == {9201} and len(bundles.records(one["visitDurationByType"])) == 1
    assert len(bundles.records(bundles.drilldown(source, "visit")["visitDurationByType"])) == 5
    empty = bundles.Source(out.results.limit(0), out.distributions.limit(0), source.concept, source.hierarchy)
    assert all(v.count() == (1 if "Stats" in k else 0) for k, v in bundles.page(empty, "person").items())
    assert all(v.count() == 0 for v in bundles.drilldown(empty, "measurement", 9001).values()) and bundles.page(empty, "datadensity")["conceptsPerPerson"].count() == 0


def test_result_tables_and_the_report_of_a_cohort(spark, cdm, tmp_path):
    path = str(tmp_path / "results")
    assert storage.init_results(spark, path) == list(storage.RESULT_TABLES) and storage.init_results(spark, path) == []
    assert all(storage.read_results(spark, path, t).count() == 0 for t in storage.RESULT_TABLES)
    G.store(cdm, FLAGSHIP, path, 1)
    first = storage.read_results(spark, path, "cohort").count()
    cohort = G.store(cdm, ATTRITION, path, 2)
    G.store(cdm, ATTRITION, path, 2)  # replaced, not added
    stats = storage.read_results(spark, path, "cohort_inclusion_stats").filter("cohort_definition_id = 2")
    assert stats.count() == 6 and storage.read_results(spark, path, "cohort").filter("cohort_definition_id = 1").count() == first
    report = G.inclusion_report(cdm, cohort, 1)
    assert report["summary"]["baseCount"] == sum(c["size"] for g in report["treemapData"]["children"] for c in g["children"])
    by_rule = {r.rule_sequence: r.person_count for r in stats.filter("mode_id = 1").collect()}
    assert [r["countSatisfying"] for r in report["inclusionRuleStats"]] == [by_rule[i] for i in range(3)]
    assert report["treemapData"]["children"][0]["children"] == [{"name": "111", "size": report["summary"]["finalCount"]}]
    with pytest.raises(ValueError, match="partitioned"):
        storage.upsert(cohort.rows, path, "cohort_summary_stats", cohort_definition_id=1)


def test_report_of_a_cohort_without_rules_or_events(cdm):
    nobody = {**FLAGSHIP, "InclusionRules": [], "ConceptSets": [{"id": 0, "expression": {"items": []}}]}
    report = G.inclusion_report(cdm, G.Builder(cdm, nobody).build())
    assert report["summary"] == {"baseCount": 0, "finalCount": 0, "lostCount": 0, "percentMatched": "0.00%"} and report["inclusionRuleStats"] == []


def test_related_and_mapped(cdm):
    assert {r.concept_id for r in V.related_filtered(cdm, [3002], concept_class_id=["HLT", "Code"]).collect()} == {3102, 6002}
    assert {tuple(r) for r in V.mapped_from(cdm, [6001, 6019]).collect()} == {(3001, "6001")}
