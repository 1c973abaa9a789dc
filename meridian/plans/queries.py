"""Registered vocabulary, report, template and storage queries, with their SQL."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..characterize import engine, oracle, runner
from ..operators import hierarchy, intervals
from ..operators import vocabulary as V
from ..sources import storage
from ..sources.adapter import Cdm, with_prefix
from ..sources.scratch import materialize
from . import reports as R
from . import sqltemplate


def _expr(*ids: int, without: tuple[int, ...] = (), mapped: bool = False) -> dict:
    return {"items": [{"concept": {"CONCEPT_ID": i}, "includeDescendants": True, "includeMapped": mapped} for i in ids] + [{"concept": {"CONCEPT_ID": i}, "isExcluded": True, "includeDescendants": True} for i in without]}


_A, _B = _expr(3200, without=(3101,), mapped=True), _expr(3100, 3101)
_IN = "(SELECT descendant_concept_id FROM concept_ancestor a JOIN concept v ON v.concept_id = a.descendant_concept_id WHERE v.invalid_reason IS NULL AND ancestor_concept_id IN ({0}) UNION SELECT concept_id FROM concept WHERE concept_id IN ({0}))"
_SET_A = f"(SELECT * FROM (SELECT descendant_concept_id AS c FROM ({_IN.format('3200')}) i(descendant_concept_id) UNION SELECT concept_id_1 FROM concept_relationship WHERE relationship_id = 'Maps to' AND invalid_reason IS NULL AND concept_id_2 IN {_IN.format('3200')}) u WHERE c NOT IN {_IN.format('3101')})"
_LABELLED = "concept_id, concept_name, domain_id, vocabulary_id, concept_class_id, coalesce(standard_concept, 'N') AS standard_concept, concept_code, coalesce(invalid_reason, 'V') AS invalid_reason"
_OWN = "SELECT condition_concept_id AS concept_id, count(*) AS n FROM condition_occurrence GROUP BY 1"

_VOCABULARY = {
    "vocab_concept_set": (lambda c: V.concept_set(c, _A), f"SELECT c AS concept_id FROM {_SET_A} s"),
    "vocab_search": (lambda c: V.search(c, "drug 1", standard_concept=["S"]), f"SELECT {_LABELLED} FROM concept WHERE (lower(concept_name) LIKE '%drug 1%' OR lower(concept_code) LIKE '%drug 1%' OR CAST(concept_id AS VARCHAR) = 'drug 1') AND standard_concept = 'S'"),
    "vocab_search_lexical": (lambda c: V.search_lexical(c, ["condition", "3"]), "SELECT concept_id, concept_name, round(1 - CAST(length(replace(replace(replace(replace(lower(concept_name), 'condition', ''), '3', ''), ' ', ''), '-', '')) AS DOUBLE) / length(replace(replace(concept_name, ' ', ''), '-', '')), 6) AS score FROM concept WHERE standard_concept = 'S' AND concept_id IN (SELECT concept_id FROM concept WHERE lower(concept_name) LIKE '%condition%' AND lower(concept_name) LIKE '%3%' UNION SELECT concept_id FROM concept_synonym WHERE lower(concept_synonym_name) LIKE '%condition%' AND lower(concept_synonym_name) LIKE '%3%') ORDER BY score DESC, concept_id LIMIT 100"),
    "vocab_concepts": (lambda c: V.get_concepts(c, [3001, 3049, 6001, 4200]), f"SELECT {_LABELLED} FROM concept WHERE concept_id IN (3001, 3049, 6001, 4200)"),
    "vocab_codes": (lambda c: V.lookup_codes(c, ["C1", "D2", "I3"]), f"SELECT {_LABELLED} FROM concept WHERE concept_code IN ('C1', 'D2', 'I3')"),
    "vocab_code_and_vocabulary": (lambda c: V.by_code_and_vocabulary(c, [("C1", "SNOMED"), ("D2", "SNOMED")]), "SELECT concept_id, concept_code, vocabulary_id FROM concept WHERE (concept_code, vocabulary_id) IN (('C1', 'SNOMED'), ('D2', 'SNOMED'))"),
    "vocab_descendants": (lambda c: V.descendants(c, [3200, 4100]), "SELECT ancestor_concept_id, concept_id, concept_name, min_levels_of_separation AS distance FROM concept_ancestor JOIN concept ON concept_id = descendant_concept_id WHERE ancestor_concept_id IN (3200, 4100)"),
    "vocab_ancestors_and_descendants": (lambda c: V.ancestors_and_descendants(c, 3100), "SELECT c.concept_id, CASE WHEN ancestor_concept_id = 3100 THEN 'Has descendant of' ELSE 'Has ancestor of' END AS relationship, min_levels_of_separation AS distance, concept_name FROM concept_ancestor a JOIN concept c ON c.concept_id = CASE WHEN ancestor_concept_id = 3100 THEN descendant_concept_id ELSE ancestor_concept_id END WHERE 3100 IN (ancestor_concept_id, descendant_concept_id) AND ancestor_concept_id <> descendant_concept_id"),
    "vocab_related": (lambda c: V.related(c, [3002, 3100]), """SELECT x.concept_id, relationship, CAST(distance AS INTEGER) AS distance, concept_name FROM (
        SELECT concept_id_2 AS concept_id, relationship_id AS relationship, 1 AS distance FROM concept_relationship WHERE invalid_reason IS NULL AND concept_id_1 IN (3002, 3100)
        UNION SELECT ancestor_concept_id, 'Has ancestor of', min_levels_of_separation FROM concept_ancestor WHERE descendant_concept_id IN (3002, 3100) AND ancestor_concept_id NOT IN (3002, 3100)
        UNION SELECT descendant_concept_id, 'Has descendant of', min_levels_of_separation FROM concept_ancestor WHERE ancestor_concept_id IN (3002, 3100) AND descendant_concept_id NOT IN (3002, 3100)
        UNION SELECT concept_id_1, 'Has relation to descendant of : Maps to', min_levels_of_separation FROM concept_ancestor JOIN concept_relationship ON concept_id_2 = descendant_concept_id WHERE relationship_id = 'Maps to' AND invalid_reason IS NULL AND ancestor_concept_id IN (3002, 3100)) x JOIN concept c ON c.concept_id = x.concept_id"""),
    "vocab_common_ancestors": (lambda c: V.common_ancestors(c, [3000, 3005, 3010]), "SELECT ancestor_concept_id FROM concept_ancestor WHERE descendant_concept_id = 3000 INTERSECT SELECT ancestor_concept_id FROM concept_ancestor WHERE descendant_concept_id = 3005 INTERSECT SELECT ancestor_concept_id FROM concept_ancestor WHERE descendant_concept_id = 3010"),
    "vocab_siblings": (lambda c: V.siblings(c, [3001, 3002], "HLT"), "SELECT b.descendant_concept_id AS concept_id, CAST(min(a.min_levels_of_separation + b.min_levels_of_separation) AS INTEGER) AS distance FROM concept_ancestor a JOIN concept c ON c.concept_id = a.ancestor_concept_id AND concept_class_id = 'HLT' JOIN concept_ancestor b ON b.ancestor_concept_id = a.ancestor_concept_id WHERE a.descendant_concept_id IN (3001, 3002) AND b.descendant_concept_id NOT IN (3001, 3002) GROUP BY 1"),
    "vocab_mapped_sources": (lambda c: V.mapped_sources(c, [3001, 3002, 4003]), "SELECT concept_code AS code, vocabulary_id FROM concept WHERE concept_id IN (3001, 3002, 4003) UNION SELECT concept_code, vocabulary_id FROM concept_relationship JOIN concept ON concept_id = concept_id_1 WHERE relationship_id = 'Maps to' AND concept_relationship.invalid_reason IS NULL AND concept_id_2 IN (3001, 3002, 4003) UNION SELECT source_code, source_vocabulary_id FROM source_to_concept_map WHERE target_concept_id IN (3001, 3002, 4003)"),
    "vocab_standard_targets": (lambda c: V.standard_targets(c, [6001, 6002, 6019]), "SELECT concept_id, concept_name, count(DISTINCT concept_id_1) AS mapped_from FROM concept_relationship r JOIN concept c ON concept_id = concept_id_2 WHERE relationship_id = 'Maps to' AND r.invalid_reason IS NULL AND concept_id_1 IN (6001, 6002, 6019) AND standard_concept IN ('S', 'C') GROUP BY ALL"),
    "vocab_recommended": (lambda c: V.recommended(c, [3001, 3039]), "SELECT DISTINCT concept_id, concept_name, relationship_id FROM concept_recommended JOIN concept ON concept_id = concept_id_2 WHERE concept_id_1 IN (3001, 3039)"),
    "vocab_compare": (lambda c: V.compare(c, _A, _B), f"SELECT coalesce(a.c, b.d) AS concept_id, CASE WHEN b.d IS NULL THEN 1 ELSE 0 END AS only_first, CASE WHEN a.c IS NULL THEN 1 ELSE 0 END AS only_second, CASE WHEN a.c = b.d THEN 1 ELSE 0 END AS in_both FROM {_SET_A} a FULL OUTER JOIN {_IN.format('3100, 3101')} b(d) ON a.c = b.d"),
    "vocab_optimize": (lambda c: V.optimize(c, [3100, 3000, 3001, 3049, 4003, 4100, 4005], [3100, 4100]), "SELECT concept_id, concept_name, CASE WHEN EXISTS (SELECT 1 FROM concept_ancestor a WHERE a.descendant_concept_id = c.concept_id AND a.ancestor_concept_id <> c.concept_id AND a.ancestor_concept_id IN (3100, 4100)) THEN 1 ELSE 0 END AS removed FROM concept c WHERE invalid_reason IS NULL AND concept_id IN (3100, 3000, 3001, 3049, 4003, 4100, 4005)"),
    "vocab_ancestor_pairs": (lambda c: V.ancestor_pairs(c, [3100, 3200, 8507, 6001]), "SELECT ancestor_concept_id AS ancestor_id, descendant_concept_id AS descendant_id FROM concept_ancestor WHERE ancestor_concept_id IN (3100, 3200, 8507, 6001) UNION SELECT concept_id, concept_id FROM concept WHERE concept_id IN (3100, 3200, 8507, 6001)"),
    "vocab_pairs_between": (lambda c: V.pairs_between(c, [3100, 3200, 4100], [3000, 3001, 4002, 4003]), "SELECT DISTINCT ancestor_concept_id AS ancestor_id, descendant_concept_id AS descendant_id FROM concept_ancestor JOIN (VALUES (3100), (3200), (4100)) a(x) ON x = ancestor_concept_id WHERE descendant_concept_id IN (3000, 3001, 4002, 4003)"),
    "vocab_domains": (V.domains, "SELECT domain_id, count(*) AS n FROM concept GROUP BY domain_id"),
    "vocab_vocabularies": (V.vocabularies, "SELECT vocabulary_id, count(*) AS n FROM concept GROUP BY vocabulary_id"),
    "vocab_concept_counts": (lambda c: V.concept_counts(c, c["condition_occurrence"].groupBy(F.col("condition_concept_id").alias("concept_id")).agg(F.count("*").alias("n"))), f"SELECT e.concept_id, CAST(coalesce((SELECT n FROM ({_OWN}) o WHERE o.concept_id = e.concept_id), 0) AS BIGINT) AS record_count, CAST(coalesce((SELECT sum(n) FROM ({_OWN}) o JOIN concept_ancestor a ON a.descendant_concept_id = o.concept_id WHERE a.ancestor_concept_id = e.concept_id), 0) AS BIGINT) AS descendant_record_count FROM (SELECT concept_id FROM concept UNION SELECT ancestor_concept_id FROM concept_ancestor) e"),
    "vocab_domain_list": (V.domain_list, "SELECT domain_id, domain_name, domain_concept_id FROM domain"),
    "vocab_vocabulary_list": (V.vocabulary_list, "SELECT vocabulary_id, vocabulary_name, vocabulary_reference, vocabulary_version, vocabulary_concept_id FROM vocabulary"),
    "vocab_version": (V.version, "SELECT vocabulary_version FROM vocabulary WHERE vocabulary_id = 'None'"),
    "vocab_mapped_from": (lambda c: V.mapped_from(c, [6001, 6002, 6019, 3001]), "SELECT DISTINCT c.concept_id, CAST(concept_id_1 AS VARCHAR) AS mapped_from_id FROM concept_relationship r JOIN concept c ON c.concept_id = concept_id_2 WHERE relationship_id = 'Maps to' AND r.invalid_reason IS NULL AND concept_id_1 IN (6001, 6002, 6019, 3001) AND standard_concept IN ('S', 'C')"),
    "vocab_related_filtered": (lambda c: V.related_filtered(c, [3002, 3100], vocabulary_id=["ICD10CM", "MedDRA"]), f"""SELECT {_LABELLED} FROM concept WHERE vocabulary_id IN ('ICD10CM', 'MedDRA') AND concept_id IN (
        SELECT concept_id_2 FROM concept_relationship WHERE invalid_reason IS NULL AND concept_id_1 IN (3002, 3100)
        UNION SELECT ancestor_concept_id FROM concept_ancestor WHERE descendant_concept_id IN (3002, 3100) UNION SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN (3002, 3100)
        UNION SELECT concept_id_2 FROM concept_relationship JOIN concept_ancestor ON descendant_concept_id = concept_id_1 WHERE relationship_id = 'Mapped from' AND ancestor_concept_id IN (3002, 3100))"""),
    "vocab_concept_hierarchy": (hierarchy.concept_hierarchy, f"{hierarchy.SQL} SELECT * FROM hier"),
    "vocab_hierarchy": (lambda c: V.hierarchy(c, "Condition", "Clinical Finding", ["HLT", "SOC"]), "SELECT concept_id, concept_name, (SELECT t.concept_name FROM concept_ancestor a JOIN concept t ON t.concept_id = a.ancestor_concept_id WHERE a.descendant_concept_id = c.concept_id AND t.concept_class_id = 'HLT' ORDER BY t.concept_id DESC LIMIT 1) AS level1_concept_name, (SELECT t.concept_name FROM concept_ancestor a JOIN concept t ON t.concept_id = a.ancestor_concept_id WHERE a.descendant_concept_id = c.concept_id AND t.concept_class_id = 'SOC' ORDER BY t.concept_id DESC LIMIT 1) AS level2_concept_name FROM concept c WHERE domain_id = 'Condition' AND concept_class_id = 'Clinical Finding'"),
}

#: The distributions that reports read.
_NEEDED_DIST = [104, 106, 107, 206, 213, 406, 506, 606, 706, 715, 716, 717, 806, 815, 906, 907, 1006, 1007, 1806, 1815, 1816, 1817]


class _Tall:
    """Results of analyses as a report asks for them, each analysis written once for a directory."""

    def __init__(self, cdm: Cdm):
        self.cdm = cdm

    def __call__(self, *ids: int) -> DataFrame:
        made = [self.cdm.derived(f"analysis {i}", lambda i=i: engine.run(self.cdm, [i])) for i in ids]
        return functools.reduce(DataFrame.unionByName, made)


def _counts_sql(body: str, ids: list[int]) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM ({oracle.counts(oracle.ANALYSES[i])}) q{i}" for i in ids)
    return with_prefix(f"WITH res AS ({parts}) {body}")


def _dist_sql(body: str, ids: list[int]) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM ({oracle.dist(oracle.ANALYSES[i])}) q{i}" for i in ids)
    return with_prefix(f"WITH res AS ({parts}) {body}")


_P = "(SELECT count_value FROM res WHERE analysis_id = 1)"
_DISTS = "min_value, max_value, median_value, p10_value, p25_value, p75_value, p90_value"
_PATH_SQL = {k: " || '||' || ".join(f"coalesce({f'level{i}_concept_name' if i else 'concept_name'}, 'NA')" for i in v) for k, v in R.PATHS.items()}


def _treemap_sql(domain: str) -> str:
    shape, persons, other, rounded = R.TREEMAPS[domain]
    tree = f"(SELECT concept_id, {_PATH_SQL[shape]} AS concept_path FROM hier WHERE treemap = '{shape}')" if shape else "(SELECT concept_id, concept_name AS concept_path FROM concept)"
    show = "round({0}, 5)".format if rounded else "{0}".format
    share = show(f"CAST(r.count_value AS DOUBLE) / {_P}")
    if domain.endswith("era"):
        last, rest = show("q.avg_value") + " AS length_of_era", f"(SELECT * FROM ({oracle.dist(oracle.ANALYSES[other])}) q{other})"
    else:
        last, rest = show("CAST(q.count_value AS DOUBLE) / r.count_value") + " AS records_per_person", f"(SELECT * FROM ({oracle.counts(oracle.ANALYSES[other])}) q{other})"
    people = " UNION ALL ".join(f"SELECT * FROM ({oracle.counts(oracle.ANALYSES[i])}) q{i}" for i in (1, persons))
    head = f"{hierarchy.SQL}, res AS ({people})" if shape else f"WITH res AS ({people})"
    return with_prefix(f"{head} SELECT t.concept_id, concept_path, r.count_value AS num_persons, {share} AS percent_persons, {last} FROM res r JOIN {rest} q ON q.stratum_1 = r.stratum_1 JOIN {tree} t ON CAST(t.concept_id AS VARCHAR) = r.stratum_1 WHERE r.analysis_id = {persons}")


_REPORTS = {
    **{f"report_share_{i}": ((lambda t, d, c, i=i: R.share_of_persons(t, i)), _counts_sql(f"SELECT CAST(stratum_1 AS BIGINT) AS stratum, count_value, round(CAST(count_value AS DOUBLE) / {_P}, 5) AS share FROM res WHERE analysis_id = {i}", [1, i])) for i in (3, 101, 109, 110, 113)},
    "report_cumulative_observation": (lambda t, d, c: R.cumulative_share(t, 108), _counts_sql(f"SELECT 30 * CAST(r.stratum_1 AS BIGINT) AS days, round(CAST((SELECT sum(count_value) FROM res q WHERE analysis_id = 108 AND CAST(q.stratum_1 AS BIGINT) >= CAST(r.stratum_1 AS BIGINT)) AS DOUBLE) / {_P}, 5) AS share FROM res r WHERE analysis_id = 108", [1, 108])),
    **{f"report_condition_types{name}": ((lambda t, d, c, one=one: R.condition_types(t, c["concept"], one)), _counts_sql(f"""SELECT c.concept_id AS condition_concept_id, c.concept_name AS condition_concept_name, CAST(g.group_id AS BIGINT) AS concept_id, g.group_name AS concept_name, CAST(sum(r.count_value) AS BIGINT) AS count_value
        FROM res r JOIN concept c ON CAST(c.concept_id AS VARCHAR) = r.stratum_1 JOIN (
          SELECT concept_id, CASE k WHEN 0 THEN concept_id ELSE k END AS group_id, CASE k WHEN 11 THEN 'Claim- Inpatient: Primary diagnosis' WHEN 12 THEN 'Claim- Inpatient: Secondary diagnosis' WHEN 21 THEN 'Claim- Outpatient: Primary diagnosis' WHEN 22 THEN 'Claim- Outpatient: Secondary diagnosis' ELSE concept_name END AS group_name
          FROM (SELECT *, CASE WHEN concept_name LIKE 'Inpatient%' THEN 10 WHEN concept_name LIKE 'Outpatient%' THEN 20 ELSE 0 END + CASE WHEN NOT (concept_name LIKE 'Inpatient%' OR concept_name LIKE 'Outpatient%') THEN 0 WHEN concept_name LIKE '%primary%' OR concept_name LIKE '%1st position%' THEN 1 ELSE 2 END AS k FROM concept WHERE lower(vocabulary_id) = 'condition type') z) g
          ON CAST(g.concept_id AS VARCHAR) = r.stratum_2 WHERE r.analysis_id = 405{f" AND r.stratum_1 = '{one}'" if one else ""} GROUP BY 1, 2, 3, 4""", [405])) for name, one in (("", 3001), ("_summary", None))},
    **{f"report_month_{i}": ((lambda t, d, c, i=i: R.prevalence_by_month(t, i)), _counts_sql(f"SELECT CAST(r.stratum_1 AS BIGINT) AS concept_id, CAST(r.stratum_2 AS BIGINT) AS month, round(1000.0::DOUBLE * CAST(r.count_value AS DOUBLE) / q.count_value, 5) AS prevalence_1000pp FROM res r JOIN res q ON q.analysis_id = 117 AND q.stratum_1 = r.stratum_2 WHERE r.analysis_id = {i}", [117, i])) for i in (202, 402, 602, 702, 802, 902, 1002, 1802)},
    **{f"report_gender_age_year_{i}": ((lambda t, d, c, i=i: R.prevalence_by_gender_age_year(t, c["concept"], i)), _counts_sql(f"SELECT CAST(r.stratum_1 AS BIGINT) AS concept_id, CAST(CAST(r.stratum_4 AS BIGINT) * 10 AS VARCHAR) || '-' || CAST(CAST(r.stratum_4 AS BIGINT) * 10 + 9 AS VARCHAR) AS age_decile, concept_name AS gender, CAST(r.stratum_2 AS BIGINT) AS year, round(1000.0::DOUBLE * CAST(r.count_value AS DOUBLE) / q.count_value, 5) AS prevalence_1000pp FROM res r JOIN res q ON q.analysis_id = 116 AND q.stratum_1 = r.stratum_2 AND q.stratum_2 = r.stratum_3 AND q.stratum_3 = r.stratum_4 JOIN concept ON CAST(concept_id AS VARCHAR) = r.stratum_3 WHERE r.analysis_id = {i} AND r.stratum_3 IN ('8507', '8532')", [116, i])) for i in (204, 404, 604, 704, 804, 904, 1004, 1804)},
    "report_drug_frequency": (lambda t, d, c: R.frequency(t, c["concept"], 791), _counts_sql(f"SELECT concept_id, concept_name, CAST(stratum_2 AS BIGINT) AS x, round(100.0::DOUBLE * CAST(count_value AS DOUBLE) / {_P}, 4) AS percent FROM res JOIN concept ON CAST(concept_id AS VARCHAR) = stratum_1 WHERE analysis_id = 791", [1, 791])),
    **{f"report_frequency_{i}": ((lambda t, d, c, i=i: R.frequency(t, c["concept"], i)), _counts_sql(f"SELECT concept_id, concept_name, CAST(stratum_2 AS BIGINT) AS x, round(100.0::DOUBLE * CAST(count_value AS DOUBLE) / {_P}, 4) AS percent FROM res JOIN concept ON CAST(concept_id AS VARCHAR) = stratum_1 WHERE analysis_id = {i}", [1, i])) for i in (691, 891, 1891)},
    **{f"report_kinds_{i}": ((lambda t, d, c, i=i: R.concept_counts(t, c["concept"], i)), _counts_sql(f"SELECT concept_id, concept_name, stratum_2, count_value FROM res JOIN concept ON CAST(concept_id AS VARCHAR) = stratum_1 WHERE analysis_id = {i}", [i])) for i in (2, 4, 5, 605, 705, 805, 807, 822, 823, 1805, 1807, 1822, 1823)},
    "report_values_to_norm": (lambda t, d, c: R.values_to_norm(t, c["concept"]), _counts_sql("SELECT concept_id, concept_name, stratum_2 AS unit, stratum_3 AS place, count_value FROM res JOIN concept ON CAST(concept_id AS VARCHAR) = stratum_1 WHERE analysis_id = 1818", [1818])),
    "report_deaths_by_month": (lambda t, d, c: R.deaths_by_month(t), _counts_sql("SELECT CAST(r.stratum_1 AS BIGINT) AS month, round(1000.0::DOUBLE * CAST(r.count_value AS DOUBLE) / q.count_value, 5) AS prevalence_1000pp FROM res r JOIN res q ON q.analysis_id = 117 AND q.stratum_1 = r.stratum_1 WHERE r.analysis_id = 502", [117, 502])),
    "report_deaths_by_gender_age_year": (lambda t, d, c: R.deaths_by_gender_age_year(t, c["concept"]), _counts_sql("SELECT CAST(CAST(r.stratum_3 AS BIGINT) * 10 AS VARCHAR) || '-' || CAST(CAST(r.stratum_3 AS BIGINT) * 10 + 9 AS VARCHAR) AS age_decile, concept_name AS gender, CAST(r.stratum_1 AS BIGINT) AS year, round(1000.0::DOUBLE * CAST(r.count_value AS DOUBLE) / q.count_value, 5) AS prevalence_1000pp FROM res r JOIN res q ON q.analysis_id = 116 AND q.stratum_1 = r.stratum_1 AND q.stratum_2 = r.stratum_2 AND q.stratum_3 = r.stratum_3 JOIN concept ON CAST(concept_id AS VARCHAR) = r.stratum_2 WHERE r.analysis_id = 504 AND r.stratum_2 IN ('8507', '8532')", [116, 504])),
    **{f"report_first_kinds_{i}": ((lambda t, d, c, i=i: R.first_kinds(t, c["concept"], i)), _counts_sql(f"SELECT concept_id, concept_name, count_value FROM res JOIN concept ON CAST(concept_id AS VARCHAR) = stratum_1 WHERE analysis_id = {i}", [i])) for i in (2, 4, 5, 505)},
    **{f"report_concept_kinds_{i}": ((lambda t, d, c, i=i: R.concept_kinds(t, c["concept"], i)), _counts_sql(f"SELECT c.concept_id, c.concept_name, k.concept_id AS kind_id, k.concept_name AS kind_name, count_value FROM res JOIN concept c ON CAST(c.concept_id AS VARCHAR) = stratum_1 JOIN concept k ON CAST(k.concept_id AS VARCHAR) = stratum_2 WHERE analysis_id = {i}", [i])) for i in (605, 705, 805, 822, 823, 1805, 1807, 1822, 1823)},
    **{f"report_extent_{i}": ((lambda t, d, c, i=i, n=n: R.extent(t, i, n)), _counts_sql(f"SELECT {n} * min(CAST(stratum_1 AS BIGINT)) AS min_value, {n} * max(CAST(stratum_1 AS BIGINT)) AS max_value, {n} AS interval_size FROM res WHERE analysis_id = {i}", [i])) for i, n in ((3, 1), (108, 30), (109, 1))},
    **{f"report_from_least_{i}": ((lambda t, d, c, i=i: R.from_least(R.share_of_persons(t, i))), _counts_sql(f"SELECT CAST(stratum_1 AS BIGINT) - (SELECT min(CAST(stratum_1 AS BIGINT)) FROM res WHERE analysis_id = {i}) AS stratum, count_value, round(CAST(count_value AS DOUBLE) / {_P}, 5) AS share FROM res WHERE analysis_id = {i}", [1, i])) for i in (3, 109)},
    "report_share_108": (lambda t, d, c: R.share_of_persons(t, 108), _counts_sql(f"SELECT CAST(stratum_1 AS BIGINT) AS stratum, count_value, round(CAST(count_value AS DOUBLE) / {_P}, 5) AS share FROM res WHERE analysis_id = 108", [1, 108])),
    "report_duration_by_decile": (lambda t, d, c: R.by_decile(d, 107), _dist_sql("SELECT CAST(CAST(stratum_1 AS BIGINT) * 10 AS VARCHAR) || '-' || CAST(CAST(stratum_1 AS BIGINT) * 10 + 9 AS VARCHAR) AS category, min_value, p10_value, p25_value, median_value, p75_value, p90_value, max_value FROM res", [107])),
    "report_population": (lambda t, d, c: R.population(t), _counts_sql(f"SELECT CAST({_P} AS BIGINT) AS persons", [1])),
    **{f"report_{d}_treemap": ((lambda t, dd, c, d=d: R.treemap(t, dd, c["concept"] if d == "visit" else c.derived("concept_hierarchy", lambda: hierarchy.concept_hierarchy(c)), d)), _treemap_sql(d)) for d in R.TREEMAPS},
    "report_concepts_per_person": (lambda t, d, c: R.concepts_per_person(d), _dist_sql("SELECT DISTINCT CASE analysis_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.CONCEPTS_PER_PERSON.items()) + " END AS category, min_value, p10_value, p25_value, median_value, p75_value, p90_value, max_value FROM res", list(R.CONCEPTS_PER_PERSON))),
    "report_total_records": (lambda t, d, c: R.total_records(t), _counts_sql("SELECT CASE analysis_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.DENSITY.items()) + f" END AS table_name, CAST(stratum_1 AS BIGINT) AS month, count_value FROM res WHERE analysis_id IN ({', '.join(map(str, R.DENSITY))})", list(R.DENSITY))),
    "report_records_per_person": (lambda t, d, c: R.records_per_person(t), _counts_sql("SELECT CASE r.analysis_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.DENSITY.items()) + f" END AS table_name, CAST(r.stratum_1 AS BIGINT) AS month, round(CAST(r.count_value AS DOUBLE) / q.count_value, 5) AS records_per_person FROM res r JOIN res q ON q.analysis_id = 117 AND q.stratum_1 = r.stratum_1 WHERE r.analysis_id IN ({', '.join(map(str, R.DENSITY))})", [117, *R.DENSITY])),
    **{f"report_distribution_{i}": ((lambda t, d, c, i=i: R.distribution_lookup(d, c["concept"], i)), _dist_sql(f"SELECT stratum_1, stratum_2, concept_name AS category, {_DISTS} FROM res LEFT JOIN concept ON CAST(concept_id AS VARCHAR) = coalesce(stratum_2, stratum_1) WHERE analysis_id = {i}", [i])) for i in _NEEDED_DIST},
}


def _report(make, sql: str):
    ids = sorted({int(x) for x in re.findall(r"\) q(\d+)\b", sql)})  # the analyses that its SQL reads
    counts, dists = [i for i in ids if not runner.is_distribution(i)], [i for i in ids if runner.is_distribution(i)]

    def run(spark, sf_dir: str) -> DataFrame:
        cdm = Cdm(spark, sf_dir)
        tall = _Tall(cdm)
        return make(tall(*counts) if counts else None, tall(*dists) if dists else None, cdm)

    return run


def era_merge(spark, sf_dir: str) -> DataFrame:
    """Visits of a person merged where they are at most 30 days apart."""
    visits = Cdm(spark, sf_dir)["visit_occurrence"].select("person_id", F.col("visit_start_date").alias("s"), F.coalesce("visit_end_date", "visit_start_date").alias("e")).filter("e >= s")
    return intervals.merge_eras(visits, ["person_id"], "s", "e", 30, {"visits": F.count("*")})


def stored_visits(spark, sf_dir: str) -> DataFrame:
    """Visits written as a sorted, year-partitioned store and read back through the conforming loader."""
    cdm = Cdm(spark, sf_dir)
    path = storage.export(cdm["visit_occurrence"], "visit_occurrence")
    return storage.load(spark, path, "visit_occurrence").groupBy(F.year("visit_start_date").alias("year")).agg(F.count("*").alias("n"), F.count("visit_end_date").alias("ended"), F.count("admitting_source_concept_id").alias("admitted"))


def translated_sql(spark, sf_dir: str) -> DataFrame:
    """A parameterised script in the common clinical dialect, rendered, translated and run."""
    text = sqltemplate.render("{DEFAULT @t = 'visit_occurrence'}SELECT YEAR(visit_start_date) AS y, COUNT_BIG(*) AS n, SUM(DATEDIFF(dd, visit_start_date, ISNULL(visit_end_date, DATEADD(day, 1, visit_start_date)))) AS d FROM @t {@late} ? {WHERE visit_start_date >= DATEFROMPARTS(1999, 1, 1)} GROUP BY YEAR(visit_start_date);", late=True)
    (statement,) = sqltemplate.split(sqltemplate.to_spark(text))
    return Cdm(spark, sf_dir).sql(statement).select(F.col("y").cast("bigint"), "n", F.col("d").cast("bigint"))


_UNITS_SCRIPT = """
    IF OBJECT_ID('tempdb..#late', 'U') IS NOT NULL DROP TABLE #late;
    SELECT visit_occurrence_id AS id, visit_start_date AS s, ISNULL(visit_end_date, DATEADD(wk, 1, visit_start_date)) AS e INTO #late FROM @t WHERE visit_start_date >= DATEFROMPARTS(@y, 7, 1);
    SELECT id, DATEADD(yy, 2, s) AS y2, DATEADD(mm, -1, s) AS m1, DATEADD(qq, 1, s) AS q1, DATEDIFF(year, s, e) AS dy, DATEDIFF(month, s, e) AS dm, DATEDIFF(quarter, s, e) AS dq, DATEDIFF(week, s, e) AS dw, DATEDIFF(dd, s, e) AS dd, 'DATEADD(dd, 1, x) #t' AS quoted FROM #late;
"""


def script_with_units(spark, sf_dir: str) -> DataFrame:
    """A script of several statements: a temporary table, date arithmetic in every unit, a quoted text that must stay."""
    rows = sqltemplate.run_script(Cdm(spark, sf_dir), _UNITS_SCRIPT, t="visit_occurrence", y=2000)
    return rows.select("id", "y2", "m1", "q1", *[F.col(c).cast("bigint").alias(c) for c in ("dy", "dm", "dq", "dw", "dd")], "quoted")


QUERIES = {
    **{name: (lambda spark, sf_dir, make=make: make(Cdm(spark, sf_dir))) for name, (make, _) in _VOCABULARY.items()},
    **{name: _report(make, sql) for name, (make, sql) in _REPORTS.items()},
    "interval_era_merge": era_merge,
    "storage_export_and_load": stored_visits,
    "sql_translation": translated_sql,
    "sql_script": script_with_units,
}
ORACLE_SQL = {
    **{name: with_prefix(sql) for name, (_, sql) in _VOCABULARY.items()},
    **{name: sql for name, (_, sql) in _REPORTS.items()},
    "interval_era_merge": with_prefix("WITH v AS (SELECT person_id, visit_start_date AS s, coalesce(visit_end_date, visit_start_date) AS e, visit_occurrence_id AS i FROM visit_occurrence WHERE coalesce(visit_end_date, visit_start_date) >= visit_start_date) SELECT person_id, min(s) AS s, max(e) AS e, count(*) AS visits FROM (SELECT *, sum(f) OVER (PARTITION BY person_id ORDER BY s, e, i) AS g FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY person_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 >= s THEN 0 ELSE 1 END AS f FROM v) x) y GROUP BY person_id, g"),
    "storage_export_and_load": with_prefix("SELECT CAST(year(visit_start_date) AS INTEGER) AS year, count(*) AS n, count(visit_end_date) AS ended, CAST(0 AS BIGINT) AS admitted FROM visit_occurrence GROUP BY 1"),
    "sql_script": with_prefix("""
        SELECT id, CAST(s + INTERVAL 2 YEAR AS DATE) AS y2, CAST(s - INTERVAL 1 MONTH AS DATE) AS m1, CAST(s + INTERVAL 3 MONTH AS DATE) AS q1, date_diff('year', s, e) AS dy, date_diff('month', s, e) AS dm, date_diff('quarter', s, e) AS dq,
               CAST(floor((e - DATE '1899-12-31') / 7) - floor((s - DATE '1899-12-31') / 7) AS BIGINT) AS dw, CAST(e - s AS BIGINT) AS dd, 'DATEADD(dd, 1, x) #t' AS quoted
        FROM (SELECT visit_occurrence_id AS id, visit_start_date AS s, coalesce(visit_end_date, visit_start_date + 7) AS e FROM visit_occurrence WHERE visit_start_date >= DATE '2000-07-01') v"""),
    "sql_translation": with_prefix("SELECT year(visit_start_date) AS y, count(*) AS n, CAST(sum(coalesce(visit_end_date, visit_start_date + 1) - visit_start_date) AS BIGINT) AS d FROM visit_occurrence WHERE visit_start_date >= DATE '1999-01-01' GROUP BY 1"),
}
