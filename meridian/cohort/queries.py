"""Registered cohort queries: definitions as the engine reads them, and the same cohorts written out in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.adapter import Cdm, with_prefix
from ..sources.scratch import scratch_dir
from . import generate as G
from .criteria import SPECS, Evaluator


def _set(i: int, *ids: int, below: bool = True, mapped: bool = False, without: tuple[int, ...] = ()) -> dict:
    items = [{"concept": {"CONCEPT_ID": c}, "includeDescendants": below, "includeMapped": mapped} for c in ids]
    items += [{"concept": {"CONCEPT_ID": c}, "isExcluded": True, "includeDescendants": True} for c in without]
    return {"id": i, "name": f"set {i}", "expression": {"items": items}}


def _after(kind: str, codeset: int, days: int | None, count: int = 1, type_: int = 2, **more) -> dict:
    return {"Criteria": {kind: {"CodesetId": codeset}}, "StartWindow": {"Start": {"Days": 0, "Coeff": 1}, "End": {"Days": days, "Coeff": 1}}, "Occurrence": {"Type": type_, "Count": count}} | more


def _entry(kind: str, codeset: int, prior: int, limit: str = "First", **more) -> dict:
    return {"CriteriaList": [{kind: {"CodesetId": codeset} | more}], "ObservationWindow": {"PriorDays": prior, "PostDays": 0}, "PrimaryCriteriaLimit": {"Type": limit}}


FLAGSHIP = {
    "ConceptSets": [_set(0, 3100), _set(1, 4100)],
    "PrimaryCriteria": _entry("ConditionOccurrence", 0, 365),
    "InclusionRules": [{"name": "treated within 30 days", "expression": {"Type": "ALL", "CriteriaList": [_after("DrugExposure", 1, 30)]}}],
    "ExpressionLimit": {"Type": "First"},
    "CollapseSettings": {"CollapseType": "ERA", "EraPad": 30},
}

ATTRITION = {
    "ConceptSets": [_set(0, 3100, 3101), _set(1, 4100), _set(2, 5000, 5001, 5002, 5003, 5004, below=False)],
    "PrimaryCriteria": _entry("ConditionOccurrence", 0, 0, "All"),
    "InclusionRules": [
        {"name": "a drug within 90 days", "expression": {"Type": "ALL", "CriteriaList": [_after("DrugExposure", 1, 90)]}},
        {"name": "no procedure in the period afterwards", "expression": {"Type": "ALL", "CriteriaList": [_after("ProcedureOccurrence", 2, None, 0, 0)]}},
        {"name": "women, or two drugs", "expression": {"Type": "ANY", "DemographicCriteriaList": [{"Gender": [{"CONCEPT_ID": 8532}]}], "CriteriaList": [_after("DrugExposure", 1, 365, 2)]}},
    ],
    "ExpressionLimit": {"Type": "All"},
    "EndStrategy": {"DateOffset": {"DateField": "EndDate", "Offset": 60}},
    "CollapseSettings": {"EraPad": 14},
    "CensorWindow": {"StartDate": "1996-06-01", "EndDate": "2000-12-31"},
}

DRUG_ERA_EXIT = {
    "ConceptSets": [_set(0, 4100), _set(1, 3101)],
    "PrimaryCriteria": _entry("DrugExposure", 0, 30, "All"),
    "EndStrategy": {"CustomEra": {"DrugCodesetId": 0, "GapDays": 30, "Offset": 7}},
    "CensoringCriteria": [{"ConditionOccurrence": {"CodesetId": 1}}],
    "ExpressionLimit": {"Type": "All"},
    "CollapseSettings": {"EraPad": 0},
}

ADDITIONAL = {
    "ConceptSets": [_set(0, 3200, without=(3100,)), _set(1, 4200)],
    "PrimaryCriteria": _entry("ConditionOccurrence", 0, 0, "All", OccurrenceStartDate={"Op": "bt", "Value": "1995-06-01", "Extent": "2000-06-30"}, Age={"Op": "gte", "Value": 30}),
    "AdditionalCriteria": {"Type": "AT_LEAST", "Count": 1, "CriteriaList": [_after("DrugExposure", 1, 60, 1, RestrictVisit=False), _after("ConditionOccurrence", 0, 365, 3)], "Groups": [{"Type": "AT_MOST", "Count": 0, "CriteriaList": [_after("VisitOccurrence", 0, 30)]}]},
    "QualifiedLimit": {"Type": "Last"},
    "ExpressionLimit": {"Type": "Last"},
    "CollapseSettings": {"EraPad": 0},
}


def _rows(definition: dict):
    return lambda spark, sf_dir: G.generate(Cdm(spark, sf_dir), definition)


def attrition_masks(spark, sf_dir: str) -> DataFrame:
    cdm = Cdm(spark, sf_dir)
    return G.inclusion_results(G.Builder(cdm, ATTRITION).build()).select(F.col("mode_id").cast("int"), "inclusion_rule_mask", "person_count")


def attrition_rules(spark, sf_dir: str) -> DataFrame:
    cdm = Cdm(spark, sf_dir)
    return G.rule_statistics(cdm, G.Builder(cdm, ATTRITION).build())


def attrition_summary(spark, sf_dir: str) -> DataFrame:
    cdm = Cdm(spark, sf_dir)
    return G.summary_statistics(G.Builder(cdm, ATTRITION).build())


def attrition_censored(spark, sf_dir: str) -> DataFrame:
    cdm = Cdm(spark, sf_dir)
    return G.censor_statistics(G.Builder(cdm, ATTRITION).build())


def attrition_groups(spark, sf_dir: str) -> DataFrame:
    return G.inclusion_groups(G.Builder(Cdm(spark, sf_dir), ATTRITION).build()).select(F.col("mode_id").cast("int"), F.col("rules_met").cast("int"), "name", "size")


def stored_statistics(spark, sf_dir: str) -> DataFrame:
    """A cohort and its statistics written into the result tables, then replaced by another definition's, and its rules read back."""
    cdm = Cdm(spark, sf_dir)
    path = f"{scratch_dir(spark)}/results-{uuid.uuid4().hex}"
    G.store(cdm, FLAGSHIP, path, 5)
    G.store(cdm, FLAGSHIP, path, 4)
    G.store(cdm, ATTRITION, path, 5)
    rules = storage.read_results(spark, path, "cohort_inclusion")
    stats = storage.read_results(spark, path, "cohort_inclusion_stats").filter("cohort_definition_id = 5")
    return stats.join(rules, ["cohort_definition_id", "rule_sequence"]).select("cohort_definition_id", "mode_id", "rule_sequence", "name", "person_count", "gain_count", "person_total")


#: One criterion of each type, with filters of every kind, and its SQL: rows of (person_id, event_id, start, end).
EVENTS: dict[str, tuple[dict, str]] = {
    "ConditionEra": ({"CodesetId": 0, "EraLength": {"Op": "gt", "Value": 3}, "OccurrenceCount": {"Op": "gte", "Value": 1}, "AgeAtStart": {"Op": "lt", "Value": 60}}, "SELECT e.person_id, condition_era_id AS event_id, condition_era_start_date AS s, condition_era_end_date AS e FROM condition_era e JOIN person p ON p.person_id = e.person_id WHERE condition_concept_id % 5 = 0 AND condition_era_end_date - condition_era_start_date > 3 AND year(condition_era_start_date) - year_of_birth < 60"),
    "ConditionOccurrence": ({"CodesetId": 0, "First": True, "StopReason": {"Op": "!contains", "Text": "ruled"}, "ProviderSpecialty": [{"CONCEPT_ID": 38004400 + i} for i in range(12)]}, "SELECT x.person_id, condition_occurrence_id, condition_start_date, coalesce(condition_end_date, condition_start_date + 1) FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY condition_start_date, condition_occurrence_id) AS rn FROM condition_occurrence WHERE condition_concept_id % 5 = 0) x JOIN provider q ON q.provider_id = x.provider_id WHERE rn = 1 AND stop_reason NOT LIKE '%ruled%' AND specialty_concept_id < 38004412"),
    "Death": ({"DeathType": [{"CONCEPT_ID": 38003569}], "OccurrenceStartDate": {"Op": "lt", "Value": "2002-01-01"}}, "SELECT person_id, person_id, death_date, death_date + 1 FROM death WHERE death_type_concept_id = 38003569 AND death_date < DATE '2002-01-01'"),
    "DeviceExposure": ({"Quantity": {"Op": "!bt", "Value": 5.9, "Extent": 40}, "VisitType": [{"CONCEPT_ID": 9201}, {"CONCEPT_ID": 9203}]}, "SELECT t.person_id, device_exposure_id, device_exposure_start_date, device_exposure_end_date FROM device_exposure t JOIN visit_occurrence v ON v.visit_occurrence_id = t.visit_occurrence_id AND v.person_id = t.person_id WHERE NOT (quantity BETWEEN 5 AND 40) AND visit_concept_id IN (9201, 9203)"),
    "DoseEra": ({"DoseValue": {"Op": "gte", "Value": 4.99996}, "Unit": [{"CONCEPT_ID": 8576}]}, "SELECT person_id, dose_era_id, dose_era_start_date, dose_era_end_date FROM dose_era WHERE dose_value >= 5.0 AND unit_concept_id = 8576"),
    "DrugEra": ({"CodesetId": 1, "GapDays": {"Op": "eq", "Value": 0}, "EraStartDate": {"Op": "gte", "Value": "1997-01-01"}}, "SELECT person_id, drug_era_id, drug_era_start_date, drug_era_end_date FROM drug_era WHERE drug_concept_id % 2 = 0 AND drug_era_start_date >= DATE '1997-01-01'"),
    "DrugExposure": ({"CodesetId": 1, "DaysSupply": {"Op": "lte", "Value": 20}, "Refills": {"Op": "!eq", "Value": 2}, "OccurrenceEndDate": {"Op": "lt", "Value": "1999-01-01"}, "GenderCS": {"CodesetId": 3}, "LotNumber": {"Op": "startsWith", "Text": "LOT"}}, "SELECT t.person_id, drug_exposure_id, drug_exposure_start_date, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) FROM drug_exposure t JOIN person p ON p.person_id = t.person_id WHERE drug_concept_id % 2 = 0 AND days_supply <= 20 AND refills <> 2 AND drug_exposure_start_date < DATE '1999-01-01' AND gender_concept_id = 8507 AND lot_number LIKE 'LOT%'"),
    "Episode": ({"EpisodeNumber": {"Op": "gte", "Value": 2}}, "SELECT person_id, episode_id, episode_start_date, coalesce(episode_end_date, episode_start_date + 1) FROM episode WHERE episode_number >= 2"),
    "LocationRegion": ({}, "SELECT entity_id, h.location_id, start_date, coalesce(end_date, DATE '2099-12-31') FROM location_history h JOIN location l ON l.location_id = h.location_id WHERE domain_id = 'PERSON'"),
    "Measurement": ({"ValueAsNumber": {"Op": "bt", "Value": 1.5, "Extent": 60}, "RangeHighRatio": {"Op": "lt", "Value": 0.9}, "Abnormal": True, "OperatorCS": {"CodesetId": None, "IsExclusion": False}}, "SELECT person_id, measurement_id, measurement_date, measurement_date + 1 FROM measurement WHERE value_as_number BETWEEN 1.5 AND 60 AND value_as_number / nullif(range_high, 0) < 0.9 AND (value_as_number < range_low OR value_as_number > range_high OR value_as_concept_id IN (4155142, 4155143)) AND operator_concept_id IS NOT NULL"),
    "Observation": ({"ValueAsString": {"Op": "endsWith", "Text": "4"}, "Unit": [{"CONCEPT_ID": 8801}, {"CONCEPT_ID": 8802}]}, "SELECT person_id, observation_id, observation_date, observation_date + 1 FROM observation WHERE value_as_string LIKE '%4' AND unit_concept_id IN (8801, 8802)"),
    "ObservationPeriod": ({"PeriodLength": {"Op": "gt", "Value": 1000}, "UserDefinedPeriod": {"StartDate": "1996-01-01", "EndDate": "1996-12-31"}}, "SELECT person_id, observation_period_id, DATE '1996-01-01', DATE '1996-12-31' FROM observation_period WHERE observation_period_start_date <= DATE '1996-01-01' AND observation_period_end_date >= DATE '1996-12-31'"),
    "PayerPlanPeriod": ({"AgeAtEnd": {"Op": "bt", "Value": 20, "Extent": 50}}, "SELECT t.person_id, payer_plan_period_id, payer_plan_period_start_date, payer_plan_period_end_date FROM payer_plan_period t JOIN person p ON p.person_id = t.person_id WHERE year(payer_plan_period_end_date) - year_of_birth BETWEEN 20 AND 50"),
    "ProcedureOccurrence": ({"CodesetId": 2, "Modifier": [{"CONCEPT_ID": 1}], "ModifierExclude": True, "DateAdjustment": {"StartWith": "START_DATE", "StartOffset": -2, "EndWith": "START_DATE", "EndOffset": 5}}, "SELECT person_id, procedure_occurrence_id, procedure_date - 2, procedure_date + 5 FROM procedure_occurrence WHERE procedure_concept_id < 5005 AND modifier_concept_id <> 1"),
    "Specimen": ({"Quantity": {"Op": "lt", "Value": 50.00004}, "SpecimenType": [{"CONCEPT_ID": 32851}], "DateAdjustment": {"StartOffset": 9, "EndOffset": 9}}, "SELECT person_id, specimen_id, specimen_date, specimen_date + 1 FROM specimen WHERE quantity < 50.0 AND specimen_type_concept_id = 32851"),
    "VisitDetail": ({"Age": {"Op": "gt", "Value": 40}, "VisitDetailLength": {"Op": "gte", "Value": 2}}, "SELECT t.person_id, visit_detail_id, visit_detail_start_date, coalesce(visit_detail_end_date, visit_detail_start_date + 1) FROM visit_detail t JOIN person p ON p.person_id = t.person_id WHERE year(coalesce(visit_detail_end_date, visit_detail_start_date + 1)) - year_of_birth > 40 AND coalesce(visit_detail_end_date, visit_detail_start_date + 1) - visit_detail_start_date >= 2"),
    "VisitOccurrence": ({"PlaceOfService": [{"CONCEPT_ID": 8700}, {"CONCEPT_ID": 8701}], "VisitLength": {"Op": "lte", "Value": 5}}, "SELECT person_id, visit_occurrence_id, visit_start_date, coalesce(visit_end_date, visit_start_date + 1) FROM visit_occurrence v JOIN care_site c ON c.care_site_id = v.care_site_id WHERE place_of_service_concept_id IN (8700, 8701) AND coalesce(visit_end_date, visit_start_date + 1) - visit_start_date <= 5"),
}
_SETS = [_set(0, 3100), _set(1, 4100), _set(2, 5000, 5001, 5002, 5003, 5004), _set(3, 8507)]


def criterion_events(kind: str):
    def query(spark, sf_dir: str) -> DataFrame:
        cdm = Cdm(spark, sf_dir)
        rows = Evaluator(cdm, G.codesets(cdm, _SETS)).events(kind, EVENTS[kind][0])
        return rows.select("person_id", "event_id", F.col("start_date").cast("date"), F.col("end_date").cast("date"))

    return query


def custom_era_events(spark, sf_dir: str) -> DataFrame:
    """Drug and condition events of a person merged where they meet."""
    cdm = Cdm(spark, sf_dir)
    both = {"CustomEra": {"CriteriaList": [{"ConditionOccurrence": {"CodesetId": 0}}, {"DrugExposure": {"CodesetId": 1}}], "GapDays": 30}}
    builder = G.Builder(cdm, {"ConceptSets": _SETS})
    return builder.events(both).select("person_id", "event_id", "start_date", "end_date")


def negative_controls(spark, sf_dir: str) -> DataFrame:
    return G.negative_controls(Cdm(spark, sf_dir), [3001, 3007, 3100])


QUERIES = {
    "cohort_flagship": _rows(FLAGSHIP),
    "cohort_attrition": _rows(ATTRITION),
    "cohort_drug_era_exit": _rows(DRUG_ERA_EXIT),
    "cohort_additional_criteria": _rows(ADDITIONAL),
    "cohort_inclusion_masks": attrition_masks,
    "cohort_rule_statistics": attrition_rules,
    "cohort_summary_statistics": attrition_summary,
    "cohort_censor_statistics": attrition_censored,
    "cohort_inclusion_groups": attrition_groups,
    "cohort_stored_statistics": stored_statistics,
    "cohort_negative_controls": negative_controls,
    "criteria_custom_era": custom_era_events,
    **{f"criteria_{kind.lower()}": criterion_events(kind) for kind in SPECS},
}

_COND = "coalesce(condition_end_date, condition_start_date + 1)"
_PERIOD = "op.person_id = t.person_id AND t.{0} BETWEEN op.observation_period_start_date AND op.observation_period_end_date"


def _merged(spans: str, pad: int) -> str:
    """Eras of (person_id, s, e) by recursion over neighbours in order."""
    return f"""
        SELECT person_id, min(s) AS s, max(e) AS e FROM (
          SELECT person_id, s, e, sum(fresh) OVER (PARTITION BY person_id ORDER BY s, e, i) AS g FROM (
            SELECT person_id, s, e, i, CASE WHEN max(e) OVER (PARTITION BY person_id ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {pad} >= s THEN 0 ELSE 1 END AS fresh
            FROM (SELECT *, row_number() OVER (ORDER BY person_id, s, e) AS i FROM ({spans}) q0) q1) q2) q3 GROUP BY person_id, g"""


_OUT = "CAST(1 AS INTEGER) AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, e AS cohort_end_date"

_ATTRITION = f"""
    prim AS (
      SELECT t.person_id, row_number() OVER (PARTITION BY t.person_id ORDER BY condition_start_date, condition_occurrence_id) AS event_id, condition_start_date AS s, {_COND} AS e, op.observation_period_end_date AS oe, op.observation_period_start_date AS os
      FROM condition_occurrence t JOIN observation_period op ON {_PERIOD.format('condition_start_date')} WHERE condition_concept_id % 5 IN (0, 1)),
    masked AS (
      SELECT i.*, CASE WHEN EXISTS (SELECT 1 FROM drug_exposure d WHERE d.person_id = i.person_id AND d.drug_concept_id % 2 = 0 AND d.drug_exposure_start_date BETWEEN i.s AND i.s + 90 AND d.drug_exposure_start_date <= i.oe) THEN 1 ELSE 0 END
        + CASE WHEN NOT EXISTS (SELECT 1 FROM procedure_occurrence d WHERE d.person_id = i.person_id AND d.procedure_concept_id < 5005 AND d.procedure_date BETWEEN i.s AND i.oe) THEN 2 ELSE 0 END
        + CASE WHEN p.gender_concept_id = 8532 OR (SELECT count(*) FROM drug_exposure d WHERE d.person_id = i.person_id AND d.drug_concept_id % 2 = 0 AND d.drug_exposure_start_date BETWEEN i.s AND i.s + 365 AND d.drug_exposure_start_date <= i.oe) >= 2 THEN 4 ELSE 0 END AS mask
      FROM prim i JOIN person p ON p.person_id = i.person_id),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY bit_count(mask) DESC, CASE WHEN mask = 0 THEN 99 WHEN mask % 2 = 1 THEN 0 WHEN mask % 4 = 2 THEN 1 ELSE 2 END, s, event_id) AS rn FROM masked) z WHERE rn = 1),
    masks AS (SELECT CAST(0 AS INTEGER) AS mode_id, CAST(mask AS BIGINT) AS m, count(*) AS n FROM masked GROUP BY mask UNION ALL SELECT CAST(1 AS INTEGER), CAST(mask AS BIGINT), count(*) FROM best GROUP BY mask)"""
_ATTRITION_ERAS = _merged("SELECT person_id, s, least(e + 60, oe) AS e FROM masked WHERE mask = 7 AND least(e + 60, oe) >= s", 14)

ORACLE_SQL = {
    "cohort_flagship": with_prefix(f"""
        WITH prim AS (
          SELECT * FROM (SELECT t.person_id, condition_start_date AS s, op.observation_period_end_date AS oe, row_number() OVER (PARTITION BY t.person_id ORDER BY condition_start_date, condition_occurrence_id) AS rn
            FROM condition_occurrence t JOIN observation_period op ON {_PERIOD.format('condition_start_date')} WHERE condition_concept_id % 5 = 0 AND op.observation_period_start_date + 365 <= condition_start_date) x WHERE rn = 1)
        SELECT CAST(1 AS INTEGER) AS cohort_definition_id, person_id AS subject_id, s AS cohort_start_date, oe AS cohort_end_date FROM prim i
        WHERE EXISTS (SELECT 1 FROM drug_exposure d WHERE d.person_id = i.person_id AND d.drug_concept_id % 2 = 0 AND d.drug_exposure_start_date BETWEEN i.s AND i.s + 30 AND d.drug_exposure_start_date <= i.oe)"""),
    "cohort_attrition": with_prefix(f"WITH {_ATTRITION}, eras AS ({_ATTRITION_ERAS}) SELECT CAST(1 AS INTEGER) AS cohort_definition_id, person_id AS subject_id, greatest(s, DATE '1996-06-01') AS cohort_start_date, least(e, DATE '2000-12-31') AS cohort_end_date FROM eras WHERE greatest(s, DATE '1996-06-01') <= least(e, DATE '2000-12-31')"),
    "cohort_inclusion_masks": with_prefix(f"WITH {_ATTRITION} SELECT mode_id, m AS inclusion_rule_mask, n AS person_count FROM masks"),
    "cohort_rule_statistics": with_prefix(f"WITH {_ATTRITION} SELECT mode_id, CAST(r AS INTEGER) AS rule_sequence, CAST(sum(CASE WHEN (m >> CAST(r AS INTEGER)) & 1 = 1 THEN n ELSE 0 END) AS BIGINT) AS person_count, CAST(sum(CASE WHEN m = 7 - (1 << CAST(r AS INTEGER)) THEN n ELSE 0 END) AS BIGINT) AS gain_count, CAST(sum(n) AS BIGINT) AS person_total FROM masks CROSS JOIN range(3) g(r) GROUP BY mode_id, r"),
    "cohort_inclusion_groups": with_prefix(f"WITH {_ATTRITION} SELECT mode_id, CAST(m % 2 + m // 2 % 2 + m // 4 AS INTEGER) AS rules_met, CAST(m % 2 AS VARCHAR) || CAST(m // 2 % 2 AS VARCHAR) || CAST(m // 4 AS VARCHAR) AS name, n AS size FROM masks"),
    "cohort_stored_statistics": with_prefix(f"WITH {_ATTRITION} SELECT CAST(5 AS INTEGER) AS cohort_definition_id, mode_id, CAST(r AS INTEGER) AS rule_sequence, CASE r WHEN 0 THEN 'a drug within 90 days' WHEN 1 THEN 'no procedure in the period afterwards' ELSE 'women, or two drugs' END AS name, CAST(sum(CASE WHEN (m >> CAST(r AS INTEGER)) & 1 = 1 THEN n ELSE 0 END) AS BIGINT) AS person_count, CAST(sum(CASE WHEN m = 7 - (1 << CAST(r AS INTEGER)) THEN n ELSE 0 END) AS BIGINT) AS gain_count, CAST(sum(n) AS BIGINT) AS person_total FROM masks CROSS JOIN range(3) g(r) GROUP BY mode_id, r"),
    "cohort_summary_statistics": with_prefix(f"WITH {_ATTRITION} SELECT mode_id, CAST(sum(n) AS BIGINT) AS base_count, CAST(sum(CASE WHEN m = 7 THEN n ELSE 0 END) AS BIGINT) AS final_count FROM masks GROUP BY mode_id"),
    "cohort_censor_statistics": with_prefix(f"WITH {_ATTRITION}, eras AS ({_ATTRITION_ERAS}) SELECT count(*) AS lost_count FROM (SELECT DISTINCT person_id FROM eras EXCEPT SELECT person_id FROM eras WHERE greatest(s, DATE '1996-06-01') <= least(e, DATE '2000-12-31')) x"),
    "cohort_drug_era_exit": with_prefix(f"""
        WITH prim AS (
          SELECT t.person_id, row_number() OVER (PARTITION BY t.person_id ORDER BY drug_exposure_start_date, drug_exposure_id) AS event_id, drug_exposure_start_date AS s, op.observation_period_end_date AS oe
          FROM drug_exposure t JOIN observation_period op ON {_PERIOD.format('drug_exposure_start_date')} WHERE drug_concept_id % 2 = 0 AND op.observation_period_start_date + 30 <= drug_exposure_start_date),
        eras AS ({_merged("SELECT person_id, drug_exposure_start_date AS s, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) + 7 AS e FROM drug_exposure WHERE drug_concept_id % 2 = 0", 30)}),
        ends AS (
          SELECT person_id, event_id, s, oe AS c FROM prim
          UNION ALL SELECT p.person_id, p.event_id, p.s, r.e FROM prim p JOIN eras r ON r.person_id = p.person_id AND p.s BETWEEN r.s AND r.e
          UNION ALL SELECT p.person_id, p.event_id, p.s, min(condition_start_date) FROM prim p JOIN condition_occurrence x ON x.person_id = p.person_id AND x.condition_concept_id % 5 = 1 AND condition_start_date BETWEEN p.s AND p.oe GROUP BY ALL)
        SELECT {_OUT} FROM ({_merged("SELECT person_id, s, min(c) AS e FROM ends WHERE c >= s GROUP BY person_id, event_id, s", 0)}) f"""),
    "cohort_additional_criteria": with_prefix(f"""
        WITH cond AS (SELECT * FROM condition_occurrence WHERE condition_concept_id % 5 <> 0 AND condition_concept_id <> 3049),
        prim AS (
          SELECT t.person_id, row_number() OVER (PARTITION BY t.person_id ORDER BY condition_start_date, condition_occurrence_id) AS event_id, condition_start_date AS s, op.observation_period_end_date AS oe
          FROM cond t JOIN person p ON p.person_id = t.person_id JOIN observation_period op ON {_PERIOD.format('condition_start_date')}
          WHERE condition_start_date BETWEEN DATE '1995-06-01' AND DATE '2000-06-30' AND year(condition_start_date) - year_of_birth >= 30),
        flagged AS (
          SELECT i.*, EXISTS (SELECT 1 FROM drug_exposure d WHERE d.person_id = i.person_id AND drug_exposure_start_date BETWEEN i.s AND least(i.s + 60, i.oe)) AS f1,
                 (SELECT count(*) FROM cond d WHERE d.person_id = i.person_id AND d.condition_start_date BETWEEN i.s AND least(i.s + 365, i.oe)) >= 3 AS f2, TRUE AS f3 FROM prim i)
        SELECT {_OUT} FROM (SELECT person_id, s, oe AS e, row_number() OVER (PARTITION BY person_id ORDER BY s DESC, event_id) AS rn FROM flagged WHERE f1 OR f2 OR f3) z WHERE rn = 1"""),
    "cohort_negative_controls": with_prefix("""
        SELECT cohort_definition_id, subject_id, cohort_start_date, cohort_end_date FROM (
          SELECT ancestor_concept_id AS cohort_definition_id, person_id AS subject_id, condition_start_date AS cohort_start_date, coalesce(condition_end_date, condition_start_date) AS cohort_end_date,
                 row_number() OVER (PARTITION BY ancestor_concept_id, person_id ORDER BY condition_start_date, condition_occurrence_id) AS rn
          FROM condition_occurrence c JOIN concept_ancestor a ON a.descendant_concept_id = c.condition_concept_id WHERE ancestor_concept_id IN (3001, 3007, 3100)) x WHERE rn = 1"""),
    "criteria_custom_era": with_prefix(f"""
        WITH eras AS ({_merged(f"SELECT person_id, condition_start_date AS s, {_COND} AS e FROM condition_occurrence WHERE condition_concept_id % 5 = 0 UNION ALL SELECT person_id, drug_exposure_start_date, coalesce(drug_exposure_end_date, drug_exposure_start_date + days_supply, drug_exposure_start_date + 1) FROM drug_exposure WHERE drug_concept_id % 2 = 0", 0)})
        SELECT person_id, row_number() OVER (PARTITION BY person_id ORDER BY s, e) AS event_id, s AS start_date, e AS end_date FROM eras"""),
    **{f"criteria_{kind.lower()}": with_prefix(f"SELECT q.* FROM ({sql}) q(person_id, event_id, start_date, end_date)") for kind, (_, sql) in EVENTS.items()},
}
