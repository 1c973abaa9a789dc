"""The numbered analyses as data: which table, keys, condition and family each one has.

Keys and values are SQL expressions that Spark and DuckDB read alike; ``DAYS(a, b)`` stands for the
days from a to b. ``op`` joins the table to the observation periods that hold the row's start date
(a row in two overlapping periods counts twice). Keys may use person columns where ``person`` is set.
"""

from __future__ import annotations

from typing import NamedTuple


class Analysis(NamedTuple):
    id: int
    family: str
    table: str
    keys: tuple[str, ...] = ()
    where: str = ""
    op: bool = False
    person: bool = False
    value: str = ""  # distributions
    entity: str = "person_id"  # what COUNTD counts
    extra: tuple[str, ...] = ()
    valued: bool = False  # distributions: rows without a value are left out


class Domain(NamedTuple):
    base: int
    table: str
    id: str
    concept: str
    start: str
    end: str
    type: str
    source: str
    absent: tuple[int, ...]  # offsets that this domain has not


DOMAINS = {
    "visit": Domain(200, "visit_occurrence", "visit_occurrence_id", "visit_concept_id", "visit_start_date", "visit_end_date", "", "visit_source_concept_id", (5, 12, 13, 24, 91)),
    "condition": Domain(400, "condition_occurrence", "condition_occurrence_id", "condition_concept_id", "condition_start_date", "condition_end_date", "condition_type_concept_id", "condition_source_concept_id", (91,)),
    "procedure": Domain(600, "procedure_occurrence", "procedure_occurrence_id", "procedure_concept_id", "procedure_date", "", "procedure_type_concept_id", "procedure_source_concept_id", ()),
    "drug": Domain(700, "drug_exposure", "drug_exposure_id", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date", "drug_type_concept_id", "drug_source_concept_id", ()),
    "observation": Domain(800, "observation", "observation_id", "observation_concept_id", "observation_date", "", "observation_type_concept_id", "observation_source_concept_id", ()),
    "drug_era": Domain(900, "drug_era", "drug_era_id", "drug_concept_id", "drug_era_start_date", "drug_era_end_date", "", "", (5, 9, 12, 13, 24, 25, 91)),
    "condition_era": Domain(1000, "condition_era", "condition_era_id", "condition_concept_id", "condition_era_start_date", "condition_era_end_date", "", "", (5, 9, 12, 13, 24, 25, 91)),
    "visit_detail": Domain(1300, "visit_detail", "visit_detail_id", "visit_detail_concept_id", "visit_detail_start_date", "visit_detail_end_date", "", "visit_detail_source_concept_id", (5, 9, 12, 13, 24, 91)),
    "measurement": Domain(1800, "measurement", "measurement_id", "measurement_concept_id", "measurement_date", "", "measurement_type_concept_id", "measurement_source_concept_id", ()),
    "device": Domain(2100, "device_exposure", "device_exposure_id", "device_concept_id", "device_exposure_start_date", "device_exposure_end_date", "device_type_concept_id", "device_source_concept_id", (3, 9, 11, 12, 13, 24)),
}


def month(date: str) -> str:
    return f"year({date}) * 100 + month({date})"


def decile(date: str) -> str:
    return f"CAST(floor((year({date}) - year_of_birth) / 10) AS BIGINT)"


def _domain(d: Domain) -> list[Analysis]:
    b, t, c, s = d.base, d.table, d.concept, d.start
    out = [
        Analysis(b, "COUNTD", t, (c,), op=True),
        Analysis(b + 1, "COUNT", t, (c,), op=True),
        Analysis(b + 2, "COUNTD", t, (c, month(s)), op=True),
        Analysis(b + 3, "DIST", t, op=True, value=c, extra=("distinct per person",)),
        Analysis(b + 4, "COUNTD", t, (c, f"year({s})", "gender_concept_id", decile(s)), op=True, person=True),
        Analysis(b + 5, "COUNT", t, (c, d.type), op=True),
        Analysis(b + 6, "DIST", t, (c, "gender_concept_id"), op=True, value=s, extra=("age at first",)),
        Analysis(b + 9, "ORPHAN", t, extra=("person", "person_id")),
        Analysis(b + 10, "OUTSIDE", t),
        Analysis(b + 12, "ORPHAN", t, extra=("provider", "provider_id")),
        Analysis(b + 13, "ORPHAN", t, extra=("visit_occurrence", "visit_occurrence_id")),
        Analysis(b + 20, "COUNT", t, (month(s),), op=True),
        Analysis(b + 24, "TOPK", t, (c,)),
        Analysis(b + 25, "COUNT", t, (d.source,), op=True),
        Analysis(b + 30, "COUNT", t, op=True),
        Analysis(b + 31, "PROP", t, extra=("persons",)),
        Analysis(b + 32, "PROP", t, extra=("records",)),
        Analysis(b + 91, "ATLEAST", t, (c,), op=True),
    ]
    if d.end:
        out.append(Analysis(b + 11, "COUNT", t, where=f"{d.end} < {s}"))
    gone = {b + x for x in d.absent}
    return [a for a in out if a.id not in gone]


_OP_DAYS = "DAYS(observation_period_start_date, observation_period_end_date)"
_PAYER_DAYS = "DAYS(payer_plan_period_start_date, payer_plan_period_end_date)"
_FIRST = ("first period",)
_VALUED = "value_as_number IS NOT NULL OR value_as_concept_id <> 0"
_RANGED = "value_as_number IS NOT NULL AND unit_concept_id IS NOT NULL AND range_low IS NOT NULL AND range_high IS NOT NULL"

#: What doesn't follow from the domains.
SPECIAL = [
    Analysis(0, "SOURCE", "person"),
    Analysis(1, "COUNTD", "person"),
    Analysis(2, "COUNTD", "person", ("gender_concept_id",)),
    Analysis(3, "COUNTD", "person", ("year_of_birth",)),
    Analysis(4, "COUNTD", "person", ("race_concept_id",)),
    Analysis(5, "COUNTD", "person", ("ethnicity_concept_id",)),
    Analysis(7, "ORPHAN", "person", extra=("provider", "provider_id")),
    Analysis(8, "ORPHAN", "person", extra=("location", "location_id")),
    Analysis(9, "ORPHAN", "person", extra=("care_site", "care_site_id")),
    Analysis(10, "COUNTD", "person", ("year_of_birth", "gender_concept_id")),
    Analysis(11, "COUNTD", "person", ("year_of_birth", "gender_concept_id"), extra=("anti", "death")),
    Analysis(12, "COUNTD", "person", ("race_concept_id", "ethnicity_concept_id")),
    Analysis(101, "COUNT", "observation_period", ("year(observation_period_start_date) - year_of_birth",), person=True, extra=_FIRST),
    Analysis(102, "COUNT", "observation_period", ("gender_concept_id", "year(observation_period_start_date) - year_of_birth"), person=True, extra=_FIRST),
    Analysis(103, "DIST", "observation_period", person=True, value="year(observation_period_start_date) - year_of_birth", extra=_FIRST),
    Analysis(104, "DIST", "observation_period", ("gender_concept_id",), person=True, value="year(observation_period_start_date) - year_of_birth", extra=_FIRST),
    Analysis(105, "DIST", "observation_period", value=_OP_DAYS, extra=_FIRST),
    Analysis(106, "DIST", "observation_period", ("gender_concept_id",), person=True, value=_OP_DAYS, extra=_FIRST),
    Analysis(107, "DIST", "observation_period", (decile("observation_period_start_date"),), person=True, value=_OP_DAYS, extra=_FIRST),
    Analysis(108, "COUNTD", "observation_period", (f"CAST(floor({_OP_DAYS} / 30) AS BIGINT)",), extra=_FIRST),
    Analysis(109, "CALENDAR", "observation_period", extra=("year", "covered")),
    Analysis(110, "CALENDAR", "observation_period", extra=("month", "covered", "started")),
    Analysis(111, "COUNTD", "observation_period", (month("observation_period_start_date"),)),
    Analysis(112, "COUNTD", "observation_period", (month("observation_period_end_date"),)),
    Analysis(113, "PERIODS", "observation_period"),
    Analysis(114, "COUNTD", "observation_period", where="year_of_birth > year(observation_period_start_date)", person=True, extra=_FIRST),
    Analysis(115, "COUNTD", "observation_period", where="observation_period_end_date < observation_period_start_date"),
    Analysis(116, "CALENDAR", "observation_period", extra=("year", "touched", "started", "by person")),
    Analysis(117, "CALENDAR", "observation_period", extra=("month", "touched")),
    Analysis(118, "ORPHAN", "observation_period", extra=("person", "person_id")),
    Analysis(119, "COUNT", "observation_period", ("period_type_concept_id",)),
    Analysis(207, "ORPHAN", "visit_occurrence", extra=("person", "person_id")),
    Analysis(209, "ORPHAN", "visit_occurrence", extra=("care_site", "care_site_id")),
    Analysis(212, "COUNTD", "visit_occurrence", ("year(visit_start_date)", "gender_concept_id", decile("visit_start_date")), person=True),
    Analysis(213, "DIST", "visit_occurrence", ("visit_concept_id",), op=True, value="DAYS(visit_start_date, visit_end_date)", extra=("ends inside",)),
    Analysis(221, "COUNTD", "visit_occurrence", ("year(visit_start_date)",), op=True),
    Analysis(226, "UNIONCOUNT", "visit_occurrence", extra=("visit_occurrence_id", "visit_concept_id")),
    Analysis(300, "COUNTD", "provider", entity="provider_id"),
    Analysis(301, "COUNTD", "provider", ("specialty_concept_id",), entity="provider_id"),
    Analysis(303, "COUNT", "provider", ("specialty_concept_id", "visit_concept_id"), extra=("join", "visit_occurrence", "provider_id")),
    Analysis(325, "COUNT", "provider", ("specialty_source_concept_id",)),
    Analysis(414, "COUNT", "condition_occurrence", ("condition_status_concept_id",), op=True),
    Analysis(415, "COUNT", "condition_occurrence", ("condition_type_concept_id",), op=True),
    Analysis(416, "COUNT", "condition_occurrence", ("condition_status_concept_id", "condition_type_concept_id"), op=True),
    Analysis(500, "COUNTD", "death", ("cause_concept_id",), op=True),
    Analysis(501, "COUNT", "death", ("cause_concept_id",), op=True),
    Analysis(502, "COUNTD", "death", (month("death_date"),), op=True),
    Analysis(504, "COUNTD", "death", ("year(death_date)", "gender_concept_id", decile("death_date")), op=True, person=True),
    Analysis(505, "COUNT", "death", ("death_type_concept_id",), op=True),
    Analysis(506, "DIST", "death", ("gender_concept_id",), op=True, value="death_date", extra=("age at earliest",)),
    Analysis(509, "ORPHAN", "death", extra=("person", "person_id")),
    Analysis(510, "OUTSIDE", "death"),
    Analysis(511, "DIST9999", "death", value="last", extra=("condition_occurrence", "condition_start_date")),
    Analysis(512, "DIST", "death", value="last", extra=("drug_exposure", "drug_exposure_start_date")),
    Analysis(513, "DIST", "death", value="last", extra=("visit_occurrence", "visit_start_date")),
    Analysis(514, "DIST", "death", value="last", extra=("procedure_occurrence", "procedure_date")),
    Analysis(515, "DIST", "death", value="last", extra=("observation", "observation_date")),
    Analysis(525, "COUNT", "death", ("cause_source_concept_id",)),
    Analysis(530, "COUNT", "death", op=True),
    Analysis(531, "PROP", "death", extra=("persons",)),
    Analysis(532, "PROP", "death", extra=("records",)),
    Analysis(715, "DIST", "drug_exposure", ("drug_concept_id",), op=True, value="days_supply", valued=True),
    Analysis(716, "DIST", "drug_exposure", ("drug_concept_id",), op=True, value="refills", valued=True),
    Analysis(717, "DIST", "drug_exposure", ("drug_concept_id",), op=True, value="quantity", valued=True),
    Analysis(807, "COUNT", "observation", ("observation_concept_id", "unit_concept_id"), op=True),
    Analysis(814, "COUNT", "observation", where="value_as_number IS NULL AND value_as_string IS NULL AND value_as_concept_id IS NULL"),
    Analysis(815, "DIST", "observation", ("observation_concept_id", "unit_concept_id"), where="unit_concept_id IS NOT NULL AND value_as_number IS NOT NULL", op=True, value="value_as_number"),
    Analysis(822, "COUNT", "observation", ("observation_concept_id", "value_as_concept_id"), op=True),
    Analysis(823, "COUNT", "observation", ("observation_concept_id", "qualifier_concept_id"), op=True),
    Analysis(826, "COUNT", "observation", ("value_as_concept_id",), op=True),
    Analysis(827, "COUNT", "observation", ("unit_concept_id",), op=True),
    Analysis(907, "DIST", "drug_era", ("drug_concept_id",), op=True, value="DAYS(drug_era_start_date, drug_era_end_date)"),
    Analysis(908, "ORPHAN", "drug_era", extra=("person", "person_id")),
    Analysis(1007, "DIST", "condition_era", ("condition_concept_id",), op=True, value="DAYS(condition_era_start_date, condition_era_end_date)"),
    Analysis(1008, "ORPHAN", "condition_era", extra=("person", "person_id")),
    Analysis(1100, "COUNTD", "person", ("substr(zip, 1, 3)", "location_id"), where="zip IS NOT NULL", extra=("join", "location", "location_id")),
    Analysis(1101, "COUNTD", "person", ("state", "location_id"), where="state IS NOT NULL", extra=("join", "location", "location_id")),
    Analysis(1102, "COUNTD", "care_site", ("substr(zip, 1, 3)", "location_id"), where="zip IS NOT NULL", entity="care_site_id", extra=("join", "location", "location_id")),
    Analysis(1103, "COUNTD", "care_site", ("state", "location_id"), where="state IS NOT NULL", entity="care_site_id", extra=("join", "location", "location_id")),
    Analysis(1200, "COUNT", "person", ("place_of_service_concept_id",), where="place_of_service_concept_id IS NOT NULL", extra=("join", "care_site", "care_site_id")),
    Analysis(1201, "COUNT", "visit_occurrence", ("place_of_service_concept_id",), where="place_of_service_concept_id IS NOT NULL", extra=("join", "care_site", "care_site_id")),
    Analysis(1202, "COUNT", "care_site", ("place_of_service_concept_id",), where="place_of_service_concept_id IS NOT NULL"),
    Analysis(1203, "COUNT", "visit_occurrence", ("discharge_to_concept_id",), where="discharge_to_concept_id <> 0", op=True),
    Analysis(1307, "ORPHAN", "visit_detail", extra=("person", "person_id")),
    Analysis(1309, "ORPHAN", "visit_detail", extra=("care_site", "care_site_id")),
    Analysis(1312, "COUNTD", "visit_detail", ("year(visit_detail_start_date)", "gender_concept_id", decile("visit_detail_start_date")), op=True, person=True),
    Analysis(1313, "DIST", "visit_detail", ("visit_detail_concept_id",), op=True, value="DAYS(visit_detail_start_date, visit_detail_end_date)"),
    Analysis(1321, "COUNTD", "visit_detail", ("year(visit_detail_start_date)",), op=True),
    Analysis(1326, "UNIONCOUNT", "visit_detail", extra=("visit_occurrence_id", "visit_detail_concept_id")),
    Analysis(1406, "DIST", "payer_plan_period", ("gender_concept_id",), person=True, value=_PAYER_DAYS, extra=_FIRST),
    Analysis(1407, "DIST", "payer_plan_period", (decile("payer_plan_period_start_date"),), person=True, value=_PAYER_DAYS, extra=_FIRST),
    Analysis(1408, "COUNTD", "payer_plan_period", (f"CAST(floor({_PAYER_DAYS} / 30) AS BIGINT)",), extra=_FIRST),
    Analysis(1409, "CALENDAR", "payer_plan_period", extra=("year", "touched", "started")),
    Analysis(1410, "CALENDAR", "payer_plan_period", extra=("month", "covered", "started")),
    Analysis(1411, "COUNTD", "payer_plan_period", ("make_date(year(payer_plan_period_start_date), month(payer_plan_period_start_date), 1)",)),
    Analysis(1412, "COUNTD", "payer_plan_period", ("make_date(year(payer_plan_period_start_date), month(payer_plan_period_start_date), 1)",)),
    Analysis(1413, "PERIODS", "payer_plan_period"),
    Analysis(1414, "COUNTD", "payer_plan_period", where="year_of_birth > year(payer_plan_period_start_date)", person=True, extra=_FIRST),
    Analysis(1415, "COUNTD", "payer_plan_period", where="payer_plan_period_end_date < payer_plan_period_start_date"),
    Analysis(1425, "COUNT", "payer_plan_period", ("payer_source_concept_id",)),
    *[Analysis(1502 + i, "DIST", "cost", ("drug_concept_id",), where="cost_domain_id = 'Drug'", value=v, valued=True, extra=("join on", "drug_exposure", "cost_event_id", "drug_exposure_id"))
      for i, v in enumerate(("paid_patient_copay", "paid_patient_coinsurance", "paid_patient_deductible", "paid_by_payer", "paid_by_primary", "paid_by_patient", "total_paid", "paid_ingredient_cost", "paid_dispensing_fee", "total_cost"))],
    *[Analysis(1602 + i, "DIST", "cost", ("procedure_concept_id",), where="cost_domain_id = 'Procedure'", value=v, valued=True, extra=("join on", "procedure_occurrence", "cost_event_id", "procedure_occurrence_id"))
      for i, v in enumerate(("paid_patient_copay", "paid_patient_coinsurance", "paid_patient_deductible", "paid_by_payer", "paid_by_primary", "paid_by_patient", "total_paid"))],
    Analysis(1610, "COUNT", "cost", ("revenue_code_concept_id",), where="revenue_code_concept_id IS NOT NULL AND cost_domain_id = 'Procedure'"),
    Analysis(1807, "COUNT", "measurement", ("measurement_concept_id", "unit_concept_id"), op=True),
    Analysis(1811, "COUNT", "measurement", where=_VALUED, op=True),
    Analysis(1814, "COUNT", "measurement", where="value_as_number IS NULL AND (value_as_concept_id IS NULL OR value_as_concept_id = 0)", op=True),
    Analysis(1815, "DIST", "measurement", ("measurement_concept_id", "unit_concept_id"), where="unit_concept_id IS NOT NULL AND value_as_number IS NOT NULL", op=True, value="value_as_number"),
    Analysis(1816, "DIST", "measurement", ("measurement_concept_id", "unit_concept_id"), where=_RANGED, op=True, value="range_low"),
    Analysis(1817, "DIST", "measurement", ("measurement_concept_id", "unit_concept_id"), where=_RANGED, op=True, value="range_high"),
    Analysis(1818, "COUNT", "measurement", ("measurement_concept_id", "unit_concept_id", "CASE WHEN value_as_number < range_low THEN 'Below Range Low' WHEN value_as_number >= range_low AND value_as_number <= range_high THEN 'Within Range' WHEN value_as_number > range_high THEN 'Above Range High' ELSE 'Other' END"), where=_RANGED, op=True),
    Analysis(1819, "COUNT", "measurement", ("measurement_concept_id",), where=_VALUED, op=True),
    Analysis(1821, "COUNT", "measurement", where="value_as_number IS NULL"),
    Analysis(1822, "COUNT", "measurement", ("measurement_concept_id", "value_as_concept_id"), op=True),
    Analysis(1823, "COUNT", "measurement", ("measurement_concept_id", "operator_concept_id"), op=True),
    Analysis(1826, "COUNT", "measurement", ("value_as_concept_id",), op=True),
    Analysis(1827, "COUNT", "measurement", ("unit_concept_id",), op=True),
    Analysis(1833, "NOVALUE", "measurement", ("measurement_concept_id",), op=True, extra=(_VALUED,)),
    Analysis(1900, "UNMAPPED", "measurement"),
    Analysis(2000, "DOMAINS", "person", extra=("condition", "drug")),
    Analysis(2001, "DOMAINS", "person", extra=("condition", "procedure")),
    Analysis(2002, "DOMAINS", "person", extra=("measurement", "condition", "drug")),
    Analysis(2003, "COUNTD", "visit_occurrence", op=True),
    Analysis(2004, "OVERLAP", "person"),
    Analysis(2200, "COUNTD", "note", ("note_type_concept_id",)),
    Analysis(2201, "COUNT", "note", ("note_type_concept_id",)),
]

ANALYSES: dict[int, Analysis] = {a.id: a for a in [*(a for d in DOMAINS.values() for a in _domain(d)), *SPECIAL]}
ANALYSES[230] = Analysis(230, "ALL", "visit_occurrence")
#: The start date that ties a table's rows to observation periods.
START = {d.table: d.start for d in DOMAINS.values()} | {"death": "death_date"}
END = {d.table: d.end for d in DOMAINS.values()}
#: The columns of the 1900 report, a table's source values and the concepts that they are mapped to.
MAPPED = [
    ("measurement", "measurement_source_value", "measurement_concept_id"), ("measurement", "unit_source_value", "unit_concept_id"),
    ("procedure_occurrence", "procedure_source_value", "procedure_concept_id"), ("procedure_occurrence", "modifier_source_value", "modifier_concept_id"),
    ("drug_exposure", "drug_source_value", "drug_concept_id"), ("drug_exposure", "route_source_value", "route_concept_id"),
    ("condition_occurrence", "condition_source_value", "condition_concept_id"), ("condition_occurrence", "condition_status_source_value", "condition_status_concept_id"),
    ("observation", "observation_source_value", "observation_concept_id"), ("observation", "unit_source_value", "unit_concept_id"), ("observation", "qualifier_source_value", "qualifier_concept_id"),
    ("payer_plan_period", "payer_source_value", "payer_concept_id"), ("payer_plan_period", "plan_source_value", "plan_concept_id"), ("payer_plan_period", "sponsor_source_value", "sponsor_concept_id"), ("payer_plan_period", "stop_reason_source_value", "stop_reason_concept_id"),
    ("provider", "specialty_source_value", "specialty_concept_id"), ("provider", "gender_source_value", "gender_concept_id"),
    ("person", "gender_source_value", "gender_concept_id"), ("person", "race_source_value", "race_concept_id"), ("person", "ethnicity_source_value", "ethnicity_concept_id"),
    ("specimen", "specimen_source_value", "specimen_concept_id"), ("specimen", "unit_source_value", "unit_concept_id"), ("specimen", "anatomic_site_source_value", "anatomic_site_concept_id"), ("specimen", "disease_status_source_value", "disease_status_concept_id"),
    ("visit_detail", "visit_detail_source_value", "visit_detail_concept_id"), ("visit_detail", "admitted_from_source_value", "admitted_from_concept_id"), ("visit_detail", "discharged_to_source_value", "discharged_to_concept_id"), ("visit_detail", "admitting_source_value", "admitting_source_concept_id"), ("visit_detail", "discharge_to_source_value", "discharge_to_concept_id"),
    ("visit_occurrence", "visit_source_value", "visit_concept_id"), ("visit_occurrence", "admitted_from_source_value", "admitted_from_concept_id"), ("visit_occurrence", "discharged_to_source_value", "discharged_to_concept_id"), ("visit_occurrence", "admitting_source_value", "admitting_source_concept_id"), ("visit_occurrence", "discharge_to_source_value", "discharge_to_concept_id"),
    ("device_exposure", "device_source_value", "device_concept_id"), ("death", "cause_source_value", "cause_concept_id"),
]


def section(a: Analysis) -> str:
    """The registered query that an analysis belongs to."""
    shape = "dist" if a.family.startswith("DIST") else "counts"
    return f"achilles_{a.table}_{shape}"
