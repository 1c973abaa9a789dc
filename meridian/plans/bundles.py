"""Report bundles: what one page shows, as frames by name, over the stored results of the analyses.

A bundle reads the two result tables (``results``, ``dist``), the concepts and the concept hierarchy;
nothing is computed from clinical tables here. Every part is a small frame, made only when it is read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from . import reports as R


class Source(NamedTuple):
    results: DataFrame
    dist: DataFrame
    concept: DataFrame
    hierarchy: DataFrame


Part = Callable[[Source], DataFrame]


def _share(analysis_id: int) -> Part:
    return lambda s: R.share_of_persons(s.results, analysis_id)


def _kinds(analysis_id: int) -> Part:
    return lambda s: R.first_kinds(s.results, s.concept, analysis_id)


def _lookup(analysis_id: int) -> Part:
    return lambda s: R.distribution_lookup(s.dist, s.concept, analysis_id)


def _extent(analysis_id: int, step: int = 1) -> Part:
    return lambda s: R.extent(s.results, analysis_id, step)


PAGES: dict[str, dict[str, Part]] = {
    "dashboard": {
        "summary": lambda s: R.population(s.results), "ageAtFirstObservation": _share(101), "gender": _kinds(2),
        "cumulativeObservation": lambda s: R.cumulative_share(s.results, 108), "observedByMonth": _share(110),
    },
    "person": {
        "summary": lambda s: R.population(s.results), "gender": _kinds(2), "race": _kinds(4), "ethnicity": _kinds(5),
        "yearOfBirth": lambda s: R.from_least(R.share_of_persons(s.results, 3)), "yearOfBirthStats": _extent(3),
    },
    "datadensity": {
        "conceptsPerPerson": lambda s: R.concepts_per_person(s.dist), "recordsPerPerson": lambda s: R.records_per_person(s.results), "totalRecords": lambda s: R.total_records(s.results),
    },
    "death": {
        "prevalenceByGenderAgeYear": lambda s: R.deaths_by_gender_age_year(s.results, s.concept), "prevalenceByMonth": lambda s: R.deaths_by_month(s.results),
        "deathByType": _kinds(505), "ageAtDeath": _lookup(506),
    },
    "observationperiod": {
        "ageAtFirst": _share(101), "observationLength": _share(108), "observationLengthStats": _extent(108, 30),
        "personsWithContinuousObservationsByYear": lambda s: R.from_least(R.share_of_persons(s.results, 109)), "personsWithContinuousObservationsByYearStats": _extent(109),
        "ageByGender": _lookup(104), "durationByGender": _lookup(106), "durationByAgeDecile": lambda s: R.by_decile(s.dist, 107),
        "cumulativeObservation": lambda s: R.cumulative_share(s.results, 108), "observedByMonth": _share(110), "observationPeriodsPerPerson": _share(113),
    },
}

#: A domain's drill-down: analyses by part. Parts of one kind have one pattern.
DRILLDOWNS: dict[str, dict[str, int]] = {
    "condition": {"ageAtFirstOccurrence": 406, "byType": 405, "prevalenceByGenderAgeYear": 404, "prevalenceByMonth": 402},
    "conditionera": {"ageAtFirstOccurrence": 1006, "lengthOfEra": 1007, "prevalenceByGenderAgeYear": 1004, "prevalenceByMonth": 1002},
    "drug": {"ageAtFirstOccurrence": 706, "byType": 705, "daysSupplyDistribution": 715, "frequencyDistribution": 791, "prevalenceByGenderAgeYear": 704, "prevalenceByMonth": 702, "quantityDistribution": 717, "refillsDistribution": 716},
    "drugera": {"ageAtFirstOccurrence": 906, "lengthOfEra": 907, "prevalenceByGenderAgeYear": 904, "prevalenceByMonth": 902},
    "measurement": {"ageAtFirstOccurrence": 1806, "byOperator": 1823, "byType": 1805, "byValueAsConcept": 1822, "frequencyDistribution": 1891, "lowerLimitDistribution": 1816, "measurementValueDistribution": 1815, "prevalenceByGenderAgeYear": 1804, "prevalenceByMonth": 1802, "recordsByUnit": 1807, "upperLimitDistribution": 1817, "valuesRelativeToNorm": 1818},
    "observation": {"ageAtFirstOccurrence": 806, "byQualifier": 823, "byType": 805, "byValueAsConcept": 822, "frequencyDistribution": 891, "prevalenceByGenderAgeYear": 804, "prevalenceByMonth": 802},
    "procedure": {"ageAtFirstOccurrence": 606, "byType": 605, "frequencyDistribution": 691, "prevalenceByGenderAgeYear": 604, "prevalenceByMonth": 602},
    "visit": {"ageAtFirstOccurrence": 206, "prevalenceByGenderAgeYear": 204, "prevalenceByMonth": 202, "visitDurationByType": 213},
}


def page(source: Source, name: str) -> dict[str, DataFrame]:
    return {part: make(source) for part, make in PAGES[name].items()}


def treemap(source: Source, domain: str) -> DataFrame:
    return R.treemap(source.results, source.dist, source.concept if domain == "visit" else source.hierarchy, domain)


def _part(s: Source, domain: str, part: str, number: int, concept_id: int | None) -> DataFrame:
    if domain == "condition" and part == "byType":
        return R.condition_types(s.results, s.concept, concept_id)
    if part == "prevalenceByGenderAgeYear":
        return R.prevalence_by_gender_age_year(s.results, s.concept, number, concept_id)
    if part == "prevalenceByMonth":
        return R.prevalence_by_month(s.results, number, concept_id)
    if part == "frequencyDistribution":
        return R.frequency(s.results, s.concept, number, concept_id)
    if part == "valuesRelativeToNorm":
        return R.values_to_norm(s.results, s.concept, concept_id)
    if part.startswith("by") or part == "recordsByUnit":
        return R.concept_kinds(s.results, s.concept, number, concept_id)
    return R.distribution_lookup(s.dist, s.concept, number, concept_id)


def drilldown(source: Source, domain: str, concept_id: int | None = None) -> dict[str, DataFrame]:
    """All parts of a domain's drill-down, for one concept or (the summary) for all."""
    return {part: _part(source, domain, part, number, concept_id) for part, number in DRILLDOWNS[domain].items()}


def records(rows: DataFrame) -> list[dict]:
    """A report's rows as dictionaries with names in camel case. Reports are small: one row per stratum."""
    def camel(name: str) -> str:
        first, *rest = name.lower().split("_")
        return first + "".join(x.capitalize() for x in rest)

    names = [camel(c) for c in rows.columns]
    return [dict(zip(names, r, strict=True)) for r in rows.collect()]
