"""Event criteria as data: which table a criterion reads, its dates and its filters. One evaluator serves all 18."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = ["person_id", "event_id", "start_date", "end_date", "visit_occurrence_id", "sort_date"]


@dataclass(frozen=True)
class Spec:
    """table, id, concept and dates; ``end`` is an expression over the table; filters map a field of the criterion to (kind, column)."""

    table: str
    id: str
    start: str
    end: str
    concept: str = ""
    source: str = ""  # field of the criterion | column
    visit: bool = True
    filters: dict[str, tuple[str, str]] = field(default_factory=dict)
    age: str = "start_date"
    first_by_id: bool = True


def _typed(name: str, column: str) -> dict[str, tuple[str, str]]:
    return {name: ("concepts", column), f"{name}CS": ("codeset", column)}


def _dates(start: str = "start_date", end: str | None = "end_date") -> dict[str, tuple[str, str]]:
    return {"OccurrenceStartDate": ("date", start)} | ({"OccurrenceEndDate": ("date", end)} if end else {})


_ERA = {"EraStartDate": ("date", "start_date"), "EraEndDate": ("date", "end_date"), "EraLength": ("days", ""), "AgeAtStart": ("age", "start_date"), "AgeAtEnd": ("age", "end_date")}
_PEOPLE = {"ProviderSpecialty": ("specialty", ""), "ProviderSpecialtyCS": ("specialty codeset", ""), "VisitType": ("visit", ""), "VisitTypeCS": ("visit codeset", "")}
_DEATH_DAY = "date_add(death_date, 1)"

SPECS: dict[str, Spec] = {
    "ConditionEra": Spec("condition_era", "condition_era_id", "condition_era_start_date", "condition_era_end_date", "condition_concept_id", visit=False, filters=_ERA | {"OccurrenceCount": ("int", "condition_occurrence_count")}),
    "ConditionOccurrence": Spec("condition_occurrence", "condition_occurrence_id", "condition_start_date", "coalesce(condition_end_date, date_add(condition_start_date, 1))", "condition_concept_id", "ConditionSourceConcept|condition_source_concept_id",
                                filters=_dates() | _typed("ConditionType", "condition_type_concept_id") | _typed("ConditionStatus", "condition_status_concept_id") | {"StopReason": ("text", "stop_reason")} | _PEOPLE),
    "Death": Spec("death", "person_id", "death_date", _DEATH_DAY, "cause_concept_id", "DeathSourceConcept|cause_source_concept_id", visit=False, filters=_dates(end=None) | _typed("DeathType", "death_type_concept_id")),
    "DeviceExposure": Spec("device_exposure", "device_exposure_id", "device_exposure_start_date", "coalesce(device_exposure_end_date, date_add(device_exposure_start_date, 1))", "device_concept_id", "DeviceSourceConcept|device_source_concept_id",
                           filters=_dates() | _typed("DeviceType", "device_type_concept_id") | {"Quantity": ("int", "quantity"), "UniqueDeviceId": ("text", "unique_device_id")} | _PEOPLE),
    "DoseEra": Spec("dose_era", "dose_era_id", "dose_era_start_date", "dose_era_end_date", "drug_concept_id", visit=False, filters=_ERA | _typed("Unit", "unit_concept_id") | {"DoseValue": ("decimal", "dose_value")}),
    "DrugEra": Spec("drug_era", "drug_era_id", "drug_era_start_date", "drug_era_end_date", "drug_concept_id", visit=False, filters=_ERA | {"OccurrenceCount": ("int", "drug_exposure_count"), "GapDays": ("int", "gap_days")}),
    # the end-date filter looks at the start date, as cohort definitions in use expect
    "DrugExposure": Spec("drug_exposure", "drug_exposure_id", "drug_exposure_start_date", "coalesce(drug_exposure_end_date, date_add(drug_exposure_start_date, days_supply), date_add(drug_exposure_start_date, 1))", "drug_concept_id", "DrugSourceConcept|drug_source_concept_id",
                         filters=_dates(end="start_date") | _typed("DrugType", "drug_type_concept_id") | _typed("RouteConcept", "route_concept_id") | {"Refills": ("int", "refills"), "Quantity": ("decimal", "quantity"), "DaysSupply": ("int", "days_supply"), "EffectiveDrugDose": ("decimal", "effective_drug_dose"), "LotNumber": ("text", "lot_number"), "StopReason": ("text", "stop_reason")} | _typed("DoseUnit", "dose_unit_concept_id") | _PEOPLE),
    "Episode": Spec("episode", "episode_id", "episode_start_date", "coalesce(episode_end_date, date_add(episode_start_date, 1))", "episode_concept_id", visit=False,
                    filters={"EpisodeStartDate": ("date", "start_date"), "EpisodeEndDate": ("date", "end_date"), "EpisodeNumber": ("int", "episode_number"), "EpisodeObjectConceptCS": ("codeset", "episode_object_concept_id"), "EpisodeTypeCS": ("codeset", "episode_type_concept_id")}),
    "LocationRegion": Spec("location_region", "location_id", "start_date_", "coalesce(end_date_, date '2099-12-31')", "region_concept_id", visit=False, filters={"StartDate": ("date", "start_date"), "EndDate": ("date", "end_date")}),
    "Measurement": Spec("measurement", "measurement_id", "measurement_date", "date_add(measurement_date, 1)", "measurement_concept_id", "MeasurementSourceConcept|measurement_source_concept_id",
                        filters=_dates() | _typed("MeasurementType", "measurement_type_concept_id") | _typed("Operator", "operator_concept_id") | _typed("ValueAsConcept", "value_as_concept_id") | _typed("Unit", "unit_concept_id")
                        | {"ValueAsNumber": ("decimal", "value_as_number"), "RangeLow": ("decimal", "range_low"), "RangeHigh": ("decimal", "range_high"), "RangeLowRatio": ("ratio", "range_low"), "RangeHighRatio": ("ratio", "range_high"), "Abnormal": ("abnormal", "")} | _PEOPLE),
    "Observation": Spec("observation", "observation_id", "observation_date", "date_add(observation_date, 1)", "observation_concept_id", "ObservationSourceConcept|observation_source_concept_id",
                        filters=_dates() | _typed("ObservationType", "observation_type_concept_id") | _typed("ValueAsConcept", "value_as_concept_id") | _typed("Qualifier", "qualifier_concept_id") | _typed("Unit", "unit_concept_id") | {"ValueAsNumber": ("decimal", "value_as_number"), "ValueAsString": ("text", "value_as_string")} | _PEOPLE),
    "ObservationPeriod": Spec("observation_period", "observation_period_id", "observation_period_start_date", "observation_period_end_date", visit=False,
                              filters={"PeriodStartDate": ("date", "start_date"), "PeriodEndDate": ("date", "end_date"), "PeriodLength": ("days", ""), "AgeAtStart": ("age", "start_date"), "AgeAtEnd": ("age", "end_date")} | _typed("PeriodType", "period_type_concept_id")),
    "PayerPlanPeriod": Spec("payer_plan_period", "payer_plan_period_id", "payer_plan_period_start_date", "payer_plan_period_end_date", visit=False,
                            filters={"PeriodStartDate": ("date", "start_date"), "PeriodEndDate": ("date", "end_date"), "PeriodLength": ("days", ""), "AgeAtStart": ("age", "start_date"), "AgeAtEnd": ("age", "end_date")}
                            | {n: ("id codeset", c) for n, c in (("PayerConcept", "payer_concept_id"), ("PlanConcept", "plan_concept_id"), ("SponsorConcept", "sponsor_concept_id"), ("StopReasonConcept", "stop_reason_concept_id"), ("PayerSourceConcept", "payer_source_concept_id"), ("PlanSourceConcept", "plan_source_concept_id"), ("SponsorSourceConcept", "sponsor_source_concept_id"), ("StopReasonSourceConcept", "stop_reason_source_concept_id"))}),
    "ProcedureOccurrence": Spec("procedure_occurrence", "procedure_occurrence_id", "procedure_date", "date_add(procedure_date, 1)", "procedure_concept_id", "ProcedureSourceConcept|procedure_source_concept_id",
                                filters=_dates() | _typed("ProcedureType", "procedure_type_concept_id") | _typed("Modifier", "modifier_concept_id") | {"Quantity": ("int", "quantity")} | _PEOPLE),
    "Specimen": Spec("specimen", "specimen_id", "specimen_date", "date_add(specimen_date, 1)", "specimen_concept_id", "SpecimenSourceConcept|specimen_source_concept_id", visit=False,
                     filters=_dates(end=None) | _typed("SpecimenType", "specimen_type_concept_id") | _typed("Unit", "unit_concept_id") | _typed("AnatomicSite", "anatomic_site_concept_id") | _typed("DiseaseStatus", "disease_status_concept_id") | {"Quantity": ("decimal", "quantity"), "SourceId": ("text", "specimen_source_id")}),
    "VisitDetail": Spec("visit_detail", "visit_detail_id", "visit_detail_start_date", "coalesce(visit_detail_end_date, date_add(visit_detail_start_date, 1))", "visit_detail_concept_id", "VisitDetailSourceConcept|visit_detail_source_concept_id", age="end_date",
                        filters={"VisitDetailStartDate": ("date", "start_date"), "VisitDetailEndDate": ("date", "end_date"), "VisitDetailLength": ("days", ""), "PlaceOfServiceCS": ("place codeset", ""), "PlaceOfServiceLocation": ("region", "visit_detail")} | _typed("VisitDetailType", "visit_detail_type_concept_id") | {k: v for k, v in _PEOPLE.items() if "Provider" in k}),
    "VisitOccurrence": Spec("visit_occurrence", "visit_occurrence_id", "visit_start_date", "coalesce(visit_end_date, date_add(visit_start_date, 1))", "visit_concept_id", "VisitSourceConcept|visit_source_concept_id",
                            filters=_dates() | _typed("VisitType", "visit_type_concept_id") | {"VisitLength": ("days", ""), "PlaceOfService": ("place", ""), "PlaceOfServiceCS": ("place codeset", ""), "PlaceOfServiceLocation": ("region", "visit")} | {k: v for k, v in _PEOPLE.items() if "Provider" in k}),
}

#: Fields that every criterion may have.
_COMMON = {"CodesetId", "First", "Age", "Gender", "GenderCS", "Race", "RaceCS", "Ethnicity", "EthnicityCS", "UserDefinedPeriod", "DateAdjustment", "CorrelatedCriteria"}


def unknown_fields(kind: str, c: dict) -> list[str]:
    """Fields of a criterion that mean nothing to it: a definition that has them must not run without them."""
    spec = SPECS[kind]
    known = _COMMON | set(spec.filters) | {f"{n}Exclude" for n, (how, _) in spec.filters.items() if how in ("concepts", "visit", "specialty", "place")} | {spec.source.split("|")[0]}
    return sorted(n for n, v in c.items() if n not in known and v is not None)


# --- leaf predicates ---


def compare(column: Column, op: str, value: Column, extent: Column | None) -> Column:
    if op in ("bt", "!bt"):
        inside = (column >= value) & (column <= extent)
        return inside if op == "bt" else ~inside
    table = {"lt": column < value, "lte": column <= value, "eq": column == value, "!eq": column != value, "gt": column > value, "gte": column >= value}
    if op not in table:
        raise ValueError(f"unknown comparison {op!r}")
    return table[op]


def whole_number(value: object) -> int:
    """Truncated towards zero, within 32 bits."""
    n = int(float(value or 0))
    if not -(1 << 31) <= n < 1 << 31:
        raise ValueError(f"{n} is not a 32-bit number")
    return n


def four_places(value: object) -> float:
    return float(Decimal(str(value or 0)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def number_range(column: Column, r: dict, exact: bool) -> Column:
    cast = (lambda v: F.lit(whole_number(v))) if exact else (lambda v: F.lit(four_places(v)))
    return compare(column, r.get("Op", ""), cast(r.get("Value")), cast(r["Extent"]) if r.get("Extent") is not None else cast(0))


def day(text: str) -> Column:
    y, m, d = [int(x) for x in text.split("-") if x][:3]
    return F.make_date(F.lit(y), F.lit(m), F.lit(d))


def date_range(column: Column, r: dict) -> Column:
    return compare(column, r.get("Op", ""), day(r["Value"]), day(r["Extent"]) if r.get("Extent") else None)


def text_filter(column: Column, r: dict) -> Column:
    op, text = r.get("Op", ""), r.get("Text") or ""
    kind = op.removeprefix("!")
    patterns = {"startsWith": f"{text}%", "endsWith": f"%{text}", "contains": f"%{text}%"}
    if kind not in patterns:
        raise ValueError(f"unknown text comparison {op!r}")
    found = column.like(patterns[kind])
    return ~found if op.startswith("!") else found


def concept_list(column: Column, concepts: list[dict], exclude: bool = False) -> Column | None:
    ids = [c["CONCEPT_ID"] for c in concepts or []]
    if not ids:
        return None
    return ~column.isin(ids) if exclude else column.isin(ids)


class Evaluator:
    """Turns a criterion into events. ``codesets`` (codeset_id, concept_id) holds the resolved concept sets."""

    def __init__(self, cdm, codesets: DataFrame):
        self.cdm, self.codesets = cdm, codesets

    def in_codeset(self, rows: DataFrame, column: str, codeset_id: int, exclude: bool = False) -> DataFrame:
        ids = self.codesets.filter(F.col("codeset_id") == codeset_id).select(F.col("concept_id").alias("__c"))
        if exclude:
            return rows.filter(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("__c"), "left_anti")
        return rows.join(ids, F.col(column) == F.col("__c"), "left_semi")

    def selection(self, rows: DataFrame, column: str, chosen: dict) -> DataFrame:
        """A concept-set selection: in or not in a codeset; without one, whether the column is filled."""
        exclude = bool(chosen.get("IsExclusion"))
        if chosen.get("CodesetId") is None:
            return rows.filter(F.col(column).isNull() if exclude else F.col(column).isNotNull())
        return self.in_codeset(rows, column, chosen["CodesetId"], exclude)

    def events(self, kind: str, c: dict) -> DataFrame:
        """person_id, event_id, start_date, end_date, visit_occurrence_id, sort_date of a criterion (without its correlated criteria)."""
        if kind not in SPECS:
            raise ValueError(f"unknown criterion {kind!r}")
        spec = SPECS[kind]
        if strange := unknown_fields(kind, c):
            raise ValueError(f"{kind} has no field {', '.join(strange)}")
        rows = self._region() if kind == "LocationRegion" else self.cdm[spec.table]
        if spec.concept and c.get("CodesetId") is not None:
            rows = self.in_codeset(rows, spec.concept, c["CodesetId"])
        if spec.source:
            name, column = spec.source.split("|")
            if c.get(name) is not None:
                rows = self.in_codeset(rows, column, c[name])
        rows = rows.withColumns({"event_id": F.col(spec.id).cast("long"), "start_date": F.expr(spec.start), "end_date": F.expr(spec.end)})
        if "visit_occurrence_id" not in rows.columns:
            rows = rows.withColumn("visit_occurrence_id", F.lit(None).cast("long"))
        # the first occurrence is found among rows of the concept set, before any other filter
        if c.get("First"):
            rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("person_id").orderBy("start_date", "event_id"))).filter("__n = 1").drop("__n")
        rows = rows.withColumn("sort_date", F.col("start_date"))
        if (adjust := c.get("DateAdjustment")) and kind not in ("Specimen", "LocationRegion"):
            ends = {"start_date": F.col("start_date"), "end_date": F.col("end_date")}
            base = lambda side: ends["start_date" if str(adjust.get(f"{side}With", f"{side.upper()}_DATE")).upper() == "START_DATE" else "end_date"]
            moved = {"start_date": F.date_add(base("Start"), whole_number(adjust.get("StartOffset"))), "end_date": F.date_add(base("End"), whole_number(adjust.get("EndOffset")))}
            rows = rows.withColumns(moved | {"sort_date": moved["start_date"]}).filter("end_date >= start_date")
        if period := c.get("UserDefinedPeriod"):
            for side in ("StartDate", "EndDate"):
                if period.get(side):
                    rows = rows.filter((F.col("start_date") <= day(period[side])) & (F.col("end_date") >= day(period[side])))
        rows = self.filtered(rows, spec, c)
        if period:  # replaces the dates that come out; the filters above see the row's own
            rows = rows.withColumns({n: day(period[s]) for n, s in (("start_date", "StartDate"), ("end_date", "EndDate")) if period.get(s)})
        return rows.select(*[F.col(x) for x in EVENT], *[F.col(x) for x in self.countable(rows)])

    @staticmethod
    def countable(rows: DataFrame) -> list[str]:
        """Further columns that distinct counts may use."""
        return [x for x in rows.columns if x.endswith("_concept_id") or x in ("value_as_number", "quantity", "days_supply", "refills", "provider_id", "range_low", "range_high", "gap_days", "condition_occurrence_count", "drug_exposure_count", "visit_detail_id")]

    def _region(self) -> DataFrame:
        places = self.cdm["location"].select("location_id", "region_concept_id")
        return self.cdm["location_history"].filter("domain_id = 'PERSON'").withColumnsRenamed({"entity_id": "person_id", "start_date": "start_date_", "end_date": "end_date_"}).join(places, "location_id")

    def filtered(self, rows: DataFrame, spec: Spec, c: dict) -> DataFrame:
        for name, (kind, column) in spec.filters.items():
            wanted = c.get(name)
            if wanted is None or (wanted is False) or wanted == []:
                continue
            col = F.col(column) if column and column in rows.columns else F.lit(None)
            if kind == "date":
                rows = rows.filter(date_range(col, wanted))
            elif kind == "int":
                rows = rows.filter(number_range(col, wanted, True))
            elif kind == "decimal":
                rows = rows.filter(number_range(col, wanted, False))
            elif kind == "ratio":
                rows = rows.filter(number_range(F.try_divide(F.col("value_as_number"), F.nullif(col, F.lit(0.0))), wanted, False))
            elif kind == "days":
                rows = rows.filter(number_range(F.datediff("end_date", "start_date"), wanted, True))
            elif kind == "abnormal":
                rows = rows.filter((F.col("value_as_number") < F.col("range_low")) | (F.col("value_as_number") > F.col("range_high")) | F.col("value_as_concept_id").isin(4155142, 4155143))
            elif kind == "text":
                rows = rows.filter(text_filter(col, wanted))
            elif kind == "concepts":
                if (keep := concept_list(col, wanted, bool(c.get(f"{name}Exclude")))) is not None:
                    rows = rows.filter(keep)
            elif kind == "codeset":
                rows = self.selection(rows, column, wanted)
            elif kind == "id codeset":
                rows = self.in_codeset(rows, column, wanted)
            elif kind == "region":
                rows = self.in_region(rows, column, wanted)
            elif kind == "age":
                rows = self.of_age(rows, wanted, column)
            else:
                rows = self.through(rows, kind, wanted, bool(c.get(f"{name}Exclude")))
        return self.of_person(rows, c, spec.age)

    def in_region(self, rows: DataFrame, table: str, codeset: int) -> DataFrame:
        """Events at a care site that lay in a region of the codeset during all of the event; once for each such stay."""
        stays = self.cdm["location_history"].filter("domain_id = 'CARE_SITE'").join(self.cdm["location"].select("location_id", "region_concept_id"), "location_id")
        stays = self.in_codeset(stays, "region_concept_id", codeset).select(F.col("entity_id").alias("__site"), F.col("start_date").alias("__from"), F.coalesce("end_date", F.lit("2099-12-31").cast("date")).alias("__to"))
        start, end = F.col(f"{table}_start_date"), F.col(f"{table}_end_date")
        return rows.join(stays, (F.col("care_site_id") == F.col("__site")) & (start >= F.col("__from")) & (end <= F.col("__to"))).drop("__site", "__from", "__to")

    def of_age(self, rows: DataFrame, wanted: dict, at: str) -> DataFrame:
        people = self.cdm["person"].select(F.col("person_id").alias("__p"), "year_of_birth")
        return rows.join(people, F.col("person_id") == F.col("__p")).filter(number_range(F.year(at) - F.col("year_of_birth"), wanted, True)).drop("__p", "year_of_birth")

    def of_person(self, rows: DataFrame, c: dict, at: str = "start_date") -> DataFrame:
        if c.get("Age"):
            rows = self.of_age(rows, c["Age"], at)
        for name, column in (("Gender", "gender_concept_id"), ("Race", "race_concept_id"), ("Ethnicity", "ethnicity_concept_id")):
            people = self.cdm["person"]
            if (keep := concept_list(F.col(column), c.get(name))) is not None:
                rows = rows.join(people.filter(keep).select("person_id"), "person_id", "left_semi")
            if c.get(f"{name}CS"):
                rows = rows.join(self.selection(people, column, c[f"{name}CS"]).select("person_id"), "person_id", "left_semi")
        return rows

    def through(self, rows: DataFrame, kind: str, wanted, exclude: bool) -> DataFrame:
        """Filters on the visit, the provider or the place of service."""
        what, _, by_codeset = kind.partition(" ")
        table, key, column, how = {
            "visit": ("visit_occurrence", ["person_id", "visit_occurrence_id"], "visit_concept_id", "inner"),
            "specialty": ("provider", ["provider_id"], "specialty_concept_id", "left"),
            "place": ("care_site", ["care_site_id"], "place_of_service_concept_id", "inner"),
        }[what]
        other = self.cdm[table].select(*key, F.col(column).alias("__x"))
        rows = rows.join(other, key, how)
        if by_codeset:
            return self.selection(rows, "__x", wanted).drop("__x")
        keep = concept_list(F.col("__x"), wanted, exclude)
        return (rows if keep is None else rows.filter(keep)).drop("__x")
