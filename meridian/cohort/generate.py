"""Cohort definitions (JSON) to cohort rows: entry events, inclusion rules, exits, eras, attrition statistics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import inside_period, merge_eras
from ..operators.vocabulary import codesets
from ..sources import storage
from ..sources.scratch import materialize
from .criteria import SPECS, Evaluator, date_range, day, whole_number

INDEX = ["person_id", "event_id", "start_date", "end_date", "visit_occurrence_id", "op_start_date", "op_end_date"]


def _limit(value: dict | None) -> str:
    return str((value or {}).get("Type") or "").upper()


@dataclass
class Cohort:
    """rows (subject_id, cohort_start_date, cohort_end_date); events before limits with their rule masks; number of rules; the definition's counts as lazy frames."""

    rows: DataFrame
    qualified: DataFrame
    rule_names: list[str] = field(default_factory=list)
    unclipped: DataFrame | None = None


class Builder:
    def __init__(self, cdm, definition: dict | str):
        self.cdm = cdm
        self.definition = json.loads(definition) if isinstance(definition, str) else definition
        self.codesets = materialize(codesets(cdm, self.definition.get("ConceptSets") or []).repartition(1))  # small: ids of the definition's concepts
        self.evaluate = Evaluator(cdm, self.codesets)

    # --- events ---

    def events(self, wrapped: dict) -> DataFrame:
        """Events of a one-key criterion object, restricted by the group that correlates with them."""
        ((kind, c),) = wrapped.items()
        if kind == "CustomEra":
            return self.custom_era(c)
        rows = self.evaluate.events(kind, c or {})
        group = (c or {}).get("CorrelatedCriteria")
        if group and not _empty(group):
            index = inside_period(rows, self.cdm["observation_period"], "start_date", keep=True)
            keep = self.group(index.select(*INDEX).distinct(), group)
            rows = rows.join(keep.select("person_id", "event_id").distinct(), ["person_id", "event_id"], "left_semi")
        return rows

    def custom_era(self, c: dict) -> DataFrame:
        """Events of several criteria merged where they meet. Gap days don't widen the merging; ids count within a person."""
        parts = [self.events(w).select("person_id", "start_date", "end_date") for w in c.get("CriteriaList") or []]
        eras = merge_eras(reduce(DataFrame.unionByName, parts), ["person_id"], "start_date", "end_date", whole_number(c.get("GapDays")), {"n": F.count("*")}, pad=False)
        order = Window.partitionBy("person_id").orderBy("start_date", "end_date")
        rows = eras.withColumns({"event_id": F.row_number().over(order).cast("long"), "visit_occurrence_id": F.lit(None).cast("long"), "sort_date": F.col("start_date")})
        return rows.filter("event_id = 1") if c.get("First") else rows

    def primary(self) -> DataFrame:
        """Entry events with enough observation around them, numbered per person."""
        p = self.definition["PrimaryCriteria"]
        columns = ["person_id", "event_id", "start_date", "end_date", "visit_occurrence_id", "sort_date"]
        events = reduce(DataFrame.unionByName, [self.events(w).select(*columns) for w in p["CriteriaList"]])
        window = p.get("ObservationWindow") or {}
        rows = inside_period(events, self.cdm["observation_period"], "start_date", keep=True)
        rows = rows.filter((F.date_add("op_start_date", whole_number(window.get("PriorDays"))) <= F.col("start_date")) & (F.date_add("start_date", whole_number(window.get("PostDays"))) <= F.col("op_end_date")))
        limit = _limit(p.get("PrimaryCriteriaLimit"))
        if not limit:
            raise ValueError("the primary criteria need a limit")
        rows = rows.withColumn("ordinal", F.row_number().over(_by_date("sort_date", limit)))
        if limit != "ALL":
            rows = rows.filter("ordinal = 1")
        return rows.withColumn("event_id", F.col("ordinal").cast("long")).select(*INDEX)

    # --- groups: each child is a column of flags over the index events ---

    def group(self, index: DataFrame, g: dict) -> DataFrame:
        """Index events that fulfil a group."""
        if _empty(g):
            return index
        key = ["person_id", "event_id"]
        flagged, flags = index, []
        children = [("criteria", x) for x in g.get("CriteriaList") or []] + [("people", x) for x in g.get("DemographicCriteriaList") or []] + [("group", x) for x in g.get("Groups") or [] if not _empty(x)]
        for i, (kind, child) in enumerate(children):
            found = {"criteria": self.correlated, "people": self.demographic, "group": self.group}[kind](index, child)
            flagged = flagged.join(found.select(*key).distinct().withColumn(f"__f{i}", F.lit(1)), key, "left")
            flags.append(F.coalesce(f"__f{i}", F.lit(0)))
        total = reduce(lambda a, b: a + b, flags)
        kind, n = str(g.get("Type") or "").upper(), whole_number(g.get("Count"))
        wanted = {"ALL": total == len(flags), "ANY": total > 0, "AT_LEAST": total >= n, "AT_MOST": total <= n}
        if kind not in wanted:
            raise ValueError(f"unknown kind of group {g.get('Type')!r}")
        return flagged.filter(wanted[kind]).select(*index.columns)

    def demographic(self, index: DataFrame, d: dict) -> DataFrame:
        rows = self.evaluate.of_person(index, d)
        for name, column in (("OccurrenceStartDate", "start_date"), ("OccurrenceEndDate", "end_date")):
            if d.get(name):
                rows = rows.filter(date_range(F.col(column), d[name]))
        return rows

    def correlated(self, index: DataFrame, c: dict) -> DataFrame:
        """Index events with the wanted number of events in a window around them."""
        events = self.events(c["Criteria"])
        occurrence = c.get("Occurrence") or {"Type": 2, "Count": 1}
        more = [x for x in events.columns if x not in ("person_id", "event_id", "start_date", "end_date", "visit_occurrence_id", "sort_date")]
        a = events.select("person_id", F.col("event_id").alias("a_id"), F.col("start_date").alias("a_start"), F.col("end_date").alias("a_end"), F.col("visit_occurrence_id").alias("a_visit"), *[F.col(x).alias(f"a_{x}") for x in more])
        pairs = index.join(a, "person_id")
        if not c.get("IgnoreObservationPeriod"):
            pairs = pairs.filter((F.col("a_start") >= F.col("op_start_date")) & (F.col("a_start") <= F.col("op_end_date")))
        for name, at_end in (("StartWindow", False), ("EndWindow", True)):
            if w := c.get(name):
                pairs = pairs.filter(_window(w, at_end, bool(c.get("IgnoreObservationPeriod"))))
        if c.get("RestrictVisit"):
            pairs = pairs.filter(F.col("a_visit") == F.col("visit_occurrence_id"))
        key = ["person_id", "event_id"]
        what = F.col("a_id")
        if occurrence.get("IsDistinct"):
            what = _counted_column(c["Criteria"], str(occurrence.get("CountColumn") or "DOMAIN_CONCEPT").upper(), set(pairs.columns))
            counted = pairs.groupBy(*key).agg(F.countDistinct(what).alias("n"))
        else:
            counted = pairs.groupBy(*key).agg(F.count(what).alias("n"))
        kind, n = whole_number(occurrence.get("Type")), whole_number(occurrence.get("Count"))
        if kind == 1 or n == 0:  # no event at all may qualify
            counted = index.select(*key).distinct().join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        fits = {0: F.col("n") == n, 1: F.col("n") <= n, 2: F.col("n") >= n}[kind]
        return index.join(counted.filter(fits).select(*key), key, "left_semi")

    # --- exits ---

    def exits(self, events: DataFrame) -> DataFrame:
        """(person_id, event_id, start_date, end_date): the earliest of the strategy's end and the censoring events."""
        strategy = self.definition.get("EndStrategy") or {}
        ends = events.select("person_id", "event_id", "start_date", F.col("op_end_date").alias("candidate"))
        if d := strategy.get("DateOffset"):
            field_ = "start_date" if str(d.get("DateField", "StartDate")).upper().startswith("START") else "end_date"
            moved = F.date_add(F.col(field_), whole_number(d.get("Offset")))
            ends = events.select("person_id", "event_id", "start_date", F.when(moved > F.col("op_end_date"), F.col("op_end_date")).otherwise(moved).alias("candidate"))
        elif d := strategy.get("CustomEra"):
            eras = self.drug_eras(events, d)
            inside = events.join(eras, "person_id").filter((F.col("start_date") >= F.col("era_start")) & (F.col("start_date") <= F.col("era_end")))
            ends = ends.unionByName(inside.select("person_id", "event_id", "start_date", F.col("era_end").alias("candidate")))
        for c in self.definition.get("CensoringCriteria") or []:
            seen = self.events(c).select("person_id", F.col("start_date").alias("c_start"))
            inside = events.join(seen, "person_id").filter((F.col("c_start") >= F.col("start_date")) & (F.col("c_start") <= F.col("op_end_date")))
            ends = ends.unionByName(inside.groupBy("person_id", "event_id", "start_date").agg(F.min("c_start").alias("candidate")))
        return ends.filter(F.col("candidate") >= F.col("start_date")).groupBy("person_id", "event_id", "start_date").agg(F.min("candidate").alias("end_date"))

    def drug_eras(self, events: DataFrame, d: dict) -> DataFrame:
        drugs = self.cdm["drug_exposure"].join(events.select("person_id").distinct(), "person_id", "left_semi")
        wanted = whole_number(d.get("DrugCodesetId"))
        both = self.evaluate.in_codeset(drugs, "drug_concept_id", wanted).unionByName(self.evaluate.in_codeset(drugs, "drug_source_concept_id", wanted))
        start = F.col("drug_exposure_start_date")
        end = F.date_add(start, whole_number(d["DaysSupplyOverride"])) if d.get("DaysSupplyOverride") else F.expr(SPECS["DrugExposure"].end)
        gap, offset = whole_number(d.get("GapDays")), whole_number(d.get("Offset"))
        spans = both.select("person_id", start.alias("era_start"), F.date_add(end, offset).alias("era_end"))
        return merge_eras(spans, ["person_id"], "era_start", "era_end", gap)

    # --- the whole ---

    def build(self) -> Cohort:
        d = self.definition
        events = materialize(self.primary())  # every rule reads them
        additional = d.get("AdditionalCriteria")
        if additional:
            events = self.group(events, additional)
            if (limit := _limit(d.get("QualifiedLimit"))) and limit != "ALL":
                events = events.withColumn("__n", F.row_number().over(_by_date("start_date", limit))).filter("__n = 1").drop("__n")
        rules = d.get("InclusionRules") or []
        key = ["person_id", "event_id"]
        mask: Column = F.lit(0).cast("long")
        masked = events
        for i, rule in enumerate(rules):
            passed = self.group(events, rule.get("expression") or {}).select(*key).distinct().withColumn(f"__r{i}", F.lit(1 << i).cast("long"))
            masked = masked.join(passed, key, "left")
            mask = mask + F.coalesce(f"__r{i}", F.lit(0).cast("long"))
        masked = masked.withColumn("mask", mask).select(*events.columns, "mask")
        if rules:
            masked = materialize(masked)
        included = masked.filter(F.col("mask") == (1 << len(rules)) - 1) if rules else masked
        limit = _limit(d.get("ExpressionLimit"))
        if limit and limit != "ALL":
            included = included.withColumn("__n", F.row_number().over(_by_date("start_date", limit))).filter("__n = 1").drop("__n")
        spans = self.exits(included).select("person_id", "start_date", "end_date")
        pad = whole_number((d.get("CollapseSettings") or {}).get("EraPad"))
        eras = merge_eras(spans, ["person_id"], "start_date", "end_date", pad)
        rows = clipped = eras.select(F.col("person_id").alias("subject_id"), F.col("start_date").alias("cohort_start_date"), F.col("end_date").alias("cohort_end_date"))
        if w := d.get("CensorWindow"):
            if w.get("StartDate"):
                clipped = clipped.withColumn("cohort_start_date", F.greatest("cohort_start_date", day(w["StartDate"])))
            if w.get("EndDate"):
                clipped = clipped.withColumn("cohort_end_date", F.least("cohort_end_date", day(w["EndDate"])))
            clipped = clipped.filter("cohort_start_date <= cohort_end_date")
        return Cohort(clipped, masked, [r.get("name") or "" for r in rules], rows)


def _empty(g: dict) -> bool:
    return not (g.get("CriteriaList") or g.get("DemographicCriteriaList") or g.get("Groups"))


def _by_date(column: str, limit: str):
    first = F.col(column).desc() if limit == "LAST" else F.col(column).asc()
    return Window.partitionBy("person_id").orderBy(first, "event_id")


def _counted_column(criteria: dict, name: str, columns: set[str]) -> Column:
    """What a distinct count counts; an error where the criterion has no such column."""
    (kind,) = [k for k in criteria if k in SPECS or k == "CustomEra"]
    source = SPECS[kind].source.split("|")[-1] if kind in SPECS else ""
    if name == "DURATION":
        return F.datediff("a_end", "a_start")
    column = {
        "START_DATE": "a_start", "END_DATE": "a_end", "VISIT_ID": "a_visit", "DOMAIN_CONCEPT": f"a_{_domain_concept(criteria)}", "DOMAIN_SOURCE_CONCEPT": f"a_{source}", "UNIT": "a_unit_concept_id",
        "ERA_OCCURRENCES": "a_condition_occurrence_count" if kind == "ConditionEra" else "a_drug_exposure_count",
    }.get(name, f"a_{name.lower()}")
    if column not in columns:
        raise ValueError(f"{kind} has no column to count by {name}")
    return F.col(column)


def _domain_concept(wrapped: dict) -> str:
    ((kind, _),) = wrapped.items()
    return SPECS[kind].concept


def _window(w: dict, at_end: bool, ignore: bool) -> Column:
    """The event's date against bounds around the index date; an open bound is the observation period's (or none, if that is ignored)."""
    index = F.col("end_date") if w.get("UseIndexEnd") else F.col("start_date")
    use_end = w.get("UseEventEnd")
    event = F.col("a_end") if (use_end if use_end is not None else at_end) else F.col("a_start")

    def bound(side: dict) -> Column | None:
        coeff = whole_number(side.get("Coeff"))
        if side.get("Days") is not None:
            return F.date_add(index, coeff * whole_number(side["Days"]))
        return None if ignore else F.col("op_start_date" if coeff == -1 else "op_end_date")

    fits = F.lit(True)
    if (low := bound(w["Start"])) is not None:
        fits = fits & (event >= low)
    if (high := bound(w["End"])) is not None:
        fits = fits & (event <= high)
    return fits


def generate(cdm, definition: dict | str, cohort_id: int = 1) -> DataFrame:
    rows = Builder(cdm, definition).build().rows
    return rows.select(F.lit(cohort_id).alias("cohort_definition_id"), "subject_id", "cohort_start_date", "cohort_end_date")


# --- attrition ---


def best_events(qualified: DataFrame) -> DataFrame:
    """One event per person: most rules, then the lowest rule met, then the earliest."""
    low = F.when(F.col("mask") == 0, F.lit(1 << 62)).otherwise(F.col("mask").bitwiseAND(-F.col("mask")))
    order = Window.partitionBy("person_id").orderBy(F.desc(F.bit_count("mask")), low, "start_date", "event_id")
    return qualified.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def inclusion_results(cohort: Cohort) -> DataFrame:
    """(mode_id, inclusion_rule_mask, person_count): all events, and the best event of each person."""
    modes = [cohort.qualified.withColumn("mode_id", F.lit(0)), best_events(cohort.qualified).withColumn("mode_id", F.lit(1))]
    return reduce(DataFrame.unionByName, modes).groupBy("mode_id", F.col("mask").alias("inclusion_rule_mask")).agg(F.count("*").alias("person_count"))


def rule_statistics(cdm, cohort: Cohort) -> DataFrame:
    """Per mode and rule: how many satisfy it, how many fail it alone, and the total."""
    n = len(cohort.rule_names)
    masks = inclusion_results(cohort)
    rules = cdm.spark.createDataFrame([(i, 1 << i, (1 << n) - 1 - (1 << i)) for i in range(n)], "rule_sequence int, bit long, others long")
    pairs = masks.join(F.broadcast(rules))  # masks meet a few rules
    has = F.col("inclusion_rule_mask").bitwiseAND(F.col("bit")) == F.col("bit")
    return pairs.groupBy("mode_id", "rule_sequence").agg(
        F.sum(F.when(has, F.col("person_count")).otherwise(0)).alias("person_count"),
        F.sum(F.when(F.col("inclusion_rule_mask") == F.col("others"), F.col("person_count")).otherwise(0)).alias("gain_count"), F.sum("person_count").alias("person_total"),
    )


def summary_statistics(cohort: Cohort) -> DataFrame:
    full = (1 << len(cohort.rule_names)) - 1
    return inclusion_results(cohort).groupBy("mode_id").agg(F.sum("person_count").alias("base_count"), F.sum(F.when(F.col("inclusion_rule_mask") == full, F.col("person_count")).otherwise(0)).alias("final_count"))


def censor_statistics(cohort: Cohort) -> DataFrame:
    """Persons that the censor window loses."""
    lost = cohort.unclipped.select("subject_id").distinct().join(cohort.rows.select("subject_id").distinct(), "subject_id", "left_anti")
    return lost.agg(F.count("*").alias("lost_count"))


def inclusion_groups(cohort: Cohort) -> DataFrame:
    """(mode_id, rules_met, name, size): what events or persons met, as one 0 or 1 for each rule in order, by how many rules they met."""
    bit = [F.when(F.col("inclusion_rule_mask").bitwiseAND(F.lit(1 << i)) != 0, "1").otherwise("0") for i in range(len(cohort.rule_names))]
    return inclusion_results(cohort).select("mode_id", F.bit_count("inclusion_rule_mask").alias("rules_met"), F.concat(F.lit(""), *bit).alias("name"), F.col("person_count").alias("size"))


def inclusion_report(cdm, cohort: Cohort, mode: int = 0) -> dict:
    """The report of a generated cohort: its summary, each rule's shares, and the masks as a tree, most rules first.

    What reaches the driver is one row per rule and per mask that occurs. Without events all counts are 0.
    """
    def share(n: int, d: int) -> str:
        return f"{100.0 * n / d:.2f}%" if d else "0.00%"

    in_mode = F.col("mode_id") == mode
    total = summary_statistics(cohort).filter(in_mode).first()
    base, final = (total.base_count, total.final_count) if total else (0, 0)
    stats = {r.rule_sequence: r for r in rule_statistics(cdm, cohort).filter(in_mode).collect()}
    rules = []
    for i, name in enumerate(cohort.rule_names):
        met, of = (stats[i].person_count, stats[i].person_total) if i in stats else (0, 0)
        rules.append({"id": i, "name": name, "countSatisfying": met, "percentSatisfying": share(met, of), "percentExcluded": share(of - met, of)})
    groups: dict[int, list[dict]] = {}
    for r in inclusion_groups(cohort).filter(in_mode).orderBy("name").collect():
        groups.setdefault(r.rules_met, []).append({"name": r.name, "size": r.size})
    return {
        "summary": {"baseCount": base, "finalCount": final, "lostCount": censor_statistics(cohort).first().lost_count, "percentMatched": share(final, base)},
        "inclusionRuleStats": rules,
        "treemapData": {"name": "Everyone", "children": [{"name": f"Group {n}", "children": groups[n]} for n in sorted(groups, reverse=True)]},
    }


def store(cdm, definition: dict | str, path: str, cohort_id: int = 1) -> Cohort:
    """Generates a cohort and replaces its rows, its rules and all their statistics in the result tables below ``path``."""
    cohort = Builder(cdm, definition).build()
    storage.init_results(cdm.spark, path)
    rules = [(i, name, None) for i, name in enumerate(cohort.rule_names)]
    of = {"cohort_definition_id": cohort_id}
    storage.upsert(cohort.rows, path, "cohort", **of)
    storage.upsert(cdm.spark.createDataFrame(rules, "rule_sequence int, name string, description string"), path, "cohort_inclusion", **of)
    storage.upsert(censor_statistics(cohort), path, "cohort_censor_stats", **of)
    made = {"cohort_inclusion_result": inclusion_results(cohort), "cohort_inclusion_stats": rule_statistics(cdm, cohort), "cohort_summary_stats": summary_statistics(cohort)}
    for table, rows in made.items():
        for mode in (0, 1):
            storage.upsert(rows.filter(F.col("mode_id") == mode), path, table, **of, mode_id=mode)
    return cohort


def negative_controls(cdm, concept_ids: list[int], first: bool = True) -> DataFrame:
    """Outcome cohorts of single concepts with their descendants: first or all occurrences of conditions."""
    below = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id").isin(concept_ids)).select(F.col("ancestor_concept_id").alias("cohort_definition_id"), F.col("descendant_concept_id").alias("condition_concept_id"))
    rows = cdm["condition_occurrence"].join(below, "condition_concept_id").select("cohort_definition_id", F.col("person_id").alias("subject_id"), F.col("condition_start_date").alias("cohort_start_date"), F.coalesce("condition_end_date", "condition_start_date").alias("cohort_end_date"), F.col("condition_occurrence_id").alias("i"))
    if first:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("cohort_definition_id", "subject_id").orderBy("cohort_start_date", "i"))).filter("n = 1").drop("n")
    return rows.drop("i")
