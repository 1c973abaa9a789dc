"""DuckDB SQL of analyses with definitions of their own, by number and without the engine's registry: table, keys and conditions are written out here."""

from __future__ import annotations


def _within(table: str, start: str) -> str:
    """Rows of a table, once for each observation period that holds their start."""
    return f"{table} t JOIN observation_period op ON op.person_id = t.person_id AND t.{start} BETWEEN op.observation_period_start_date AND op.observation_period_end_date"


def _last(table: str, start: str) -> str:
    """Days from a death to the person's last event of a table inside observation."""
    return f"SELECT CAST(m - death_date AS BIGINT) AS v FROM death JOIN (SELECT t.person_id, max(t.{start}) AS m FROM {_within(table, start)} GROUP BY ALL) l USING (person_id)"


def _cost(domain: str, table: str, key: str, concept: str, column: str) -> str:
    return f"SELECT e.{concept} AS k0, c.{column} AS v FROM cost c JOIN {table} e ON c.cost_event_id = e.{key} WHERE c.cost_domain_id = '{domain}' AND c.{column} IS NOT NULL"


_PAID = ("paid_patient_copay", "paid_patient_coinsurance", "paid_patient_deductible", "paid_by_payer", "paid_by_primary", "paid_by_patient", "total_paid", "paid_ingredient_cost", "paid_dispensing_fee", "total_cost")

#: Values of distributions: a query with v and, where there are strata, k0; and how many strata.
VALUES: dict[int, tuple[str, int]] = {
    213: ("SELECT t.visit_concept_id AS k0, CAST(t.visit_end_date - t.visit_start_date AS BIGINT) AS v FROM visit_occurrence t JOIN observation_period op ON op.person_id = t.person_id AND t.visit_start_date >= op.observation_period_start_date AND coalesce(t.visit_end_date, t.visit_start_date) <= op.observation_period_end_date", 1),
    506: (f"SELECT gender_concept_id AS k0, y - year_of_birth AS v FROM person JOIN (SELECT t.person_id, min(year(t.death_date)) AS y FROM {_within('death', 'death_date')} GROUP BY ALL) d USING (person_id)", 1),
    511: (_last("condition_occurrence", "condition_start_date"), 0),
    512: (_last("drug_exposure", "drug_exposure_start_date"), 0),
    513: (_last("visit_occurrence", "visit_start_date"), 0),
    514: (_last("procedure_occurrence", "procedure_date"), 0),
    515: (_last("observation", "observation_date"), 0),
    **{i: (f"SELECT t.drug_concept_id AS k0, t.{c} AS v FROM {_within('drug_exposure', 'drug_exposure_start_date')} WHERE t.{c} IS NOT NULL", 1) for i, c in ((715, "days_supply"), (716, "refills"), (717, "quantity"))},
    1313: (f"SELECT t.visit_detail_concept_id AS k0, CAST(t.visit_detail_end_date - t.visit_detail_start_date AS BIGINT) AS v FROM {_within('visit_detail', 'visit_detail_start_date')}", 1),
    **{1502 + i: (_cost("Drug", "drug_exposure", "drug_exposure_id", "drug_concept_id", c), 1) for i, c in enumerate(_PAID)},
    **{1602 + i: (_cost("Procedure", "procedure_occurrence", "procedure_occurrence_id", "procedure_concept_id", c), 1) for i, c in enumerate(_PAID[:7])},
}


def _rows(number: int, strata: list[str], count: str, body: str) -> str:
    cells = ", ".join(f"CAST({s} AS VARCHAR) AS stratum_{i}" for i, s in enumerate([*strata, *["NULL"] * (5 - len(strata))], 1))
    return f"SELECT CAST({number} AS INTEGER) AS analysis_id, {cells}, CAST({count} AS BIGINT) AS count_value FROM {body}"


def _share(n: str, d: str) -> str:
    return f"CAST(round(CAST({n} AS DOUBLE) / {d}, 6) AS DECIMAL(12, 6))"


def _pairs(number: int, table: str, concept: str) -> str:
    both = f"SELECT l.person_id AS p, l.{concept} AS a, r.{concept} AS b FROM {table} l JOIN {table} r ON l.person_id = r.person_id WHERE l.{concept} <> 0 AND r.{concept} <> 0 AND l.{concept} <> r.{concept}"
    counted = f"SELECT a, b, count(DISTINCT p) AS people, count(*) AS cases FROM ({both}) z GROUP BY a, b"
    return _rows(number, ["a", "b", "place", "people", "cases"], "people", f"(SELECT *, row_number() OVER (PARTITION BY a ORDER BY people DESC, cases DESC, b) AS place FROM ({counted}) c) x WHERE place <= 10")


def _units(number: int, table: str, unit: str, whole: bool, keys: list[str] | None = None) -> str:
    """Persons by the years or months in which some period starts and that their own periods touch, or cover whole."""
    s, e = f"t.{table}_start_date", f"t.{table}_end_date"
    starts = f"SELECT DISTINCT CAST(date_trunc('{unit}', {table}_start_date) AS DATE) AS u FROM {table}"
    last = "last_day(u)" if unit == "month" else "u + INTERVAL 1 YEAR - INTERVAL 1 DAY"
    fits = f"{s} <= u AND {e} >= {last}" if whole else f"date_trunc('{unit}', {s}) <= u AND date_trunc('{unit}', {e}) >= u"
    named = "year(u)" if unit == "year" else "year(u) * 100 + month(u)"
    strata = [named, *(keys or [])]
    return _rows(number, strata, "count(DISTINCT t.person_id)", f"{table} t JOIN person p ON p.person_id = t.person_id JOIN ({starts}) u ON {fits} GROUP BY {', '.join(strata)}")


def _combinations() -> str:
    """The 127 sets of domains; the last digit stands for observations, then procedures, death, measurements, devices, drugs, conditions."""
    tables = ["observation", "procedure_occurrence", "death", "measurement", "device_exposure", "drug_exposure", "condition_occurrence"]
    flags = ", ".join(f"bool_or(d = {i}) AS d{i}" for i in range(7))
    people = f"SELECT person_id, {flags} FROM ({' UNION ALL '.join(f'SELECT person_id, {i} AS d FROM {t}' for i, t in enumerate(tables))}) z GROUP BY person_id"
    wanted = " AND ".join(f"(d{i} OR (b >> {i}) & 1 = 0)" for i in range(7))
    body = f"(SELECT b, (SELECT count(*) FROM people WHERE {wanted}) AS n, (SELECT count(DISTINCT person_id) FROM person) AS d FROM range(1, 128) g(b)) x"
    return f"WITH people AS MATERIALIZED ({people}) " + _rows(2004, ["lpad(bin(b), 7, '0')", _share("n", "d")], "n", body)


def _sources() -> str:
    """Source values of what was mapped to concept 0, for the columns that the fixture has."""
    found = [("procedure_occurrence", "modifier_source_value", "modifier_concept_id"), ("observation", "qualifier_source_value", "qualifier_concept_id"), ("visit_occurrence", "discharge_to_source_value", "discharge_to_concept_id"), ("measurement", "measurement_source_value", "measurement_concept_id")]
    return _rows(1900, ["t", "c", "v"], "n", "(" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{s}' AS c, {s} AS v, count(*) AS n FROM {t} WHERE {k} = 0 GROUP BY {s}" for t, s, k in found) + ") x")


COUNTS: dict[int, str] = {
    0: _rows(0, ["'meridian'", "'1'", "current_date"], "count(DISTINCT person_id)", "person"),
    110: _units(110, "observation_period", "month", True),
    116: _units(116, "observation_period", "year", False, ["p.gender_concept_id", "CAST(floor((year(u) - p.year_of_birth) / 10) AS BIGINT)"]),
    230: _rows(230, [], "count(*)", "visit_occurrence t LEFT JOIN observation_period op ON op.person_id = t.person_id AND t.visit_start_date BETWEEN op.observation_period_start_date AND op.observation_period_end_date"),
    424: _pairs(424, "condition_occurrence", "condition_concept_id"),
    624: _pairs(624, "procedure_occurrence", "procedure_concept_id"),
    724: _pairs(724, "drug_exposure", "drug_concept_id"),
    824: _pairs(824, "observation", "observation_concept_id"),
    1409: _units(1409, "payer_plan_period", "year", False),
    1410: _units(1410, "payer_plan_period", "month", True),
    1824: _pairs(1824, "measurement", "measurement_concept_id"),
    1833: _rows(1833, ["c", "n", _share("n", "d")], "d", f"(SELECT t.measurement_concept_id AS c, count(*) FILTER (WHERE t.value_as_number IS NULL AND coalesce(t.value_as_concept_id, 0) = 0) AS n, count(*) AS d FROM {_within('measurement', 'measurement_date')} GROUP BY 1) x"),
    1900: _sources(),
    2004: _combinations(),
}
