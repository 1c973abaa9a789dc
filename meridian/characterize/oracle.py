"""The analyses once more as DuckDB SQL, written without the engine's formulations (for the driver's comparison)."""

from __future__ import annotations

import re

from ..sources.adapter import with_prefix
from .engine import STRATA
from .registry import ANALYSES, DOMAINS, START, Analysis
from .statements import COUNTS, VALUES


def duck(text: str) -> str:
    return re.sub(r"DAYS\((\w+), (\w+)\)", r"CAST(\2 - \1 AS BIGINT)", text)


_IN = "EXISTS (SELECT 1 FROM observation_period op WHERE op.person_id = t.person_id AND t.{0} BETWEEN op.observation_period_start_date AND op.observation_period_end_date)"


def _rows(a: Analysis) -> str:
    columns, joins, where = ["t.*"], "", []
    source = a.table
    if a.extra[:1] == ("first period",):
        source = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY {a.table}_start_date, {a.table}_id) AS rn FROM {a.table}) z WHERE rn = 1)"
    if a.op:
        joins += f" JOIN observation_period op ON op.person_id = t.person_id AND t.{START[a.table]} BETWEEN op.observation_period_start_date AND op.observation_period_end_date"
    if a.person:
        joins += " JOIN person p ON p.person_id = t.person_id"
        columns += ["p.gender_concept_id", "p.year_of_birth"]
    if a.extra[:1] == ("join",):
        joins += f" JOIN {a.extra[1]} j ON j.{a.extra[2]} = t.{a.extra[2]}"
        columns += [f"j.{c}" for c in ("zip", "state", "place_of_service_concept_id", "visit_concept_id") if any(c in k for k in (*a.keys, a.where)) and not (c == "place_of_service_concept_id" and a.table == "care_site")]
    if a.extra[:1] == ("join on",):
        joins += f" JOIN {a.extra[1]} j ON j.{a.extra[3]} = t.{a.extra[2]}"
        columns.append(f"j.{a.keys[0]}")
    if a.extra[:1] == ("anti",):
        where.append(f"t.person_id NOT IN (SELECT person_id FROM {a.extra[1]})")
    inner = f"SELECT {', '.join(columns)} FROM {source} t{joins}" + (f" WHERE {where[0]}" if where else "")
    return f"(SELECT * FROM ({inner}) r" + (f" WHERE {duck(a.where)}" if a.where else "") + ")"


def _out(a: Analysis, strata: list[str], count: str, body: str) -> str:
    padded = strata + ["NULL"] * (len(STRATA) - len(strata))
    cells = ", ".join(f"CAST({s} AS VARCHAR) AS {n}" for s, n in zip(padded, STRATA, strict=True))
    return f"SELECT CAST({a.id} AS INTEGER) AS analysis_id, {cells}, CAST({count} AS BIGINT) AS count_value FROM {body}"


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST(round(CAST({n} AS DOUBLE) / {d}, 6) AS DECIMAL(12, 6)) END"


def counts(a: Analysis) -> str:
    if a.id in COUNTS:
        return COUNTS[a.id]
    keys = [duck(k) for k in a.keys]
    group = (" GROUP BY " + ", ".join(keys)) if keys else ""
    t, start = a.table, START.get(a.table, "")
    if a.family in ("COUNT", "COUNTD"):
        return _out(a, keys, "count(*)" if a.family == "COUNT" else f"count(DISTINCT {a.entity})", f"{_rows(a)} x{group}")
    if a.family == "ORPHAN":
        parent, key = a.extra
        return _out(a, [], "count(*)", f"{t} t LEFT JOIN (SELECT DISTINCT {key} AS k FROM {parent}) q ON q.k = t.{key} WHERE t.{key} IS NOT NULL AND q.k IS NULL")
    if a.family == "OUTSIDE":
        return _out(a, [], "count(*)", f"{t} t WHERE NOT {_IN.format(start)}")
    if a.family == "PROP":
        size = "count(DISTINCT t.person_id)" if a.extra == ("persons",) else "count(*)"
        return _out(a, [_ratio("n", "d"), "n", "d"], "sign(n)", f"(SELECT (SELECT {size} FROM {t} t WHERE NOT {_IN.format(start)}) AS n, (SELECT {size} FROM {t} t) AS d) x")
    if a.family == "ATLEAST":
        per = f"(SELECT {keys[0]} AS c, person_id, count(*) AS x FROM {_rows(a)} x GROUP BY ALL)"
        return _out(a, ["v.c", "v.x"], "(SELECT count(*) FROM " + per + " w WHERE w.c = v.c AND w.x >= v.x)", f"(SELECT DISTINCT c, x FROM {per} u) v")
    if a.family == "PERIODS":
        return _out(a, ["k"], "count(*)", f"(SELECT person_id, count(*) AS k FROM {t} GROUP BY person_id) x GROUP BY k")
    if a.family == "CALENDAR":
        unit, mode, *more = a.extra
        spine = f"(SELECT CAST(u AS DATE) AS u, CAST(u + INTERVAL 1 {unit} AS DATE) - 1 AS z FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2030-12-01', INTERVAL 1 {unit}) g(u))"
        fits = f"{t}_start_date <= u AND {t}_end_date >= z" if mode == "covered" else f"{t}_start_date <= z AND {t}_end_date >= u AND {t}_start_date <= {t}_end_date"
        key = "year(u)" if unit == "year" else "year(u) * 100 + month(u)"
        keys = [key] + (["gender_concept_id", f"CAST(floor(({key} - year_of_birth) / 10) AS BIGINT)"] if more else [])
        person = " JOIN person p ON p.person_id = t.person_id" if more else ""
        return _out(a, keys, "count(DISTINCT t.person_id)", f"{t} t JOIN {spine} s ON {fits}{person} GROUP BY {', '.join(keys)}")
    if a.family == "UNIONCOUNT":
        key, concept = a.extra
        parts = [f"SELECT coalesce(v.{concept}, 0) AS c, '{o}' AS n FROM {o} o LEFT JOIN {t} v ON v.{key} = o.visit_occurrence_id" for o in ("drug_exposure", "condition_occurrence", "device_exposure", "procedure_occurrence", "measurement", "observation")]
        parts.append(f"SELECT coalesce({concept}, 0), '{t}' FROM {t}")
        return _out(a, ["c", "n"], "count(*)", f"({' UNION ALL '.join(parts)}) x GROUP BY c, n")
    if a.family == "DOMAINS":
        parts = " INTERSECT ".join(f"SELECT person_id FROM {DOMAINS[n].table} t WHERE {_IN.format(DOMAINS[n].start)}" for n in a.extra)
        return _out(a, [], "count(*)", f"({parts}) x")
    raise ValueError(a.family)


def dist(a: Analysis) -> str:
    keys = [duck(k) for k in a.keys]
    kind = a.extra[0] if a.extra else ""
    if a.id in VALUES:
        rows, n = VALUES[a.id]
        rows, keys = f"({rows})", ["k0"] * n
    elif kind == "distinct per person":
        rows, keys = f"(SELECT count(DISTINCT {a.value}) AS v FROM {_rows(a)} x GROUP BY person_id)", []
    elif kind == "age at first":
        rows = f"(SELECT {keys[0]} AS k0, p.gender_concept_id AS k1, min(year({a.value})) - min(p.year_of_birth) AS v FROM {_rows(a)} x JOIN person p ON p.person_id = x.person_id GROUP BY x.person_id, {keys[0]}, p.gender_concept_id)"
    else:
        rows = f"(SELECT {''.join(f'{k} AS k{i}, ' for i, k in enumerate(keys))}{duck(a.value)} AS v FROM {_rows(a)} x)"
    names = [f"k{i}" for i in range(len(keys))]
    strata = [f"CAST({n} AS VARCHAR)" for n in names] + ["CAST(NULL AS VARCHAR)"] * (2 - len(names))
    where = (" WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names)) if names else ""
    group = (" GROUP BY " + ", ".join(names)) if names else " HAVING count(*) > 0"
    points = {"median_value": 50, "p10_value": 10, "p25_value": 25, "p75_value": 75, "p90_value": 90}
    if a.family == "DIST9999":
        cells = [f"coalesce(greatest(-9999.0, list_sort(list(CAST(v AS DOUBLE)))[CAST({p} * (count(*) + 1) // 100 AS BIGINT)]), -9999.0) AS {n}" for n, p in points.items()]
    else:
        cells = [f"coalesce(list_sort(list(CAST(v AS DOUBLE)), 'ASC', 'NULLS LAST')[CAST(ceil({p} * count(*) / 100) AS BIGINT)], max(CAST(v AS DOUBLE))) AS {n}" for n, p in points.items()]
    return (
        f"SELECT CAST({a.id} AS INTEGER) AS analysis_id, {strata[0]} AS stratum_1, {strata[1]} AS stratum_2, count(*) AS count_value, min(CAST(v AS DOUBLE)) AS min_value, max(CAST(v AS DOUBLE)) AS max_value, "
        f"round(CAST(sum(CAST(CAST(v AS DOUBLE) AS DECIMAL(28, 10))) AS DOUBLE) / count(v), 4) AS avg_value, round(stddev_samp(CAST(v AS DOUBLE)), 4) AS stdev_value, {', '.join(cells)} FROM {rows} y{where}{group}"
    )


def sql(ids: list[int]) -> str:
    parts = [(dist if ANALYSES[i].family.startswith("DIST") else counts)(ANALYSES[i]) for i in ids]
    return with_prefix(" UNION ALL ".join(f"SELECT * FROM ({p}) q{i}" for i, p in enumerate(parts)))
