"""Registered queries: the analyses by table and shape."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources.adapter import Cdm, with_prefix
from ..sources.scratch import scratch_dir
from . import engine, oracle, runner
from .registry import ANALYSES, section

SECTIONS: dict[str, list[int]] = {}
for _a in ANALYSES.values():
    SECTIONS.setdefault(section(_a), []).append(_a.id)

QUERIES = {name: (lambda spark, sf_dir, ids=tuple(ids): engine.run(Cdm(spark, sf_dir), list(ids))) for name, ids in SECTIONS.items()}
ORACLE_SQL = {name: oracle.sql(ids) for name, ids in SECTIONS.items()}

_MERGED = [2, 4, 10, 402, 424, 1818]
_SPREAD = [506, 715, 1504]


def _run(spark, sf_dir: str, ids: list[int]) -> runner.Outcome:
    return runner.run(Cdm(spark, sf_dir), f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}", [*ids, 9999])  # an unknown analysis fails, the others go on


def source_distribution(spark, sf_dir: str) -> DataFrame:
    """The row of analysis 0 among the distributions: all persons, no statistics."""
    return engine.source_distribution(Cdm(spark, sf_dir))


def counts_of_concepts(spark, sf_dir: str) -> DataFrame:
    """Concept counts from the merged results of all analyses that feed them."""
    cdm = Cdm(spark, sf_dir)
    return runner.concept_counts(cdm.derived("concept count analyses", lambda: engine.run(cdm, runner.counted_analyses())), cdm)


def _all(parts: list[str], small: int | None = None) -> str:
    body = " UNION ALL ".join(f"SELECT * FROM ({p}) q{i}" for i, p in enumerate(parts))
    return body if small is None else f"SELECT * FROM ({body}) z WHERE count_value > {small}"


def _listed(ids: tuple[int, ...]) -> str:
    return ", ".join(map(str, ids))


QUERIES |= {
    "runner_results": lambda spark, sf_dir: _run(spark, sf_dir, _MERGED).results,
    "runner_distributions": lambda spark, sf_dir: _run(spark, sf_dir, _SPREAD).distributions,
    "runner_concept_counts": counts_of_concepts,
    "achilles_source_dist": source_distribution,
}
ORACLE_SQL |= {
    "runner_results": with_prefix(_all([oracle.counts(ANALYSES[i]) for i in _MERGED], 5)),
    "runner_distributions": with_prefix(_all([oracle.dist(ANALYSES[i]) for i in _SPREAD], 5)),
    "runner_concept_counts": with_prefix(f"""
        WITH res AS MATERIALIZED ({_all([oracle.counts(ANALYSES[i]) for i in runner.counted_analyses()])}),
        records AS (SELECT DISTINCT c, n FROM (
          SELECT stratum_1 AS c, max(count_value) AS n FROM res WHERE analysis_id IN ({_listed(runner.MAX_OF_FIRST)}) GROUP BY 1 UNION ALL SELECT stratum_2, CAST(sum(count_value) AS BIGINT) FROM res WHERE analysis_id IN ({_listed(runner.SUM_OF_SECOND)}) GROUP BY 1) u),
        persons AS (SELECT stratum_1 AS c, max(count_value) AS n FROM res WHERE analysis_id IN ({_listed(runner.PERSONS_OF_FIRST)}) GROUP BY 1),
        pairs AS (SELECT CAST(ancestor_concept_id AS VARCHAR) AS a, CAST(descendant_concept_id AS VARCHAR) AS c FROM concept_ancestor UNION SELECT c, c FROM records UNION SELECT c, c FROM persons),
        ids AS (SELECT concept_id AS i FROM concept UNION SELECT ancestor_concept_id FROM concept_ancestor)
        SELECT i AS concept_id, CAST(coalesce((SELECT max(n) FROM records WHERE c = CAST(i AS VARCHAR)), 0) AS BIGINT) AS record_count,
               CAST(coalesce((SELECT sum(n) FROM pairs JOIN records USING (c) WHERE a = CAST(i AS VARCHAR)), 0) * greatest(1, (SELECT count(*) FROM records WHERE c = CAST(i AS VARCHAR))) AS BIGINT) AS descendant_record_count,
               CAST(coalesce((SELECT max(n) FROM persons WHERE c = CAST(i AS VARCHAR)), 0) AS BIGINT) AS person_count,
               CAST(coalesce((SELECT sum(n) FROM pairs JOIN persons USING (c) WHERE a = CAST(i AS VARCHAR)), 0) AS BIGINT) AS descendant_person_count FROM ids"""),
    "achilles_source_dist": with_prefix("SELECT CAST(0 AS INTEGER) AS analysis_id, 'meridian' AS stratum_1, CAST(NULL AS VARCHAR) AS stratum_2, count(DISTINCT person_id) AS count_value, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {n}_value" for n in ("min", "max", "avg", "stdev", "median", "p10", "p25", "p75", "p90")) + " FROM person"),
}
