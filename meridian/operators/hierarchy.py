"""Hierarchies of the treemaps: concepts of a domain with the names of up to four levels above them (level 1 is the nearest).

A concept with several ancestors of a kind goes up through the one with the largest id. Every hop is
an aggregation of ancestor pairs to one row per concept before anything is joined, so that no join
multiplies rows (a drug under several ingredients has one row for each, as it is counted in each).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREEMAPS = ("Condition", "Drug", "Drug Era", "Measurement", "Observation", "Procedure")
#: Fixed value: the concept that all procedures are grouped below.
PROCEDURE_ROOT = 4040390

_LEVELS = [f"level{i}_concept_name" for i in range(1, 5)]
_INGREDIENT = "domain_id = 'Drug' AND concept_class_id = 'Ingredient'"


def _pairs(cdm, distance: int | None = None) -> DataFrame:
    rows = cdm["concept_ancestor"]
    rows = rows if distance is None else rows.filter(F.col("min_levels_of_separation") == distance)
    return rows.select(F.col("descendant_concept_id").alias("id"), F.col("ancestor_concept_id").alias("up"))


def _names(cdm, where: str = "true") -> DataFrame:
    return cdm["concept"].filter(where).select(F.col("concept_id").alias("id"), F.col("concept_name").alias("name"))


def _hop(cdm, child: str, parent: str, distance: int | None = None) -> DataFrame:
    """(id, name, up): concepts that fit ``child`` with the largest id of their ancestors that fit ``parent``."""
    above = cdm["concept"].filter(parent).select(F.col("concept_id").alias("up"))
    return _pairs(cdm, distance).join(above, "up", "left_semi").groupBy("id").agg(F.max("up").alias("up")).join(_names(cdm, child), "id")


def _climb(rows: DataFrame, hops: list[DataFrame], first: int) -> DataFrame:
    """Goes up from ``up``, noting the name that each hop starts at as the next level."""
    for level, hop in enumerate(hops, first):
        step = hop.select(F.col("id").alias("up"), F.col("name").alias(f"level{level}_concept_name"), *([F.col("up").alias("__next")] if "up" in hop.columns else []))
        rows = rows.join(step, "up", "left").drop("up")
        rows = rows.withColumnRenamed("__next", "up") if "__next" in rows.columns else rows
    return rows


def _shaped(rows: DataFrame, treemap: str) -> DataFrame:
    levels = [F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in _LEVELS]
    return rows.select("concept_id", "concept_name", F.lit(treemap).alias("treemap"), *levels)


def conditions(cdm) -> DataFrame:
    """Through four levels of MedDRA, each one step above the last; a level's name counts only where a further level follows (but for the last)."""
    rows = _names(cdm, "domain_id = 'Condition'").join(_hop(cdm, "domain_id = 'Condition'", "vocabulary_id = 'MedDRA'", 1).drop("name"), "id", "left")
    step = _hop(cdm, "vocabulary_id = 'MedDRA'", "vocabulary_id = 'MedDRA'", 1)
    rows = rows.select(F.col("id").alias("concept_id"), F.col("name").alias("concept_name"), "up")
    return _shaped(_climb(rows, [step, step, step, _names(cdm)], 1), "Condition")


def _classes(cdm) -> list[DataFrame]:
    """From the fourth level of ATC to the second and the first."""
    level = "vocabulary_id = 'ATC' AND concept_class_id = 'ATC {0}'".format
    return [_hop(cdm, level("4th"), level("2nd")), _hop(cdm, level("2nd"), level("1st")), _names(cdm)]


def _ingredients(cdm) -> DataFrame:
    to_class = _hop(cdm, _INGREDIENT, "vocabulary_id = 'ATC' AND concept_class_id = 'ATC 4th'").drop("name")
    return _names(cdm, _INGREDIENT).join(to_class, "id", "left")


def drugs(cdm) -> DataFrame:
    """Ingredient and three levels of ATC; one row for each ingredient of a drug."""
    above = _ingredients(cdm).select(F.col("id").alias("i"), F.col("name").alias("level1_concept_name"), "up")
    below = _pairs(cdm).join(_names(cdm, "domain_id = 'Drug'"), "id").select(F.col("id").alias("concept_id"), F.col("name").alias("concept_name"), F.col("up").alias("i"))
    return _shaped(_climb(below.join(above, "i").drop("i"), _classes(cdm), 2), "Drug")


def drug_eras(cdm) -> DataFrame:
    rows = _ingredients(cdm).select(F.col("id").alias("concept_id"), F.col("name").alias("concept_name"), "up")
    return _shaped(_climb(rows, _classes(cdm), 1), "Drug Era")


def by_names(cdm, domain: str) -> DataFrame:
    """Measurements and observations: the last name in order among all parents, their parents, and theirs."""
    rows = _names(cdm, f"domain_id = '{domain}'")
    parents = _pairs(cdm, 1).join(_names(cdm).select(F.col("id").alias("up"), "name"), "up")
    level = parents.groupBy("id").agg(F.max("name").alias(_LEVELS[0]))
    found = rows.join(level, "id", "left")
    for below, name in zip(_LEVELS, _LEVELS[1:3], strict=False):
        level = parents.select("id", "up").join(level.select(F.col("id").alias("up"), below), "up").groupBy("id").agg(F.max(below).alias(name))
        found = found.join(level, "id", "left")
    return _shaped(found.withColumnsRenamed({"id": "concept_id", "name": "concept_name"}), domain)


def procedures(cdm) -> DataFrame:
    """Three levels below the root of procedures; names carry vocabulary and code."""
    root = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id") == PROCEDURE_ROOT)
    names = _names(cdm)

    def at(distance: int) -> DataFrame:
        return root.filter(F.col("min_levels_of_separation") == distance).select(F.col("descendant_concept_id").alias("up")).join(names.select(F.col("id").alias("up")), "up", "left_semi")

    def below(distance: int) -> DataFrame:
        return _pairs(cdm, 1).join(at(distance), "up", "left_semi").groupBy("id").agg(F.max("up").alias("up")).join(names, "id")

    first = at(1).join(names.select(F.col("id").alias("up"), F.col("name").alias(_LEVELS[2])), "up")
    second = below(1).join(first, "up").select(F.col("id").alias("up"), F.col("name").alias(_LEVELS[1]), _LEVELS[2])
    third = below(2)
    path = third.join(second, "up").select(F.col("id").alias("up"), F.col("name").alias(_LEVELS[0]), _LEVELS[1], _LEVELS[2])
    nearest = _pairs(cdm).join(third.select(F.col("id").alias("up")), "up", "left_semi").groupBy("id").agg(F.max("up").alias("up"))
    label = F.concat("vocabulary_name", F.lit(" "), "concept_code", F.lit(": "), "concept_name")
    rows = cdm["concept"].filter("domain_id = 'Procedure'").join(cdm["vocabulary"], "vocabulary_id").select(F.col("concept_id").alias("id"), label.alias("concept_name"))
    return _shaped(rows.join(nearest, "id", "left").join(path, "up", "left").withColumnRenamed("id", "concept_id"), "Procedure")


def concept_hierarchy(cdm) -> DataFrame:
    """All six: concept_id, concept_name, treemap, four level names."""
    parts = [conditions(cdm), drugs(cdm), drug_eras(cdm), by_names(cdm, "Measurement"), by_names(cdm, "Observation"), procedures(cdm)]
    return reduce(DataFrame.unionByName, parts)


#: The same in DuckDB, from the definition of each level.
SQL = f"""
    WITH step AS (SELECT a.descendant_concept_id AS id, a.ancestor_concept_id AS up, a.min_levels_of_separation AS far, d.concept_name AS name, d.domain_id AS dom, d.vocabulary_id AS voc, d.concept_class_id AS cls, u.concept_name AS upname, u.vocabulary_id AS upvoc, u.concept_class_id AS upcls
                  FROM concept_ancestor a JOIN concept d ON d.concept_id = a.descendant_concept_id JOIN concept u ON u.concept_id = a.ancestor_concept_id),
    pt AS (SELECT id, max(up) AS up FROM step WHERE dom = 'Condition' AND upvoc = 'MedDRA' AND far = 1 GROUP BY id),
    med AS (SELECT id, name, max(up) AS up FROM step WHERE voc = 'MedDRA' AND upvoc = 'MedDRA' AND far = 1 GROUP BY id, name),
    a5 AS (SELECT id, max(up) AS up FROM step WHERE dom = 'Drug' AND cls = 'Ingredient' AND upvoc = 'ATC' AND upcls = 'ATC 4th' GROUP BY id),
    a3 AS (SELECT id, name, max(up) AS up FROM step WHERE voc = 'ATC' AND cls = 'ATC 4th' AND upvoc = 'ATC' AND upcls = 'ATC 2nd' GROUP BY id, name),
    a1 AS (SELECT id, name, max(up) AS up FROM step WHERE voc = 'ATC' AND cls = 'ATC 2nd' AND upvoc = 'ATC' AND upcls = 'ATC 1st' GROUP BY id, name),
    atc AS (SELECT i.concept_id AS i, i.concept_name AS iname, a3.name AS n1, a1.name AS n2, t.concept_name AS n3 FROM concept i LEFT JOIN a5 ON a5.id = i.concept_id LEFT JOIN a3 ON a3.id = a5.up LEFT JOIN a1 ON a1.id = a3.up LEFT JOIN concept t ON t.concept_id = a1.up WHERE i.domain_id = 'Drug' AND i.concept_class_id = 'Ingredient'),
    par AS (SELECT id, up, upname FROM step WHERE far = 1),
    os2 AS (SELECT s.id, s.name, max(s.up) AS up FROM step s JOIN step r ON r.up = {PROCEDURE_ROOT} AND r.far = 1 AND r.id = s.up WHERE s.far = 1 GROUP BY s.id, s.name),
    os3 AS (SELECT s.id, s.name, max(s.up) AS up FROM step s JOIN step r ON r.up = {PROCEDURE_ROOT} AND r.far = 2 AND r.id = s.up WHERE s.far = 1 GROUP BY s.id, s.name),
    below AS (SELECT descendant_concept_id AS id, max(ancestor_concept_id) AS os3 FROM concept_ancestor WHERE ancestor_concept_id IN (SELECT id FROM os3) GROUP BY 1),
    hier AS (
      SELECT c.concept_id, c.concept_name, 'Condition' AS treemap, m1.name AS level1_concept_name, m2.name AS level2_concept_name, m3.name AS level3_concept_name, t.concept_name AS level4_concept_name
      FROM concept c LEFT JOIN pt ON pt.id = c.concept_id LEFT JOIN med m1 ON m1.id = pt.up LEFT JOIN med m2 ON m2.id = m1.up LEFT JOIN med m3 ON m3.id = m2.up LEFT JOIN concept t ON t.concept_id = m3.up WHERE c.domain_id = 'Condition'
      UNION ALL SELECT s.id, s.name, 'Drug', iname, n1, n2, n3 FROM step s JOIN atc ON i = s.up WHERE s.dom = 'Drug'
      UNION ALL SELECT i, iname, 'Drug Era', n1, n2, n3, NULL FROM atc
      UNION ALL SELECT concept_id, concept_name, domain_id, (SELECT max(upname) FROM par p WHERE p.id = c.concept_id), (SELECT max(q.upname) FROM par p JOIN par q ON q.id = p.up WHERE p.id = c.concept_id), (SELECT max(r.upname) FROM par p JOIN par q ON q.id = p.up JOIN par r ON r.id = q.up WHERE p.id = c.concept_id), NULL
      FROM concept c WHERE domain_id IN ('Measurement', 'Observation')
      UNION ALL SELECT c.concept_id, vocabulary_name || ' ' || concept_code || ': ' || c.concept_name, 'Procedure', x.n3, x.n2, x.n1, NULL
      FROM concept c JOIN vocabulary v ON v.vocabulary_id = c.vocabulary_id LEFT JOIN below b ON b.id = c.concept_id
      LEFT JOIN (SELECT os3.id, os3.name AS n3, os2.name AS n2, o.concept_name AS n1 FROM os3 JOIN os2 ON os2.id = os3.up JOIN concept o ON o.concept_id = os2.up) x ON x.id = b.os3 WHERE c.domain_id = 'Procedure')"""
