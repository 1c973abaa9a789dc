"""Concept sets, hierarchy and search over vocabulary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ids(spark, ids) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], "concept_id long")


def resolve_items(cdm, items: list[dict]) -> DataFrame:
    """Concepts of expression items: the ids themselves (if they exist), valid descendants, and sources that map to any of them."""
    plain = [i["concept"]["CONCEPT_ID"] for i in items]
    below = [i["concept"]["CONCEPT_ID"] for i in items if i.get("includeDescendants")]
    mapped = [i["concept"]["CONCEPT_ID"] for i in items if i.get("includeMapped")]
    mapped_below = [i["concept"]["CONCEPT_ID"] for i in items if i.get("includeMapped") and i.get("includeDescendants")]

    def closed(ids: list[int], lower: list[int]) -> DataFrame:
        found = cdm["concept"].filter(F.col("concept_id").isin(ids)).select("concept_id")
        if lower:
            pairs = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id").isin(lower)).select(F.col("descendant_concept_id").alias("concept_id"))
            found = found.union(pairs.join(cdm["concept"].filter("invalid_reason IS NULL"), "concept_id", "left_semi"))
        return found.distinct()

    found = closed(plain, below)
    if mapped:
        targets = closed(mapped, mapped_below).withColumnRenamed("concept_id", "concept_id_2")
        maps = cdm["concept_relationship"].filter("relationship_id = 'Maps to' AND invalid_reason IS NULL")
        found = found.union(maps.join(targets, "concept_id_2", "left_semi").select(F.col("concept_id_1").alias("concept_id"))).distinct()
    return found


def concept_set(cdm, expression: dict) -> DataFrame:
    """Distinct concept_id of a concept-set expression: what its items include less what they exclude."""
    items = expression.get("items") or []
    included = [i for i in items if not i.get("isExcluded")]
    excluded = [i for i in items if i.get("isExcluded")]
    if not included:
        return _ids(cdm.spark, [])
    found = resolve_items(cdm, included)
    return found.join(resolve_items(cdm, excluded), "concept_id", "left_anti") if excluded else found


def codesets(cdm, concept_sets: list[dict]) -> DataFrame:
    """(codeset_id, concept_id) of all concept sets of a definition."""
    parts = [concept_set(cdm, s.get("expression") or {}).select(F.lit(int(s["id"])).alias("codeset_id"), "concept_id") for s in concept_sets]
    return reduce(DataFrame.unionByName, parts) if parts else cdm.spark.createDataFrame([], "codeset_id int, concept_id long")


LABEL = ["concept_id", "concept_name", "domain_id", "vocabulary_id", "concept_class_id", "standard_concept", "concept_code", "invalid_reason"]


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.coalesce("standard_concept", F.lit("N")).alias(c) if c == "standard_concept" else F.coalesce("invalid_reason", F.lit("V")).alias(c) if c == "invalid_reason" else F.col(c) for c in LABEL])


def get_concepts(cdm, ids: list[int]) -> DataFrame:
    return _labelled(cdm["concept"].filter(F.col("concept_id").isin(ids)))


def lookup_codes(cdm, codes: list[str]) -> DataFrame:
    return _labelled(cdm["concept"].filter(F.col("concept_code").isin(codes)))


def by_code_and_vocabulary(cdm, pairs: list[tuple[str, str]]) -> DataFrame:
    wanted = cdm.spark.createDataFrame(pairs, "concept_code string, vocabulary_id string")
    return cdm["concept"].join(wanted, ["concept_code", "vocabulary_id"], "left_semi").select("concept_id", "concept_code", "vocabulary_id")


def search(cdm, text: str, limit: int = 20_000, **filters: list[str]) -> DataFrame:
    """Concepts whose name or code contains the text, or whose id it is; filters by domain_id, vocabulary_id, concept_class_id, standard_concept, invalid_reason."""
    q = text.lower()
    hit = F.contains(F.lower("concept_name"), F.lit(q)) | F.contains(F.lower("concept_code"), F.lit(q)) | (F.col("concept_id").cast("string") == q)
    rows = _labelled(cdm["concept"].filter(hit))
    for column, allowed in filters.items():
        rows = rows.filter(F.col(column).isin(allowed))
    return rows.orderBy("concept_name", "concept_id").limit(limit)


def search_lexical(cdm, words: list[str], limit: int = 100) -> DataFrame:
    """Standard concepts whose name, or one of whose synonyms, holds all words; by the share of the name that the words make up.

    Lengths are those without blanks and hyphens; ties by id.
    """
    def holds(name: str) -> Column:
        return reduce(Column.__and__, [F.contains(F.lower(name), F.lit(w.lower())) for w in words], F.lit(True))

    def size(text: Column) -> Column:
        return F.length(F.regexp_replace(text, "[ -]", ""))

    hits = cdm["concept"].filter(holds("concept_name")).select("concept_id").union(cdm["concept_synonym"].filter(holds("concept_synonym_name")).select("concept_id")).distinct()
    rest = reduce(lambda text, w: F.replace(text, F.lit(w.lower()), F.lit("")), words, F.lower("concept_name"))
    score = F.round(1 - size(rest).cast("double") / size(F.col("concept_name")), 6)
    found = cdm["concept"].filter("standard_concept = 'S'").join(hits, "concept_id", "left_semi").select("concept_id", "concept_name", score.alias("score"))
    return found.orderBy(F.desc("score"), "concept_id").limit(limit)


def descendants(cdm, ids: list[int], others_only: bool = False) -> DataFrame:
    """Pairs of a given concept and what lies below it, itself included, with the distance."""
    rows = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id").isin(ids))
    if others_only:
        rows = rows.filter("ancestor_concept_id <> descendant_concept_id")
    return rows.join(cdm["concept"], F.col("descendant_concept_id") == F.col("concept_id")).select("ancestor_concept_id", "concept_id", "concept_name", F.col("min_levels_of_separation").alias("distance"))


def ancestors_and_descendants(cdm, concept_id: int) -> DataFrame:
    pairs = cdm["concept_ancestor"].filter("ancestor_concept_id <> descendant_concept_id")
    up = pairs.filter(F.col("descendant_concept_id") == concept_id).select(F.col("ancestor_concept_id").alias("concept_id"), F.lit("Has ancestor of").alias("relationship"), F.col("min_levels_of_separation").alias("distance"))
    down = pairs.filter(F.col("ancestor_concept_id") == concept_id).select(F.col("descendant_concept_id").alias("concept_id"), F.lit("Has descendant of").alias("relationship"), F.col("min_levels_of_separation").alias("distance"))
    return up.union(down).join(cdm["concept"].select("concept_id", "concept_name"), "concept_id")


def related(cdm, ids: list[int]) -> DataFrame:
    """What a concept is connected to: relationships, ancestors, descendants, and sources mapped to descendants."""
    rel, anc = cdm["concept_relationship"].filter("invalid_reason IS NULL"), cdm["concept_ancestor"]
    direct = rel.filter(F.col("concept_id_1").isin(ids)).select(F.col("concept_id_2").alias("concept_id"), F.col("relationship_id").alias("relationship"), F.lit(1).alias("distance"))
    up = anc.filter(F.col("descendant_concept_id").isin(ids) & ~F.col("ancestor_concept_id").isin(ids)).select(F.col("ancestor_concept_id"), F.lit("Has ancestor of"), "min_levels_of_separation")
    below = anc.filter(F.col("ancestor_concept_id").isin(ids))
    down = below.filter(~F.col("descendant_concept_id").isin(ids)).select("descendant_concept_id", F.lit("Has descendant of"), "min_levels_of_separation")
    sources = below.join(rel.filter("relationship_id = 'Maps to'"), F.col("descendant_concept_id") == F.col("concept_id_2")).select("concept_id_1", F.lit("Has relation to descendant of : Maps to"), "min_levels_of_separation")
    rows = direct.union(up).union(down).union(sources).distinct()
    return rows.join(cdm["concept"].select("concept_id", "concept_name"), "concept_id")


def common_ancestors(cdm, ids: list[int]) -> DataFrame:
    hits = cdm["concept_ancestor"].filter(F.col("descendant_concept_id").isin(ids)).groupBy("ancestor_concept_id").agg(F.countDistinct("descendant_concept_id").alias("n"))
    return hits.filter(F.col("n") == len(set(ids))).select("ancestor_concept_id")


def siblings(cdm, ids: list[int], class_id: str) -> DataFrame:
    """Descendants of those ancestors of the given concepts that are of a class, with summed distances."""
    anc = cdm["concept_ancestor"]
    tops = anc.filter(F.col("descendant_concept_id").isin(ids)).join(cdm["concept"].filter(F.col("concept_class_id") == class_id), F.col("ancestor_concept_id") == F.col("concept_id"), "left_semi")
    tops = tops.select(F.col("ancestor_concept_id").alias("top"), F.col("min_levels_of_separation").alias("up"))
    rows = tops.join(anc, F.col("top") == F.col("ancestor_concept_id")).filter(~F.col("descendant_concept_id").isin(ids))
    return rows.groupBy(F.col("descendant_concept_id").alias("concept_id")).agg(F.min(F.col("up") + F.col("min_levels_of_separation")).alias("distance"))


def mapped_sources(cdm, ids: list[int]) -> DataFrame:
    """The concepts themselves, sources that map to them, and local source codes."""
    own = cdm["concept"].filter(F.col("concept_id").isin(ids)).select(F.col("concept_code").alias("code"), "vocabulary_id")
    maps = cdm["concept_relationship"].filter("relationship_id = 'Maps to' AND invalid_reason IS NULL").filter(F.col("concept_id_2").isin(ids))
    mapped = maps.join(cdm["concept"], F.col("concept_id_1") == F.col("concept_id")).select("concept_code", "vocabulary_id")
    local = cdm["source_to_concept_map"].filter(F.col("target_concept_id").isin(ids) & F.col("invalid_reason").isNull()).select("source_code", "source_vocabulary_id")
    return own.union(mapped).union(local).distinct()


def standard_targets(cdm, ids: list[int]) -> DataFrame:
    """Standard or classification concepts that the given ones map to, with how many of them do."""
    maps = cdm["concept_relationship"].filter("relationship_id = 'Maps to' AND invalid_reason IS NULL").filter(F.col("concept_id_1").isin(ids))
    good = cdm["concept"].filter("standard_concept IN ('S', 'C')")
    return maps.join(good, F.col("concept_id_2") == F.col("concept_id")).groupBy("concept_id", "concept_name").agg(F.countDistinct("concept_id_1").alias("mapped_from"))


def recommended(cdm, ids: list[int]) -> DataFrame:
    rows = cdm["concept_recommended"].filter(F.col("concept_id_1").isin(ids))
    return rows.join(cdm["concept"], F.col("concept_id_2") == F.col("concept_id")).select("concept_id", "concept_name", "relationship_id").distinct()


def compare(cdm, first: dict, second: dict) -> DataFrame:
    """Two concept sets side by side: which concepts only one has, and which both."""
    a = concept_set(cdm, first).withColumn("a", F.lit(1))
    b = concept_set(cdm, second).withColumn("b", F.lit(1))
    both = a.join(b, "concept_id", "full_outer")
    flag: Column = lambda x: F.when(x, 1).otherwise(0)
    return both.select("concept_id", flag(F.col("b").isNull()).alias("only_first"), flag(F.col("a").isNull()).alias("only_second"), flag(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"))


def optimize(cdm, ids: list[int], below: list[int]) -> DataFrame:
    """Chosen concepts that are valid, with ``removed`` 1 where another one, chosen with its descendants (``below``), subsumes them."""
    chosen = cdm["concept"].filter(F.col("concept_id").isin(ids) & F.col("invalid_reason").isNull()).select("concept_id", "concept_name")
    pairs = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id").isin(below) & (F.col("ancestor_concept_id") != F.col("descendant_concept_id")))
    subsumed = pairs.select(F.col("descendant_concept_id").alias("concept_id")).distinct().withColumn("s", F.lit(1))
    return chosen.join(subsumed, "concept_id", "left").select("concept_id", "concept_name", F.coalesce("s", F.lit(0)).alias("removed"))


def ancestor_pairs(cdm, ancestors: list[int]) -> DataFrame:
    """Ancestors with all their descendants, and every known one with itself."""
    pairs = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id").isin(ancestors)).select(F.col("ancestor_concept_id").alias("ancestor_id"), F.col("descendant_concept_id").alias("descendant_id"))
    return pairs.union(cdm["concept"].filter(F.col("concept_id").isin(ancestors)).select("concept_id", "concept_id")).distinct()


def pairs_between(cdm, ancestors: list[int], descendants: list[int]) -> DataFrame:
    """Which of some ancestors lie above which of some descendants."""
    rows = cdm["concept_ancestor"].filter(F.col("ancestor_concept_id").isin(ancestors) & F.col("descendant_concept_id").isin(descendants))
    return rows.select(F.col("ancestor_concept_id").alias("ancestor_id"), F.col("descendant_concept_id").alias("descendant_id")).distinct()


def domains(cdm) -> DataFrame:
    return cdm["concept"].groupBy("domain_id").agg(F.count("*").alias("n"))


def vocabularies(cdm) -> DataFrame:
    return cdm["concept"].groupBy("vocabulary_id").agg(F.count("*").alias("n"))


def domain_list(cdm) -> DataFrame:
    return cdm["domain"].select("domain_id", "domain_name", "domain_concept_id").orderBy("domain_name")


def vocabulary_list(cdm) -> DataFrame:
    return cdm["vocabulary"].select("vocabulary_id", "vocabulary_name", "vocabulary_reference", "vocabulary_version", "vocabulary_concept_id").orderBy("vocabulary_name")


def version(cdm) -> DataFrame:
    """The version of the vocabularies as a whole."""
    return cdm["vocabulary"].filter("vocabulary_id = 'None'").select("vocabulary_version")


def mapped_from(cdm, ids: list[int]) -> DataFrame:
    """Standard and classification concepts with each of the given ones that maps to them."""
    maps = cdm["concept_relationship"].filter("relationship_id = 'Maps to' AND invalid_reason IS NULL").filter(F.col("concept_id_1").isin(ids))
    good = cdm["concept"].filter("standard_concept IN ('S', 'C')").select("concept_id")
    return maps.join(good, F.col("concept_id_2") == F.col("concept_id")).select("concept_id", F.col("concept_id_1").cast("string").alias("mapped_from_id")).distinct()


def related_filtered(cdm, ids: list[int], **filters: list[str]) -> DataFrame:
    """Labels of all that the given concepts are connected to (as in ``related``, themselves as their own ancestors included); filters by columns of the label."""
    relations, pairs = cdm["concept_relationship"], cdm["concept_ancestor"]
    known = relations.join(cdm["relationship"], "relationship_id", "left_semi")
    direct = known.filter(F.col("concept_id_1").isin(ids) & F.col("invalid_reason").isNull()).select(F.col("concept_id_2").alias("concept_id"))
    up = pairs.filter(F.col("descendant_concept_id").isin(ids)).select("ancestor_concept_id")
    below = pairs.filter(F.col("ancestor_concept_id").isin(ids)).select("descendant_concept_id").distinct()
    sources = known.filter("relationship_id = 'Mapped from'").join(below, F.col("concept_id_1") == F.col("descendant_concept_id")).select("concept_id_2")
    rows = _labelled(cdm["concept"].join(direct.union(up).union(below).union(sources).distinct(), "concept_id", "left_semi"))
    for column, allowed in filters.items():
        rows = rows.filter(F.col(column).isin(allowed))
    return rows.orderBy("concept_name", "concept_id")


def concept_counts(cdm, own: DataFrame) -> DataFrame:
    """Record counts of concepts (concept_id, n) with those of their descendants, for every concept and ancestor; 0 where absent."""
    every = cdm["concept"].select("concept_id").union(cdm["concept_ancestor"].select("ancestor_concept_id")).distinct()
    below = cdm["concept_ancestor"].join(own.withColumnRenamed("concept_id", "descendant_concept_id"), "descendant_concept_id").groupBy(F.col("ancestor_concept_id").alias("concept_id")).agg(F.sum("n").alias("d"))
    return every.join(own, "concept_id", "left").join(below, "concept_id", "left").select("concept_id", F.coalesce("n", F.lit(0)).cast("long").alias("record_count"), F.coalesce("d", F.lit(0)).cast("long").alias("descendant_record_count"))


def hierarchy(cdm, leaf_domain: str, leaf_class: str, levels: list[str]) -> DataFrame:
    """Leaves with the largest ancestor id of each named class as levels (null where there is none)."""
    rows = cdm["concept"].filter((F.col("domain_id") == leaf_domain) & (F.col("concept_class_id") == leaf_class)).select("concept_id", "concept_name")
    for i, cls in enumerate(levels, 1):
        tops = cdm["concept"].filter(F.col("concept_class_id") == cls).select(F.col("concept_id").alias("t"), F.col("concept_name").alias("tn"))
        up = cdm["concept_ancestor"].join(tops, F.col("ancestor_concept_id") == F.col("t")).groupBy(F.col("descendant_concept_id").alias("concept_id")).agg(F.max(F.struct("t", "tn")).alias("top"))
        rows = rows.join(up, "concept_id", "left").withColumn(f"level{i}_concept_name", F.col("top.tn")).drop("top")
    return rows
