"""Exact deduplication by distributed most-significant-digit radix partitioning.

A digit is a run of successive bytes. Round r splits every open group by its next digit; a group
that is down to one row, or whose text has ended, is finished. Digits grow eightfold from round to
round, so a text of n bytes is settled after O(log n) rounds, and because almost all texts differ
early, only real copies (and texts that share a long head) are carried into later rounds.
No digest takes part in deciding equality.

Skew: before anything is shuffled, each task merges the equal texts of a batch by the same radix
recursion in memory and sends one row with the list of their ids, so a text that fills a third of
the table crosses the network once per batch. What is left meets in joins that adaptive execution
splits, never in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_map, ascii_lower, materialize, slices

FIRST_DIGIT = 256  # bytes
GROWTH = 8


def radix_groups(texts: list[bytes], width: int = 32) -> list[list[int]]:
    """Indices of equal texts, by MSD radix recursion (depth-first, one digit of ``width`` bytes, then eight times as many)."""
    done: list[list[int]] = []
    open_groups = [(list(range(len(texts))), 0, width)]
    while open_groups:
        rows, at, w = open_groups.pop()
        if len(rows) == 1:
            done.append(rows)
            continue
        buckets: dict[bytes, list[int]] = {}
        for i in rows:
            buckets.setdefault(texts[i][at : at + w], []).append(i)
        for digit, own in buckets.items():
            if len(own) == 1 or len(digit) < w:
                done.append(own)
            else:
                open_groups.append((own, at + w, w * GROWTH))
    return done


def _merge_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4000):
        ids = batch.column(0).to_pylist()
        texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]  # bytes.lower: A-Z only
        groups = radix_groups(texts)
        members = [sorted((ids[i] for i in g), key=lambda x: (x is not None, x), reverse=True) for g in groups]
        bodies = [texts[g[0]] for g in groups]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(members, pa.list_(pa.int64())),
                pa.array(bodies, pa.binary()),
                pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
            ],
            names=["ids", "body", "text_sha256"],
        )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id stays.
    Null texts count as empty. Null ids are smaller than any id (keep_id is null only where all ids
    of a group are). Repeated rows with one id form a group like others and exactly one row is kept.
    An empty table gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    # round 1: heads that at least two rows share; only these groups stay open
    head = F.substring(F.coalesce(slim["text"], F.lit("")).cast("binary"), 1, FIRST_DIGIT)
    # upper case is one byte in UTF-8, so lower-casing the head equals the head of the lower-cased text
    first = slim.select(_lower_bytes(head).alias("digit"))
    heads = _named(first.groupBy("digit").agg(F.count("*").alias("n_open")))
    merged = arrow_map(slim, _merge_batch, "ids array<long>, body binary, text_sha256 string")
    merged = merged.withColumn("digit", F.substring("body", 1, FIRST_DIGIT))
    split = (
        merged.join(heads, "digit", "left")
        # a merged row that holds every row of its head is a whole group already
        .withColumn("grp", F.when(F.col("n_open") > F.size("ids"), F.col("grp")))
        .select("ids", "text_sha256", "grp", *_next(FIRST_DIGIT))
    )
    rounds = [materialize(split.withColumn("row", F.monotonically_increasing_id()))]

    width = FIRST_DIGIT
    finished = []
    while True:
        table = rounds[-1]
        finished.append(table.filter("grp is null or ended").select("row", "ids", "text_sha256", "grp", F.lit(len(rounds)).alias("round")))
        live = table.filter("grp is not null and not ended").select("row", "ids", "text_sha256", "grp", "body")
        if live.isEmpty():
            break
        width *= GROWTH
        live = live.withColumnRenamed("grp", "old").withColumn("digit", F.substring("body", 1, width))
        named = _named(live.groupBy("old", "digit").agg(F.count("*").alias("n_open")))
        split = live.join(named, ["old", "digit"], "left").select("row", "ids", "text_sha256", "grp", *_next(width))
        rounds.append(materialize(split))

    classes = finished[0]
    for more in finished[1:]:
        classes = classes.unionByName(more)
    # groups of one merged row are whole; the others add up over their rows
    shared = classes.filter("grp is not null")
    totals = shared.groupBy("round", "grp").agg(
        F.sum(F.size("ids")).cast("long").alias("group_size"),
        F.max(F.struct(F.element_at("ids", 1).alias("keep_id"), "row")).alias("best"),
    )
    wide = shared.join(totals, ["round", "grp"]).select("ids", "text_sha256", "group_size", F.col("best.keep_id").alias("keep_id"), (F.col("best.row") == F.col("row")).alias("holds"))
    own = classes.filter("grp is null").select("ids", "text_sha256", F.size("ids").cast("long").alias("group_size"), F.element_at("ids", 1).alias("keep_id"), F.lit(True).alias("holds"))
    return (
        own.unionByName(wide)
        .select("text_sha256", "group_size", "keep_id", "holds", F.posexplode("ids").alias("pos", "doc_id"))
        .select("doc_id", "keep_id", "group_size", (F.col("holds") & (F.col("pos") == 0)).alias("kept"), "text_sha256")
    )


def _lower_bytes(head):
    """A-Z to a-z in UTF-8 bytes: latin1 maps bytes to characters one to one."""
    return F.encode(F.translate(F.decode(head, "ISO-8859-1"), UPPER, LOWER), "ISO-8859-1")


def _named(groups: DataFrame) -> DataFrame:
    """Open groups (at least two rows) under numbers of their own, fixed by writing them."""
    return materialize(groups.filter("n_open > 1").withColumn("grp", F.monotonically_increasing_id()))


def _next(width: int) -> list:
    """What a row takes into the next round: the bytes behind the digit, or the mark that its text has ended."""
    ended = F.length("digit") < F.lit(width)
    rest = F.expr(f"substring(body, {width + 1})")
    return [ended.alias("ended"), F.when(F.col("grp").isNotNull() & ~ended, rest).alias("body")]


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    The row with the largest id of a group stays. Ids that lose all their rows go by an anti join, so
    that no text is shuffled for it. Where an id has several rows and keeps some of them (null ids
    among them), a digest tells its rows apart; which texts are equal was decided without one.
    """
    found = materialize(exact_duplicates(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"))
    ids = found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("n_kept"))
    losing = materialize(ids.filter("n_kept < n").select("__id", (F.col("n_kept") > 0).alias("some")))
    own = docs[id_col].cast("long")
    whole = docs.join(losing.select("__id"), own.eqNullSafe(F.col("__id")), "left_anti")
    some = losing.filter("some").select("__id")
    if some.isEmpty():
        return whole
    kept = found.filter("kept").join(some, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    digest = F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))).cast("binary"), 256)
    mixed = docs.withColumns({"__own": own, "__digest": digest}).join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__sha")), "left_semi")
    return whole.unionByName(mixed.dropDuplicates(["__own", "__digest"]).drop("__own", "__digest"))
