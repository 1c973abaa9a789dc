"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree domain - language - source by weights. What a child cannot use (its
documents, times the allowed epochs) goes to its siblings by their weights; only what no child can
use goes back to the parent's siblings. Each leaf then reads its documents in a seeded order of its
own for each epoch: whole epochs, and of the last one the prefix that fills the budget.

Up to ``MAX_LEAVES`` leaves the driver does the budgeting, from one row per leaf; beyond, the same
shares come from windows over siblings. A leaf's prefix ends at one document, which is found without ordering the leaf in one task: totals per hash range,
then the one range in which the budget runs out. The documents themselves are only filtered by that
point, so their texts are never shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_LEAVES = 100_000
RANGES = 4096

#: Production weights. A name that is missing weighs as much as the least of its named siblings.
WEIGHTS = {
    "web": (0.6, {"en": (0.55, {}), "de": (0.15, {}), "fr": (0.15, {}), "es": (0.15, {})}),
    "books": (0.25, {"en": (0.5, {}), "de": (0.2, {}), "fr": (0.2, {}), "es": (0.1, {})}),
    "forum": (0.15, {"en": (0.7, {}), "de": (0.1, {}), "fr": (0.1, {}), "es": (0.1, {})}),
}


class Leaf(NamedTuple):
    path: tuple[str, ...]
    available: int


def _whole(weight: float) -> int:
    """A weight as a whole number of billionths, so that shares are exact; only a weight of 0 becomes 0."""
    return max(1, round(weight * 10**9)) if weight > 0 else 0


def share_out(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Whole-number shares by weight, none above its room; shortages go to the others until all is used or all are full.

    Those that are full first (least room by weight) take their room, the others share the rest by
    weight, rounded down; tokens left by rounding go one by one to the heaviest (ties: the first).
    """
    whole = [_whole(w) for w in weights]
    got = [0] * len(whole)
    open_ = sorted((i for i, w in enumerate(whole) if w), key=lambda i: (room[i] / whole[i], i))
    left, total = budget, sum(whole)
    while open_ and room[open_[0]] * total <= whole[open_[0]] * left:
        i = open_.pop(0)
        got[i], left, total = room[i], left - room[i], total - whole[i]
    for i in open_:
        got[i] = left * whole[i] // total
    for i in sorted(open_, key=lambda i: (-whole[i], i))[: left - sum(got[i] for i in open_)]:
        got[i] += 1
    return got


def _children(leaves: list[Leaf], weights: dict) -> dict[str, tuple[float, dict, list[Leaf]]]:
    """Children of a node by name: weight, weights below, leaves."""
    named = {k: (v if isinstance(v, tuple) else (v, {})) for k, v in weights.items()}
    least = min((w for w, _ in named.values()), default=1.0)
    found: dict[str, list[Leaf]] = {}
    for leaf in sorted(leaves):
        found.setdefault(leaf.path[0], []).append(Leaf(leaf.path[1:], leaf.available))
    return {name: (*named.get(name, (least, {})), own) for name, own in found.items()}


def usable(leaves: list[Leaf], weights: dict) -> int:
    """Tokens that a node can take: those of its children, but for children of weight 0."""
    if not leaves or not leaves[0].path:
        return sum(x.available for x in leaves)
    return sum(usable(own, below) for weight, below, own in _children(leaves, weights).values() if weight > 0)


def budgets(leaves: list[Leaf], weights: dict, total: int, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf. A child of weight 0 takes nothing, and is no room to its ancestors either."""
    if not leaves:
        return {}
    if len(leaves[0].path) == 0:
        return {(): min(total, sum(x.available for x in leaves) * max_epochs)}
    children = _children(leaves, weights)
    shares = share_out(total, [w for w, _, _ in children.values()], [usable(own, below) * max_epochs if w > 0 else 0 for w, below, own in children.values()])
    return {
        (name, *path): tokens
        for (name, (_, below, own)), share in zip(children.items(), shares, strict=True)
        for path, tokens in budgets(own, below, share, max_epochs).items()
    }


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number: 0-6 web, 7-13 books, others forum."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1)
    return F.when(number == "", "web").when(number.cast("bigint") < 7, "web").when(number.cast("bigint") < 14, "books").otherwise("forum")


def _keyed(docs: DataFrame, tokens: Column | None) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    count = F.regexp_count(text, F.lit("[^ \t\n\r\f]+")) if tokens is None else tokens
    return docs.withColumns({
        "__domain": domain_of(docs["source"]), "__lang": F.coalesce(docs["lang"], F.lit("")), "__source": F.coalesce(docs["source"], F.lit("")),
        "__tokens": count.cast("long"), "__id": docs["doc_id"].cast("long"),
    })


_LEAF = ["__domain", "__lang", "__source"]


def _order(seed: int) -> Column:
    """A leaf's order in its last, partial epoch."""
    return F.xxhash64(F.coalesce("__id", F.lit(0)), F.lit(seed), F.col("__full"))


def _named(weights: dict, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], int]]:
    """All nodes that have a weight by name."""
    found = []
    for name, value in weights.items():
        weight, below = value if isinstance(value, tuple) else (value, {})
        found += [((*path, name), _whole(weight)), *_named(below, (*path, name))]
    return found


def _weighed(rows: DataFrame, weights: dict, depth: int) -> DataFrame:
    """Nodes of one level with ``w``: their own weight, or the least of their named siblings, or 1. The weights are configuration."""
    own = [(*p, w) for p, w in _named(weights) if len(p) == depth]
    least: dict[tuple[str, ...], int] = {}
    for *path, w in own:
        least[tuple(path[:-1])] = min(w, least.get(tuple(path[:-1]), w))
    names = _LEAF[:depth]
    spark = rows.sparkSession
    given = spark.createDataFrame(own, ", ".join([*[f"{n} string" for n in names], "__own long"]))
    rows = rows.join(F.broadcast(given), names, "left")
    if depth == 1:
        default = F.lit(least.get((), _whole(1.0)))
    else:
        siblings = spark.createDataFrame([(*p, w) for p, w in least.items()], ", ".join([*[f"{n} string" for n in names[:-1]], "__least long"]))
        rows = rows.join(F.broadcast(siblings), names[:-1], "left")
        default = F.coalesce("__least", F.lit(_whole(1.0)))
    return rows.withColumn("w", F.coalesce("__own", default).cast("long")).drop("__own", "__least")


def _share_out(rows: DataFrame, depth: int) -> DataFrame:
    """``share_out`` for all nodes of a level at once: rows with ``w``, ``room`` and their parent's ``budget`` get ``got``.

    A window over the siblings of each parent: rows are totals of a few numbers, never documents.
    """
    parents, name = (_LEAF[: depth - 1] or [F.lit(0)]), _LEAF[depth - 1]
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("w", "room", "budget")}
    taking = F.col("w") > 0
    siblings = Window.partitionBy(*parents)
    order = siblings.orderBy(F.when(taking, F.col("room") / F.col("w")).asc_nulls_last(), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("room").over(before), F.lit(0)).cast("decimal(19,0)"))
    rows = rows.withColumn("__open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(19,0)"))
    fits = taking & (wide["room"] * F.col("__open") <= wide["w"] * (wide["budget"] - F.col("__before")).cast("decimal(19,0)"))
    rows = rows.withColumn("__full", F.min(fits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rows = rows.withColumn("__left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("room"))).over(siblings), F.lit(0)))
    rows = rows.withColumn("__rest", F.sum(F.when(~F.col("__full"), F.col("w"))).over(siblings))
    rows = rows.withColumn("got", F.when(F.col("__full"), F.col("room")).when(taking, F.expr("(cast(__left as decimal(19,0)) * cast(w as decimal(19,0))) div cast(__rest as decimal(19,0))")).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("__odd", F.col("__left") - F.sum(F.when(~F.col("__full"), F.col("got"))).over(siblings))
    rows = rows.withColumn("__turn", F.row_number().over(siblings.orderBy(F.when(~F.col("__full") & taking, F.col("w")).desc_nulls_last(), name)))
    more = ~F.col("__full") & taking & (F.col("__turn") <= F.col("__odd"))
    return rows.withColumn("got", F.col("got") + F.when(more, 1).otherwise(0)).drop("__before", "__open", "__full", "__left", "__rest", "__odd", "__turn")


def _budgets_of_many(sums: DataFrame, weights: dict, total: int, max_epochs: int) -> DataFrame:
    """``budgets`` without the driver, for any number of leaves: rooms go up the three levels, budgets come down."""
    nodes = {}
    below = sums.withColumn("room", F.col("n") * max_epochs)
    for depth in (3, 2, 1):
        found = _weighed(below, weights, depth)
        nodes[depth] = found.withColumn("room", F.when(F.col("w") > 0, F.col("room")).otherwise(F.lit(0).cast("long")))
        if depth > 1:
            below = nodes[depth].groupBy(*_LEAF[: depth - 1]).agg(F.sum("room").alias("room"))
    shares = _share_out(nodes[1].withColumn("budget", F.lit(total).cast("long")), 1)
    for depth in (2, 3):
        above = shares.select(*_LEAF[: depth - 1], F.col("got").alias("budget"))
        shares = _share_out(nodes[depth].join(above, _LEAF[: depth - 1]), depth)
    return shares.select(*_LEAF, "n", F.col("got").alias("__budget"))


class _Plan(NamedTuple):
    rows: DataFrame
    few: bool  # at most ``MAX_LEAVES`` rows

    def hint(self, rows: DataFrame) -> DataFrame:
        """Rows of leaves are broadcast only where there are few; else the join is Spark's choice."""
        return F.broadcast(rows) if self.few else rows


def _leaf_budgets(keyed: DataFrame, weights: dict, total: int | None, share: float, max_epochs: int) -> _Plan:
    """One row per leaf: its budget, whole epochs and the rest. Both ways give the same rows."""
    spark = keyed.sparkSession
    sums = keyed.groupBy(*_LEAF).agg(F.sum("__tokens").alias("n"))
    rows = sums.limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        sums = materialize(sums)
        whole = total if total is not None else int((sums.agg(F.sum("n")).first()[0] or 0) * share)
        shares = _budgets_of_many(sums, weights, whole, max_epochs)
        cell = {"__full": "__budget div n", "__part": "__budget % n"}
        return _Plan(materialize(shares.select(*_LEAF, "__budget", *[F.expr(f"if(n > 0, {e}, 0)").cast("long").alias(c) for c, e in cell.items()])), False)
    leaves = [Leaf((r[0], r[1], r[2]), r["n"]) for r in rows]
    everything = sum(x.available for x in leaves)
    found = budgets(leaves, weights, int(everything * share) if total is None else total, max_epochs)
    schema = "__domain string, __lang string, __source string, __budget long, __full long, __part long"
    table = [(*x.path, found[x.path], *(divmod(found[x.path], x.available) if x.available else (0, 0))) for x in leaves]
    return _Plan(spark.createDataFrame(table, schema), True)


def _plan(keyed: DataFrame, weights: dict, total: int | None, share: float, max_epochs: int, seed: int) -> _Plan:
    """One row per leaf: whole epochs, and where the partial one ends."""
    plan = _leaf_budgets(keyed, weights, total, share, max_epochs)
    slim = keyed.select(*_LEAF, "__id", "__tokens").join(plan.hint(plan.rows.filter("__part > 0")), _LEAF).withColumn("__h", _order(seed))
    slim = slim.withColumn("__range", F.floor(F.col("__h") / F.lit((1 << 64) // RANGES)))
    ranges = slim.groupBy(*_LEAF, "__part", "__range").agg(F.sum("__tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("__range"))
    last = ranges.withColumn("upto", upto).filter((F.col("upto") >= F.col("__part")) & (F.col("upto") - F.col("n") < F.col("__part")))
    last = last.select(*_LEAF, "__range", (F.col("upto") - F.col("n")).alias("before"))  # one range per leaf
    inside = slim.join(plan.hint(last), [*_LEAF, "__range"])
    running = F.sum("__tokens").over(Window.partitionBy(*_LEAF).orderBy("__h", "__id", "__tokens").rowsBetween(Window.unboundedPreceding, 0))
    ends = inside.withColumn("upto", F.col("before") + running).filter((F.col("upto") >= F.col("__part")) & (F.col("upto") - F.col("__tokens") < F.col("__part")))
    cut = F.struct(F.col("__h").alias("h"), F.coalesce("__id", F.lit(0)).alias("id"), "__tokens", (F.col("__part") - F.col("upto") + F.col("__tokens")).alias("taken"))
    ends = ends.groupBy(*_LEAF).agg(F.min(cut).alias("__cut"))
    return _Plan(plan.rows.join(plan.hint(ends), _LEAF, "left"), plan.few)


def _chosen(docs: DataFrame, tokens: Column | None, weights: dict, total: int | None, share: float, max_epochs: int, seed: int) -> DataFrame:
    keyed = _keyed(docs, tokens)
    plan = _plan(keyed, weights, total, share, max_epochs, seed)
    rows = keyed.join(plan.hint(plan.rows), _LEAF)
    own = F.struct(_order(seed).alias("h"), F.coalesce("__id", F.lit(0)).alias("id"), "__tokens")
    end = F.struct(F.col("__cut.h").alias("h"), F.col("__cut.id").alias("id"), F.col("__cut.__tokens").alias("__tokens"))
    # null: not in the prefix; 0: in it, without tokens
    return rows.withColumn("__last", F.when(F.col("__cut").isNotNull() & (own < end), F.col("__tokens")).when(own == end, F.col("__cut.taken")))


def mix(docs: DataFrame, weights: dict | None = None, total: int | None = None, share: float = 0.8, max_epochs: int = 2, seed: int = 7, tokens: Column | None = None) -> DataFrame:
    """One row per document and epoch in which it is read: doc_id, domain, lang, source, epoch, n_tokens, taken_tokens, leaf_budget.

    ``total``: tokens to give out, or ``share`` of what there is. ``tokens``: a document's size, its
    white-space words by default. The taken tokens of a leaf add up to its budget; only the document
    at the end of a prefix is taken in part (its first tokens). Null languages and sources are leaves
    of their own (empty names); documents without tokens are read in whole epochs only, and in a
    prefix before its end. Repeated rows of one id stand together: all are read or none. An empty
    table gives an empty result.
    """
    rows = _chosen(docs, tokens, WEIGHTS if weights is None else weights, total, share, max_epochs, seed)
    whole = F.when(F.col("__full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("__full") - 1, F.lit(0))), lambda e: F.struct(e.alias("epoch"), F.col("__tokens").alias("taken"))))
    none = F.array().cast("array<struct<epoch:bigint,taken:bigint>>")
    part = F.when(F.col("__last").isNotNull(), F.array(F.struct(F.col("__full").alias("epoch"), F.col("__last").cast("long").alias("taken"))))
    return rows.withColumn("__read", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(part, none)))).select(
        F.col("__id").alias("doc_id"), F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"),
        F.col("__read.epoch").alias("epoch"), F.col("__tokens").alias("n_tokens"), F.col("__read.taken").alias("taken_tokens"), F.col("__budget").alias("leaf_budget"),
    )


def select_documents(docs: DataFrame, weights: dict | None = None, share: float = 0.9, seed: int = 7, tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that one epoch's mixture reads (the last of a leaf perhaps in part, kept whole), with all their columns."""
    rows = _chosen(docs, tokens, WEIGHTS if weights is None else weights, None, share, 1, seed)
    # a document without tokens is no burden on any budget
    return rows.filter((F.col("__full") > 0) | F.col("__last").isNotNull() | (F.col("__tokens") == 0)).select(*[docs[c] for c in docs.columns])
