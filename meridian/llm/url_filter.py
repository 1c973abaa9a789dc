"""URL filtering by association rules, as DataFrame expressions only.

Curated rules (host and path prefix) decide the URLs they cover. Their verdicts, a person's list of
unwanted host words, and "allow" for all other URLs (most of the web is wanted; a rule has to win
against that) are the training labels. FP-growth mines combinations of URL tokens (host parts, path parts,
query keys, form) that come with a verdict. Tokens that stand in exactly the same URLs are one item
there. A token with one verdict only is a rule by itself, and one that stands in all URLs tells
nothing: neither is combined with others, as no combination with it could be more confident. All
other frequent tokens of a URL are combined, however many. Single tokens against the default verdict are counted
exactly besides: they need a number of rows, not a share of the table, and a person's words need
one row. Rules below a confidence go, and so does a rule that a shorter one explains as well. A URL that no curated rule covers takes the verdict of the
strongest mined rule whose tokens it has, found through an inverted index: every rule is filed under
the rarest of its tokens.

URLs with equal tokens are judged once: matching runs over distinct token sets.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.7
REPEAT = 10_000  # rows of one token set that one task writes out
MIN_COUNT = 25  # rows with its verdict that make a single token a rule, however large the table


class HostRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = [
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
]

#: Host words that a person has marked as unwanted: block labels for URLs that no curated rule covers.
SEED_BLOCK = ("casino", "pills", "bets", "spam", "ads")
SEED_TOKENS = [f"host:{w}" for w in SEED_BLOCK]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#``, with A-Z lower-cased. Path: from there up to ``?``, ``#``. Empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def curated(host: Column, path: Column, rules: list[HostRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that covers a host (or a subdomain) and a path's beginning; null without one.

    Length: of host and path together; equal lengths: the first in alphabetical order. ``rules`` is a
    configuration of at most a few hundred entries.
    """
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL. Numbers count as one token, so that page numbers don't multiply them."""
    def general(parts: Column, kind: str) -> Column:
        plain = F.filter(F.transform(parts, lambda p: F.regexp_replace(F.lower(p), "[0-9]+", "0")), lambda p: p != "")
        return F.transform(plain, lambda p: F.concat(F.lit(kind), p))

    tail = F.regexp_extract(F.coalesce(url, F.lit("")), "[?]([^#]*)", 1)
    return F.array_sort(F.array_distinct(F.concat(
        general(F.split(host, "[.-]"), "host:"),
        general(F.split(path, "[/._-]"), "path:"),
        general(F.transform(F.split(tail, "&"), lambda p: F.substring_index(p, "=", 1)), "query:"),
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), "^([a-zA-Z]+)://", 1)), F.concat(F.lit("top:"), F.substring_index(host, ".", -1))),
    )))


def single_rules(labelled: DataFrame, default: str, seeds: list[str], min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """Rules of one token for verdicts other than ``default``, counted over all rows.

    A token needs ``min_count`` rows with the verdict and a lift above 1; one of ``seeds`` needs neither.
    """
    verdicts = labelled.groupBy("label").agg(F.count("*").alias("of_label")).withColumn("rows", F.sum("of_label").over(Window.partitionBy()))  # one row per verdict
    counts = labelled.select("label", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.count("*").alias("n"))
    by_token = counts.groupBy("token").agg(F.sum("n").alias("of_token"), F.collect_list(F.struct("label", "n")).alias("by"))
    each = by_token.select("token", "of_token", F.explode("by").alias("x")).select("token", "of_token", F.col("x.label").alias("label"), F.col("x.n").alias("n")).join(F.broadcast(verdicts), "label")
    found = each.select(
        F.array("token").alias("antecedent"), F.col("label").alias("verdict"), (F.col("n") / F.col("of_token")).alias("confidence"), (F.col("n") / F.col("rows")).alias("support"),
        (F.col("n") / F.col("of_token") / (F.col("of_label") / F.col("rows"))).alias("lift"), "n", F.col("token").isin(seeds).alias("seed"),
    )
    enough = F.col("seed") | ((F.col("n") >= min_count) & (F.col("lift") > 1.0))
    return found.filter((F.col("verdict") != default) & (F.col("confidence") >= min_confidence) & enough).drop("n", "seed")


def frequent_tokens(labelled: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame, float]:
    """Rows (tokens, label) counted (row, n, tokens, label); the tokens frequent enough to be in any combination; the number of rows.

    Of tokens with the same rows (as many, with the same sum of the rows' hashes) the first in
    alphabetical order stands for all. ``told``: by how much (the logarithm of the ratio) its share of
    any verdict differs from that verdict's share of all rows; ``sole``: its verdict, if it has only one;
    ``lift``: of that verdict; ``everywhere``: whether it stands in all rows.
    """
    # rows with equal tokens and label are alike: counted, not repeated
    sets = materialize(labelled.groupBy("tokens", "label").agg(F.count("*").alias("n")).withColumn("row", F.xxhash64("tokens", "label")))
    verdicts = materialize(sets.groupBy("label").agg(F.sum("n").alias("of_label")))  # one row per verdict
    rows = float(sum(r["of_label"] for r in verdicts.collect()))
    by_label = sets.select("n", "row", "label", F.explode("tokens").alias("token")).groupBy("token", "label").agg(F.sum("n").alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("mark"))
    lift = (F.col("n") / F.col("of_token")) / (F.col("of_label") / rows)
    totals = by_label.groupBy("token").agg(F.sum("n").alias("of_token"), F.sum("mark").alias("mark"))
    frequent = totals.filter(F.col("of_token") >= rows * min_support)  # at most 1 / min_support times the tokens of a row
    sole = F.max(F.when(F.col("n") == F.col("of_token"), F.struct("label", lift.alias("lift"))))
    told = by_label.drop("mark").join(frequent, "token").join(F.broadcast(verdicts), "label").groupBy("token", "of_token", "mark").agg(F.max(F.abs(F.log(lift))).alias("told"), sole.alias("sole"))
    named = told.groupBy("of_token", "mark").agg(F.min("token").alias("token"), F.max("told").alias("told"), F.max("sole").alias("sole"))
    return sets, materialize(named.select("token", "of_token", "told", F.col("sole.label").alias("sole"), F.col("sole.lift").alias("lift"), (F.col("of_token") == rows).alias("everywhere"))), rows


def transactions(sets: DataFrame, named: DataFrame, max_items: int | None = None) -> DataFrame:
    """Transactions (items: array) for mining, one per row, its verdict among them: the ``named`` tokens of the row.

    ``max_items``: only so many, the most telling (ties in alphabetical order); None: all.
    """
    kept = sets.select("row", "n", "tokens", "label", F.explode_outer("tokens").alias("token")).join(named.select("token", "told"), "token", "left")
    order = F.array_sort(F.collect_list(F.when(F.col("told").isNotNull(), F.struct((-F.round("told", 9)).alias("t"), F.col("token").alias("token")))))
    chosen = kept.groupBy("row", "n", "tokens", "label").agg(F.transform(order if max_items is None else F.slice(order, 1, max_items), lambda x: x["token"]).alias("items"))
    made = chosen.select(F.array_append("items", F.concat(F.lit("verdict:"), F.col("label"))).alias("items"), "n")
    # repeated as often as there are rows, a frequent one by several tasks
    dealt = made.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEAT)))).repartition("items", "part")
    return dealt.select("items", F.explode(F.sequence(F.col("part") * REPEAT + 1, F.least("n", (F.col("part") + 1) * REPEAT)))).select("items")


def items(labelled: DataFrame, min_support: float, max_items: int | None = None) -> DataFrame:
    """Transactions of rows (tokens, label) with all frequent tokens, or the ``max_items`` most telling ones of each row."""
    sets, named, _ = frequent_tokens(labelled, min_support)
    return transactions(sets, named, max_items)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow", seeds: list[str] | None = None) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support, lift) from rows (tokens, label).

    Combinations are all sets of tokens that occur with their verdict in at least ``min_support`` of the
    rows; single tokens come also from :func:`single_rules`, whatever their share. A rule goes if one
    with fewer tokens for the same verdict is at least as confident. So tokens of one verdict and tokens
    of all rows (see :func:`frequent_tokens`) are not mined with others. The number of sets does not
    depend on the number of rows, but doubles with each token of a URL that has several verdicts and
    stands mostly, not always, beside the others.
    """
    seeds = SEED_TOKENS if seeds is None else seeds
    sets, named, rows = frequent_tokens(labelled, min_support)
    mixed = named.filter("sole IS NULL AND NOT everywhere")
    frequent = materialize(FPGrowth(itemsCol="items", minSupport=min_support).fit(transactions(sets, mixed)).freqItemsets)
    is_verdict = lambda x: x.startswith("verdict:")
    split = frequent.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("antecedent"), F.get(F.filter("items", is_verdict), F.lit(0)).alias("verdict"), "freq")  # a row has one verdict, and so has a set
    of_verdict = split.filter("size(antecedent) = 0").select("verdict", F.col("freq").alias("of_label"))
    of_set = split.filter("verdict IS NULL").select("antecedent", F.col("freq").alias("of_set"))
    told = split.filter("verdict IS NOT NULL AND size(antecedent) > 0").join(of_set, "antecedent").join(F.broadcast(of_verdict), "verdict")
    confidence = F.col("freq") / F.col("of_set")
    found = told.select("antecedent", F.substring("verdict", 9, 100).alias("verdict"), confidence.alias("confidence"), (F.col("freq") / rows).alias("support"), (confidence / (F.col("of_label") / rows)).alias("lift"))
    alone = named.filter("sole IS NOT NULL").select(F.array("token").alias("antecedent"), F.col("sole").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("of_token") / rows).alias("support"), "lift")
    found = found.filter(F.col("confidence") >= min_confidence).unionByName(alone).filter("lift > 1.0")
    found = materialize(found.unionByName(single_rules(labelled, default, seeds, min_confidence)).dropDuplicates(["antecedent", "verdict"]))
    # a rule with one token less and no less confidence makes this one redundant
    parts = found.select("antecedent", "verdict", "confidence", F.explode(F.transform("antecedent", lambda x: F.array_except("antecedent", F.array(x)))).alias("part"))
    shorter = found.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    useless = parts.join(shorter, (parts["part"] == shorter["part"]) & (F.col("verdict") == F.col("v")) & (F.col("c") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    return materialize(found.join(useless, ["antecedent", "verdict"], "left_anti"))


def apply(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (tokens) to the strongest rule that each fulfils (tokens, mined): most confident, then best supported, then alphabetical."""
    frequency = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.withColumn("rule", F.monotonically_increasing_id()).select("rule", "antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("token"))
    rarest = filed.join(frequency, "token").groupBy("rule", "antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    posts = token_sets.select("tokens", F.explode("tokens").alias("token"))
    hits = posts.join(rarest, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.array_join("antecedent", " ").alias("antecedent"), F.col("verdict"))
    return hits.groupBy("tokens").agg(F.min(rank).alias("best")).select("tokens", F.struct(F.col("best.verdict").alias("verdict"), (-F.col("best.c")).alias("confidence"), F.col("best.antecedent").alias("antecedent")).alias("mined"))


def judge(pages: DataFrame, rules: list[HostRule] | None = None, default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, mined_rule, confidence.

    ``rule`` is the curated rule (null without); the verdict is its, else the strongest mined rule's,
    else ``default``. Null URLs and URLs without ``://`` have empty host and path. Repeated rows are
    each answered. An empty table gives an empty result. Other columns are not read.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    host, path = host_and_path(url)
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    text, verdict = curated(F.col("host"), F.col("path"), rules)
    known = parsed.select("page_id", "host", "path", text.alias("rule"), verdict.alias("ruled"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    seed = F.when(F.exists("tokens", lambda t: t.isin(SEED_TOKENS)), "block")
    labelled = known.select("tokens", F.coalesce("ruled", seed, F.lit(default)).alias("label"))
    sets = known.filter("ruled is null").select("tokens").distinct()
    judged = known.join(apply(sets, mine(labelled, min_support, min_confidence, default)), "tokens", "left")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "mined.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined.antecedent")).alias("mined_rule"), F.when(F.col("rule").isNull(), F.col("mined.confidence")).alias("confidence"),
    )
