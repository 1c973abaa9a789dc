"""Toxicity by weak supervision.

Voters look at a text and vote toxic, clean, or abstain: word lists by language, lexicons mined from
labelled rows (whole words and word beginnings), patterns of address and shouting, and the human
label itself. A generative label model estimates how often each voter fires on toxic and on clean
texts (expectation maximisation with a class prior) and, from what those accuracies leave
unexplained, which voters are correlated; correlated voters share one vote. A linear classifier is
then trained on the posterior labels and scores texts without any label.

Fitting uses at most about ``sample`` labelled rows (a documented bound, drawn by a hash of the id);
scoring reads every whole text once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices

SAMPLE = 20_000
LEAST = 20  # labelled rows below which nothing is estimated
LEXICON_SIZE = 600
MINED_VOTERS = 12
STEMS = (4, 5, 6)

#: Hand-written seed lexicons: insults by language.
SEEDS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile filth vermin garbage jerk creep coward freak fool",
    "de": "idiot trottel blödmann arschloch abschaum dummkopf versager widerlich wertlos mistkerl schwachkopf depp hurensohn drecksack ekelhaft",
    "fr": "idiot imbécile crétin abruti connard salaud ordure minable dégoûtant débile raclure nul pitoyable sale enfoiré",
    "es": "idiota imbécil estúpido tonto basura escoria patético asqueroso inútil perdedor payaso cabrón pendejo gilipollas miserable",
}
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS = ("you are a", "you're a", "you are such", "du bist", "tu es un", "eres un")


def shape(text: str) -> list[float]:
    """What a text's form says: shouting, runs of marks, masked letters, direct address, emptiness."""
    n = len(text) or 1
    low = text.lower()
    caps = len(text) - len(text.translate(_NO_CAPS))
    return [
        float(caps / n > 0.5),
        float("!!" in text),
        float("***" in text),
        float(any(a in low for a in _ADDRESS)),
        float(not text),
    ]


_NO_CAPS = dict.fromkeys(range(65, 91))
SHAPES = 5


def word_features(text: str) -> set[str]:
    """Distinct words of a text, as ``=word``, and their beginnings, as ``word``."""
    words = set(_WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}


class Matcher:
    """Finds the features of a lexicon in a text by one pass of an Aho-Corasick automaton."""

    def __init__(self, lexicon: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple[int, bool]]] = {}
        for i, f in enumerate(lexicon):
            entries.setdefault(f.removeprefix("="), []).append((i, f[0] == "="))
        for key, own in entries.items():
            self.automaton.add_word(key, (len(key), own))
        self.empty = not entries
        self.automaton.make_automaton()

    def find(self, low: str) -> set[int]:
        """Numbers of the features in a lower-cased text: beginnings at a word's start, words from end to end."""
        found: set[int] = set()
        if self.empty or not low:
            return found
        for end, (n, own) in self.automaton.iter(low):
            at = end - n + 1
            if at and (c := low[at - 1]) != "_" and c.isalpha():
                continue
            stops = end + 1 == len(low) or not low[end + 1].isalpha()
            found.update(i for i, whole in own if stops or not whole)
        return found


@dataclass
class Model:
    """lexicon: features; weights: of the features, the shapes and the intercept; voters: name, (rate if toxic, rate if clean), share of its vote."""

    lexicon: list[str]
    weights: list[float]
    voters: list[tuple[str, float, float, float]] = field(default_factory=list)
    correlated: list[tuple[str, str, float]] = field(default_factory=list)


def label_model(votes: np.ndarray, prior: float, rounds: int = 25, link: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Rates, shares and posterior of voters from their votes (rows x voters of -1, 0, 1), without true labels.

    Rates: (voters, 2 classes, 3 votes). Two voters are linked when, given the estimated class, their
    firing is correlated beyond ``link``; a voter's share is one over the links it has, itself included.
    """
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    toxic = np.clip((votes == 1).sum(1) - (votes == -1).sum(1), -2, 2)
    post = 1 / (1 + np.exp(-2.0 * (toxic - 0.5)))
    share = np.ones(m)
    linked: list[tuple[int, int, float]] = []
    for step in range(rounds):
        weight = np.stack([1 - post, post])
        rates = np.einsum("cn,nmv->mcv", weight, hot) + 0.5
        rates /= rates.sum(2, keepdims=True)
        if step in (rounds // 2, rounds - 5):
            # what the classes leave unexplained
            fired = (votes != 0).astype(np.float64)
            expected = weight.T @ (1 - rates[:, :, 1]).T
            rest = fired - expected
            spread = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(spread, spread)
            linked = [(i, j, float(corr[i, j])) for i in range(m) for j in range(i + 1, m) if abs(corr[i, j]) > link]
            share = 1 / (1 + np.array([sum(abs(c) for a, b, c in linked if i in (a, b)) for i in range(m)]))
        odds = np.log(rates[:, 1] / rates[:, 0]) * share[:, None]
        total = np.einsum("nmv,mv->n", hot, odds) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return rates, share, post, linked


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1e-4, rounds: int = 600, rate: float = 2.0) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by full-batch accelerated descent."""
    w = np.zeros(x.shape[1])
    ahead = w.copy()
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - target) / len(target) * 4 + ridge * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, toxic documents) of each batch."""
    for batch in slices(batches):
        every: Counter[str] = Counter()
        bad: Counter[str] = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = word_features(text or "")
            every.update(found)
            if toxic:
                bad.update(found)
        keep = [f for f in every if bad[f]]  # a feature that is never toxic in a batch only adds to the clean count below
        rest = [f for f in every if not bad[f]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep + rest, pa.string()), pa.array([every[f] for f in keep + rest], pa.int64()), pa.array([bad[f] for f in keep + rest], pa.int64())],
            names=["feature", "n", "bad"],
        )


def _observe(lexicon: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in slices(batches):
            found, shapes = [], []
            for text in batch.column(0).to_pylist():
                found.append(sorted(matcher.find((text or "").lower())))
                shapes.append(shape(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64())), batch.column(1)], names=["found", "shape", "toxic"])

    return of


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, size: int = LEXICON_SIZE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled rows (labels: doc_id, toxic 0/1) for which ``usable`` (a condition on doc_id) holds.

    Null labels are ignored; a document labelled twice counts as toxic if any label says so; of rows
    with one id the greatest text counts. With fewer than ``least`` labelled rows, or without any toxic
    (or any clean) label, nothing can be estimated: the model is the seed lexicons with fixed weights.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1_000_000)) < F.lit(int(1e6 * sample / total)))
    # at most about `sample` rows of two numbers: safe to send to every executor
    mine = F.broadcast(known.select(F.col("doc_id").alias("__id"), "toxic"))
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    rows = materialize(texts.join(mine, F.col("__doc") == F.col("__id")).groupBy("__id", "toxic").agg(F.max("text").alias("text")).select("text", "toxic"))

    counted = arrow_map(rows, _count, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter("bad > 0")
    split = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = split.get(1, 0), split.get(0, 0)
    mined: list[str] = []
    if n_bad and n_good:
        base = n_bad / (n_bad + n_good)
        share, good = F.col("bad") / F.col("n"), F.col("n") - F.col("bad")
        # log-likelihood ratio against chance; the bound allows for as many trials as there are features
        ratio = F.col("bad") * F.log(share / base) + F.when(good > 0, good * F.log((1 - share) / (1 - base))).otherwise(0.0)
        trials = float(np.log(max(2, counted.count()))) + 2.0
        best = counted.withColumn("gain", ratio).filter((F.col("gain") > trials) & (share > min(0.9, 2 * base)))
        mined = [r["feature"] for r in best.orderBy(F.desc("gain"), "feature").limit(size).collect()]
    seeds = [(lang, f"={w}") for lang, words in SEEDS.items() for w in words.split()]
    lexicon = list(dict.fromkeys([*mined, *(f for _, f in seeds)]))
    number = {f: i for i, f in enumerate(lexicon)}

    seen = arrow_map(rows, _observe(lexicon), "found array<int>, shape array<double>, toxic int").toPandas()  # at most about `sample` rows
    x = np.zeros((len(seen), len(lexicon) + SHAPES + 1))
    for i, (found, marks) in enumerate(zip(seen["found"], seen["shape"], strict=True)):
        x[i, list(found)] = 1
        x[i, len(lexicon) : -1] = marks
    x[:, -1] = 1
    gold = seen["toxic"].to_numpy(int) if len(seen) else np.zeros(0, int)

    names, columns = [], []
    for lang in SEEDS:
        own = [number[f] for other, f in seeds if other == lang]
        names.append(f"seed words {lang}")
        columns.append(x[:, own].any(1) * 1)
    for k in range(MINED_VOTERS):
        own = [number[f] for f in mined[k::MINED_VOTERS]]
        if own:
            names.append(f"mined lexicon {k}")
            columns.append(x[:, own].any(1) * 1)
    for k, name in enumerate(("shouting", "exclamation", "masked letters", "address")):
        names.append(name)
        columns.append(x[:, len(lexicon) + k] * 1)
    names.append("no known word")
    columns.append(-1 * ~x[:, : len(lexicon)].any(1))
    names.append("human label")
    columns.append(gold * 2 - 1)
    if len(seen) < least or not (n_bad and n_good):
        weights = [4.0 * (f in {s for _, s in seeds}) for f in lexicon] + [0.0] * SHAPES + [-2.0]
        return Model(lexicon, weights)
    votes = np.stack(columns, axis=1).astype(np.int8)
    names = [n for n, used in zip(names, votes.any(0), strict=True) if used]
    votes = votes[:, votes.any(0)]
    rates, share, post, linked = label_model(votes, float(np.clip(gold.mean(), 0.01, 0.99)))
    weights = logistic(x, post)
    return Model(
        lexicon,
        [float(w) for w in weights],
        [(n, float(r[1, 2]), float(r[0, 2]), float(s)) for n, r, s in zip(names, rates, share, strict=True)],
        [(names[a], names[b], c) for a, b, c in linked],
    )


def _score(lexicon: list[str], weights: list[float]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w, tail = Matcher(lexicon), weights, weights[len(lexicon) :]
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                total = sum(w[i] for i in matcher.find(text.lower())) + sum(a * b for a, b in zip(shape(text), tail, strict=False)) + tail[-1]
                out.append(1 / (1 + float(np.exp(-min(30.0, max(-30.0, total))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return of


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: 0 to 1, higher where toxic is likelier. Null texts count as empty; repeated rows score alike."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(slim, _score(model.lexicon, model.weights), "doc_id long, score double")


def _rejects(lexicon: list[str], weights: list[float], threshold: float):
    scored = _score(lexicon, weights)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("__text")
            texts = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            keep = pa.compute.less(next(scored(iter([texts]))).column(1), threshold)
            yield batch.select([n for n in batch.schema.names if n != "__text"]).filter(keep)

    return of


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns. Null texts count as empty; repeated rows go or stay together; an empty table stays empty."""
    marked = docs.withColumn("__text", docs[text_col])
    return arrow_map(marked, _rejects(model.lexicon, model.weights, threshold), docs.schema)
