"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text answers how far a text goes on inside the
language: a text is parsed greedily into longest phrases that occur in the labelled text, and the
language that needs the fewest phrases per character wins. Only letters (of any script, with their
marks) tell languages apart: a run of anything else counts as one blank.

Training text is bounded by documented parameters: whole texts of up to ``chars`` characters a
language, drawn in the order of a hash of their id. The automaton of n characters has at most 2n
states and 3n moves, so the tables sent to the workers have a fixed size per language. Moves by the
most frequent symbols are a dense table, those by all other symbols a sorted list: that is a matter
of speed, not of results.

Texts are parsed whole, in blocks of ``BLOCK`` characters that all advance together: one numpy step
moves every block of a batch, for every language, by one character.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, slices

CHARS = 32_000
LONGEST = 8  # texts longer than this part of the budget are drawn only where a language has no others
DENSE = 64  # symbols with a dense table
BLOCK = 512
LANES = 40_000


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state (1 is the start; 0 has none).

    Symbol 0 never occurs in a substring: it cuts the text.
    """
    moves: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1

    def split(p: int, c: int, to: int) -> int:
        """A copy of ``to`` for the substrings that end behind p, which the moves to ``to`` from there up now reach."""
        copy = len(moves)
        moves.append(dict(moves[to]))
        link.append(link[to])
        length.append(length[p] + 1)
        link[to] = copy
        while p and moves[p].get(c) == to:
            moves[p][c] = copy
            p = link[p]
        return copy

    for c in text:
        if c == 0:
            last = 1
            continue
        if to := moves[last].get(c):  # seen before: the state, or a copy of it that ends here
            last = to if length[to] == length[last] + 1 else split(last, c, to)
            continue
        new = len(moves)
        moves.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p:
            to = moves[p][c]
            link[new] = to if length[to] == length[p] + 1 else split(p, c, to)
        last = new
    return moves


def letter_table() -> np.ndarray:
    """For every code point: whether it is a letter or a mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


class Model:
    """``languages`` in order, and ``tables``: plain arrays, so that workers need nothing of this package.

    symbols: a number for each code point (1 a blank, 0 a letter that was not learned); starts: the
    languages' start states; dense: moves by symbols below ``DENSE``, states as rows; keys, targets:
    other moves, by state * ``base`` + symbol.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        symbols = np.where(letter_table(), 0, 1).astype(np.int32)
        counts: Counter[str] = Counter()
        for texts in samples.values():
            for t in texts:
                counts.update(t.lower())
        known = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if not symbols[ord(c)]]
        for i, c in enumerate(known):
            symbols[ord(c)] = i + 2
        base = len(known) + 2
        rows, starts, keys, targets = [np.zeros((1, DENSE), np.int32)], [], [], []
        at = 1
        for lang in self.languages:
            moves = suffix_automaton([x for t in samples[lang] for x in (*encode(t, symbols).tolist(), 0)])
            starts.append(at + 1)
            table = np.zeros((len(moves), DENSE), np.int32)
            for state, own in enumerate(moves):
                for c, to in own.items():
                    if c < DENSE:
                        table[state, c] = at + to
                    else:
                        keys.append((at + state) * base + c)
                        targets.append(at + to)
            rows.append(table)
            at += len(moves)
        order = np.argsort(np.asarray(keys, np.int64), kind="stable")
        self.tables = {
            "languages": self.languages, "symbols": symbols, "starts": np.asarray(starts, np.int64), "dense": np.concatenate(rows), "base": base,
            "keys": np.append(np.asarray(keys, np.int64)[order], np.iinfo(np.int64).max), "targets": np.append(np.asarray(targets, np.int32)[order], 0),
        }


def encode(text: str, symbols: np.ndarray) -> np.ndarray:
    """Symbols of a text in lower case: letters; 1 for a run of anything else."""
    found = symbols[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = found == 1
    gap[1:] &= gap[:-1].copy()
    gap[:1] = False
    return found[~gap]


def count_phrases(texts: list[np.ndarray], tables: dict) -> np.ndarray:
    """Phrases of each text (symbols) under each language. An unknown character is a phrase of its own.

    Every block of ``BLOCK`` characters is parsed from the start state, for all languages alike.
    """
    k = len(tables["languages"])
    counts = np.zeros((len(texts), k), np.int64)
    owner, pieces = [], []
    for i, t in enumerate(texts):
        for at in range(0, len(t), BLOCK):
            owner.append(i)
            pieces.append(t[at : at + BLOCK])
    order = sorted(range(len(pieces)), key=lambda j: -len(pieces[j]))
    flat, keys, targets, base = tables["dense"].reshape(-1), tables["keys"], tables["targets"], tables["base"]
    start = tables["starts"][:, None]

    def move(state: np.ndarray, symbol: np.ndarray, common: np.ndarray, rare: np.ndarray) -> np.ndarray:
        to = flat[state * DENSE + common].astype(np.int64)
        if len(rare):
            wanted = np.broadcast_to(state, (k, len(symbol)))[:, rare] * base + symbol[rare]
            at = np.searchsorted(keys, wanted)
            to[:, rare] = np.where(keys[at] == wanted, targets[at], 0)
        return to

    lanes = max(1, LANES // max(1, k))
    for lo in range(0, len(order), lanes):
        own = order[lo : lo + lanes]
        lengths = np.asarray([len(pieces[j]) for j in own])
        grid = np.zeros((int(lengths[0]), len(own)), np.int32)
        for col, j in enumerate(own):
            grid[: lengths[col], col] = pieces[j]
        state = np.broadcast_to(start, (k, len(own))).copy()
        found = np.zeros((k, len(own)), np.int64)
        alive = len(own)
        for step in range(int(lengths[0])):
            while lengths[alive - 1] <= step:
                alive -= 1
            symbol = grid[step, :alive].astype(np.int64)
            rare = np.flatnonzero(symbol >= DENSE)
            common = symbol
            if len(rare):
                common = symbol.copy()
                common[rare] = 0
            now = state[:, :alive]
            to = move(now, symbol, common, rare)
            missed = to == 0
            found[:, :alive] += missed | (now == start)  # a phrase begins
            again = move(start, symbol, common, rare)
            again = np.where(again == 0, start, again)
            state[:, :alive] = np.where(missed, again, to)
        np.add.at(counts, np.asarray([owner[j] for j in own]), found.T)
    return counts


def fit(docs: DataFrame, usable: Column | None = None, chars: int = CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from texts with a language. ``usable``: a condition on the columns of ``docs``.

    Documents are drawn by a hash of their id, whole texts as long as they fit into ``chars``
    characters a language. Texts longer than ``chars`` / ``LONGEST`` are drawn only where a language
    has no others, and then give that many characters from their middle. Rows without text, language
    or id are ignored; of rows with one id and language the greatest text counts.
    """
    known = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & docs[id_col].isNotNull())
    if usable is not None:
        known = known.filter(usable)
    longest, need = chars // LONGEST, chars // 100
    long = (F.length(text_col) > longest).alias("long")
    ids = known.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("id"), long)
    # first within buckets, then over them: no language is ranked in one task
    bucketed = ids.withColumn("h", F.xxhash64("id")).withColumn("b", F.pmod("h", F.lit(256)))
    near = bucketed.withColumn("r", F.row_number().over(Window.partitionBy("lang", "b").orderBy("long", "h", "id"))).filter(F.col("r") <= need)
    drawn = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "id"))).filter(F.col("r") <= need).select("lang", "id")
    chosen = F.broadcast(drawn.select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).distinct())  # at most `need` ids per language
    text = F.when(F.length(text_col) <= longest, F.col(text_col)).otherwise(F.substring(text_col, (F.length(text_col) / 2).cast("int") - longest // 2, F.lit(longest)))
    found = known.join(chosen, (F.col(id_col) == F.col("__id")) & (F.col(lang_col) == F.col("__lang"))).select(F.col("__lang").alias("lang"), F.col("__id").alias("id"), long, text.alias("text"))
    rows = found.groupBy("lang", "id").agg(F.max(F.struct(~F.col("long"), "text"))["text"].alias("text"), F.min("long").alias("long"), F.xxhash64("id").alias("h")).collect()  # `need` texts of a bounded length
    samples: dict[str, list[str]] = {}
    size: Counter[str] = Counter()
    for r in sorted(rows, key=lambda r: (r["lang"], r["long"], r["h"], r["id"])):
        own = samples.setdefault(r["lang"], [])
        if (not r["long"] or not own) and size[r["lang"]] + len(r["text"]) <= chars:
            own.append(r["text"])
            size[r["lang"]] += len(r["text"])
    return Model(samples)


def _predict(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        languages = tables["languages"]
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t))] if languages else []
            if rows:
                counts = count_phrases([encode(texts[i], tables["symbols"]) for i in rows], tables).astype(float)
                best = counts.argmin(1)  # ties: the first language in alphabetical order
                least = counts.min(1)
                counts[np.arange(len(rows)), best] = np.inf
                second = counts.min(1)
                sure = np.where(np.isinf(second), 1.0, second / (second + least))
                for i, b, s in zip(rows, best, sure, strict=True):
                    lang[i], score[i] = languages[b], float(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return of


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: the language with the fewest phrases, and how clear that is (0.5 a tie, towards 1 clear).

    ``und`` with score 0 where the text is null or has no letter, and everywhere if nothing was learned. Repeated rows get equal answers; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(slim, _predict(spark.sparkContext.broadcast(model.tables)), "doc_id long, lang_pred string, score double")
