"""Chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens made of whole turns: the system turn
(repeated in every window), a limited stretch of turns that earlier windows already held, and new
turns. A turn's tokens are those of its rendered form, and as no piece of the vocabulary's pattern goes
over the end of a rendered turn, a window has exactly the sum of its turns' tokens. Only assistant texts among the new turns are under the loss mask, so every assistant text is
a target exactly once; repeated ones are masked.

Template: a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts each ``<`` that is
followed by backslashes and a bar gets one more backslash, so no control string can arise there, and
taking one away again gives back the text.

Spans are chosen from prefix sums of turn tokens. Prefix sums come from two levels of windows (inside
runs of turn numbers, then over the runs' totals), and cut a conversation into stretches of
``STRETCH`` budgets, each laid out by itself with the history that its beginning can need. A
conversation that holds a third of all rows is thus spread over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices
from .tokens import RankTokenizer, default_vocabulary

BUDGET = 1024
HISTORY = 256
STRETCH = 16
RUN = 256
START, END = "<|im_start|>", "<|im_end|>"

_RAW = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the template, and where its text begins and ends there."""
    head = f"{START}{escape(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: role, text, begin and end of the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def _counted(vocabulary: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = RankTokenizer.shared(vocabulary)
        for batch in slices(batches):
            sizes = [len(tokenizer.encode(render(r.as_py(), t.as_py())[0])) // 4 for r, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, "tokens"])

    return of


_WINDOW = "conv_id long, stretch long, window int, n_repeated int, n_system int, first_position long, n_new int, n_tokens long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _layout(budget: int, history: int):
    def windows(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        """rows: (position, role, text, tokens, kind) in order; kind: 0 system, 1 earlier, 2 new."""
        system = [r for r in rows if r[4] == 0]
        past = [r for r in rows if r[4] == 1]
        new = [r for r in rows if r[4] == 2]
        sums = [0]
        for r in past + new:
            sums.append(sums[-1] + r[3])
        turns, at, n = past + new, len(past), 0
        if system and turns[0][0] == system[0][0] + 1 and system[0][3] + turns[0][3] > budget:
            head, _, _ = render(system[0][1], system[0][2])  # the first turn has no room beside the system turn
            yield (key[0], key[1], n, 0, 1, system[0][0], 0, system[0][3], head, [])
            n = 1
        while at < len(turns):
            lead = system if sums[at + 1] - sums[at] + sum(r[3] for r in system) <= budget else []
            fixed = sum(r[3] for r in lead)
            # new turns as far as the budget goes, one at least
            to = at + 1
            while to < len(turns) and sums[to + 1] - sums[at] + fixed <= budget:
                to += 1
            # history: whole turns back from there, within its own limit and what the budget leaves
            room = min(history, budget - fixed - (sums[to] - sums[at]))
            back = at
            while back and sums[at] - sums[back - 1] <= room:
                back -= 1
            parts, spans, length = [], [], 0
            for i, r in enumerate([*lead, *turns[back:to]]):
                text, lo, hi = render(r[1], r[2])
                if r[1] == "assistant" and i >= len(lead) + at - back:
                    spans.append({"start": length + lo, "end": length + hi})
                parts.append(text)
                length += len(text)
            yield (key[0], key[1], n, at - back, len(lead), turns[at][0], to - at, fixed + sums[to] - sums[back], "".join(parts), spans)
            at, n = to, n + 1

    names = ["conv_id", "stretch", "window", "n_repeated", "n_system", "first_position", "n_new", "n_tokens", "formatted", "loss_spans"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by conversation, stretch, position."""
        key, rows, out = None, [], []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for conv, stretch, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, stretch) != key:
                    if rows:
                        out.extend(windows(key, rows))
                    key, rows = (conv, stretch), []
                rows.append(tuple(rest))
            if len(out) > 1000:
                yield flush()
                out.clear()
        if rows:
            out.extend(windows(key, rows))
        if out:
            yield flush()

    return of


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text: one row per turn) to formatted windows.

    Per window: conv_id; (stretch, window): its place; n_system and n_repeated: how many turns at its
    beginning repeat the system turn and history; first_position and n_new: the new turns; n_tokens;
    formatted text; loss_spans (code points in the formatted text).

    ``n_tokens`` is the number of ids of the formatted text, at most ``budget`` unless a single turn is
    longer: that one has a window to itself, without system turn or history; so has one that fits only
    without the system turn. A system turn counts as such at the beginning of a conversation only, and
    if it takes at most half of the budget; elsewhere, or if longer, it is a turn like others. Null texts and roles count as empty. Turns with equal numbers are ordered by role and
    text, null numbers come first; repeated rows are turns of their own. Rows with a null conv_id form
    one conversation. An empty table gives an empty result. Other columns are ignored.
    """
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    sized = arrow_map(slim, _counted(vocabulary or default_vocabulary()), "conv_id long, turn long, role string, text string, tokens long")
    # prefix sums: inside runs of turn numbers, then over the runs of a conversation
    sized = materialize(sized.withColumn("run", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / RUN)))
    totals = sized.groupBy("conv_id", "run").agg(F.sum("tokens").alias("run_tokens"), F.count("*").alias("run_rows"))
    ahead = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("conv_id").alias("c"), F.col("run").alias("r"),
        F.coalesce(F.sum("run_tokens").over(ahead), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("run_rows").over(ahead), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumns({"n": F.row_number().over(inside), "s": F.coalesce(F.sum("tokens").over(upto), F.lit(0))})
        .join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
        .select("conv_id", "role", "text", "tokens", (F.col("rows_before") + F.col("n") - 1).alias("position"), (F.col("tokens_before") + F.col("s")).alias("start"))
    )
    leading = (F.col("position") == 0) & (F.col("role") == "system") & (F.col("tokens") <= budget // 2)
    width = budget * STRETCH
    stretch = F.floor(F.col("start") / width)
    # a turn goes to its stretch, and as history to the next where it begins within `history` of that one's start
    later = F.when((stretch + 1) * width - F.col("start") <= history, F.array(F.struct((stretch + 1).alias("stretch"), F.lit(1).alias("kind")))).otherwise(F.array().cast("array<struct<stretch:bigint,kind:int>>"))
    own = F.array(F.struct(stretch.alias("stretch"), F.lit(2).alias("kind")))
    turns = placed.filter(~leading).select("conv_id", "position", "role", "text", "tokens", F.explode(F.concat(own, later)).alias("at"))
    turns = materialize(turns.select("conv_id", F.col("at.stretch").alias("stretch"), "position", "role", "text", "tokens", F.col("at.kind").alias("kind")))
    # the system turn goes to every stretch of its conversation; one that is alone gets a stretch
    system = placed.filter(leading).select(F.col("conv_id").alias("c"), "position", "role", "text", "tokens")
    stretches = turns.filter("kind = 2").select("conv_id", "stretch").distinct()
    heads = system.join(stretches, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), F.coalesce("stretch", F.lit(0)).alias("stretch"), "position", "role", "text", "tokens",
        F.when(F.col("stretch").isNull(), 2).otherwise(0).alias("kind"),
    )
    # history only where something new follows
    wanted = turns.filter("kind = 2").unionByName(turns.filter("kind = 1").alias("t").join(stretches.alias("s"), F.expr("t.conv_id <=> s.conv_id and t.stretch = s.stretch"), "left_semi"))
    rows = wanted.unionByName(heads).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "position")
    return arrow_map(rows.select("conv_id", "stretch", "position", "role", "text", "tokens", "kind"), _layout(budget, history), _WINDOW)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by conversation and place, back to what they say; texts are hashed as they come and not held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    key, state, out = None, None, []

    def done():
        out.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    for batch in batches:
        for conv, n_system, n_repeated, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (conv,):
                if key:
                    done()
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            turns = parse(formatted)
            fresh = turns[n_system + n_repeated :] if state[5] else turns[:n_system] + turns[n_system + n_repeated :]
            for role, text, _, _ in fresh:
                state[1].update(f"{role}\n{text}\n".encode())
            state[0] += len(fresh)
            for span in spans:
                text = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += 1
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
    if key:
        done()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def read_back(windows: DataFrame) -> DataFrame:
    """What formatted windows say, per conversation: turns and their digest, loss text and its digest, sizes.

    A digest of a whole conversation is sequential by nature: one task streams each conversation's
    windows in order, holding one batch of them at a time.
    """
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window").select("conv_id", "n_system", "n_repeated", "formatted", "loss_spans")
    return arrow_map(rows, _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
