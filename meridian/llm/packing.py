"""Best-fit packing of documents into token sequences by linear grouping.

Everything that decides the packing is the histogram of piece lengths, at most ``capacity`` numbers
however many documents there are. The driver solves on it:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest;
2. the few rounded sizes give a configuration problem, solved by column generation (a revised
   simplex whose new columns come from a knapsack recursion) and rounded down;
3. each configuration's places go to actual lengths of the group, which leaves true gaps;
4. what is left, and all small lengths, go best-fit, longest first, into the smallest gap that holds them.

All four work on runs of equal sequences, so the plan's size depends on ``capacity`` and the number
of groups, not on the data. Documents get ranks within their length (counts by bucket, then a window
within a bucket, so no length is gathered in one task), and a rank finds its place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices
from .tokens import RankTokenizer, default_vocabulary

CAPACITY = 2048
END_OF_TEXT = 0
GROUPS = 160
BUCKETS = 1024


def _cut(vocabulary: str, capacity: int, keep_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = RankTokenizer.shared(vocabulary)
        end = np.asarray([END_OF_TEXT], "<u4").tobytes()
        for batch in slices(batches):
            row, piece, start, length, crc, blobs = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = tokenizer.encode(text.as_py() or "") + end
                n = len(ids) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    if keep_ids:
                        blobs.append(ids[4 * a : 4 * b])
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return of


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: its ids and an end id, cut into ``capacity`` ids where longer (the first piece may be shorter).

    ``keep_ids`` adds the ids themselves as little-endian unsigned 32-bit numbers. Null texts count as empty: the end id alone.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return arrow_map(slim, _cut(vocabulary or default_vocabulary(), capacity, keep_ids), schema)


# --- the plan, on the driver, from the histogram of lengths ---


def knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes that fits."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (s, v) in enumerate(zip(sizes, values, strict=True)):
        if v <= 1e-12:
            continue
        before = best.copy()
        for k in range(1, capacity // s + 1):
            gain = before[: capacity + 1 - k * s] + k * v
            better = gain > best[k * s :] + 1e-12
            best[k * s :][better] = gain[better]
            taken[i, k * s :][better] = k
    counts, left = [0] * len(sizes), capacity
    for i in range(len(sizes) - 1, -1, -1):
        counts[i] = int(taken[i, left])
        left -= counts[i] * sizes[i]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], int]]:
    """Configurations and how often each is used, for few sizes: the linear relaxation, rounded down."""
    n = len(sizes)
    if not n:
        return []
    need = np.asarray(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    use = np.linalg.solve(basis, need)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        worth, column = knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, np.asarray(column, float))
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        use = np.maximum(np.linalg.solve(basis, need), 0)
    return [([int(round(x)) for x in basis[:, j]], int(use[j] + 1e-6)) for j in range(n) if use[j] + 1e-6 >= 1]


class Plan:
    """Runs of equal sequences: places say which ranks of a length go where, gaps what room is left."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rank: dict[int, int] = {}
        self.places: list[tuple[int, int, int, int, int]] = []  # length, first rank, past the last, first sequence, offset
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: first sequence, how many

    def put(self, length: int, first: int, n: int, offset: int) -> None:
        lo = self.rank.get(length, 0)
        self.rank[length] = lo + n
        self.places.append((length, lo, lo + n, first, offset))

    def open(self, lengths: list[int], n: int) -> None:
        """n new sequences that start with these lengths."""
        at = 0
        for x in lengths:
            self.put(x, self.sequences, n, at)
            at += x
        self.gaps[self.capacity - at].append((self.sequences, n))
        self.sequences += n

    def best_fit(self, length: int, count: int) -> None:
        """Places ``count`` pieces of one length, each into the smallest gap that holds it."""
        room = length
        while count:
            while room <= self.capacity and not self.gaps[room]:
                room += 1
            if room > self.capacity:
                fit = self.capacity // length
                full, rest = divmod(count, fit)
                if full:
                    self.open([length] * fit, full)
                if rest:
                    self.open([length] * rest, 1)
                return
            first, n = self.gaps[room].pop()
            each = min(room // length, count)
            use = min(n, count // each)
            if use < n:
                self.gaps[room].append((first + use, n - use))
            for k in range(each):
                self.put(length, first, use, self.capacity - room + k * length)
            self.gaps[room - each * length].append((first, use))
            count -= each * use


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int | None = None) -> Plan:
    """Packs ``histogram`` (length to count) into as few sequences as linear grouping and best-fit find."""
    small = capacity // 3 if small is None else small
    made = Plan(capacity)
    if full := histogram.get(capacity, 0):
        made.open([capacity], full)
    large = [[x, histogram[x]] for x in sorted(histogram, reverse=True) if small < x < capacity and histogram[x]]
    total = sum(n for _, n in large)
    each = -(-total // groups) if total else 1
    grouped: list[list[list[int]]] = []  # per group: runs of (length, count), longest first
    for x, n in large:
        while n:
            if not grouped or sum(c for _, c in grouped[-1]) >= each:
                grouped.append([])
            now = min(n, each - sum(c for _, c in grouped[-1]))
            grouped[-1].append([x, now])
            n -= now
    sizes = [g[0][0] for g in grouped]
    by_size: dict[int, list[list[int]]] = {}
    for s, g in zip(sizes, grouped, strict=True):
        by_size.setdefault(s, []).extend(g)  # neighbouring groups may round up to the same size
    sizes = list(by_size)
    for counts, times in configurations(sizes, [sum(c for _, c in by_size[s]) for s in sizes], capacity):
        while times:
            runs = [(by_size[s], k) for s, k in zip(sizes, counts, strict=True) if k]
            step = min([times, *(own[0][1] // k for own, k in runs)])
            lengths = []
            for own, k in runs:
                if step:
                    lengths += [own[0][0]] * k
                    own[0][1] -= step * k
                    if not own[0][1]:
                        own.pop(0)
                else:  # a run ends inside this sequence
                    for _ in range(k):
                        lengths.append(own[0][0])
                        own[0][1] -= 1
                        if not own[0][1]:
                            own.pop(0)
            made.open(lengths, step or 1)
            times -= step or 1
    left: dict[int, int] = {}
    for own in by_size.values():
        for x, n in own:
            left[x] = left.get(x, 0) + n
    left |= {x: n for x, n in histogram.items() if x <= small and n}
    for x in sorted(left, reverse=True):
        made.best_fit(x, left[x])
    return made


def _place(table: np.ndarray):
    """table: columns length, first rank, past the last, first sequence, offset; sorted by length and rank."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table[:, 2].max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            rows = table[at]
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows[:, 3] + rank - rows[:, 1]), pa.array(rows[:, 4])], names=[*names, "sequence_id", "offset"])

    return of


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, optional ids).

    Offsets are gapless from 0 within a sequence. Equal pieces (repeated rows) get places of their own.
    An empty table gives an empty result.
    """
    cut = materialize(cut)
    slim = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    counts = slim.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = np.asarray(sorted(plan(histogram, capacity, groups).places), np.int64).reshape(-1, 5)
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = slim.withColumn("within", within).join(before, ["length", "bucket"])
    columns = [*cut.columns, (F.col("before") + F.col("within") - 1).alias("rank")]
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return arrow_map(ranked.select(*columns), _place(table), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, capacity, vocabulary, keep_ids), capacity, groups)
