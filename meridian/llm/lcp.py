"""Document fingerprints by locally consistent parsing.

Level by level a text's symbols are grouped into phrases whose borders depend only on a few
neighbouring symbols, so equal substrings are cut alike away from their ends, whatever their offset:

* a run of one symbol becomes one symbol (named by symbol and length);
* deterministic coin tossing gives each symbol a label from the lowest bit in which it differs from
  its left neighbour; two rounds bring 64-bit names down to labels below 14, neighbours differing;
* a phrase starts at each local maximum of the labels;
* a phrase's name is a hash of its symbols in order, and the names are the next level's symbols.

A phrase grows about threefold per level. A document's signatures are the names at level ``LEVEL``
and above (its top level where it has fewer); the fingerprint is the ``KEPT`` smallest of them
(a bottom-k sketch, exact for small sets), and likeness is the Jaccard estimate of two sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

LEVEL = 2
TOP = 24
KEPT = 64
CHUNK = 1_000_000  # characters parsed together

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit permutation."""
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing. ``first``: positions without a left neighbour."""
    one = x.dtype.type(1)
    differ = np.empty_like(x)
    differ[1:] = x[1:] ^ x[:-1]
    differ[first] = ~x[first] & x[first] + one | x.dtype.type(1) << x.dtype.type(4)
    low = np.bitwise_count((differ & -differ) - one)
    bit = (x >> low.astype(x.dtype)) & one
    return low * np.uint8(2) + bit.astype(np.uint8)


def _runs(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every run of a symbol as one symbol."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[1:] |= owner[1:] != owner[:-1]
    if new.all():
        return x, owner
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(x))).astype(np.uint64)
    out = x[at]
    long = length > 1
    out[long] = _mix(out[long] * _A + length[long])
    return out, owner[at]


def _level(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and their documents."""
    x, owner = _runs(x, owner)
    head = np.empty(len(x), bool)
    head[0] = True
    np.not_equal(owner[1:], owner[:-1], out=head[1:])
    first = np.flatnonzero(head)
    label = _toss(_toss(x, first), first)
    top = head.copy()
    # a local maximum starts a phrase; not right behind a document's head, and not at its last symbol
    up = label[1:-1] > label[:-2]
    up &= label[1:-1] >= label[2:]
    up &= ~(head[1:-1] | head[2:] | head[:-2])
    top[1:-1] |= up
    at = np.flatnonzero(top)
    place = np.arange(len(x), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(x)))).astype(np.uint64)
    return _mix(np.add.reduceat(_mix((x + place * _C) * _A + place), at)), owner[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Sorted signatures (uint32, at most ``KEPT``) of each text; none for an empty one."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.asarray([len(p) for p in points])
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    if not lengths.sum():
        return out
    x = _mix(np.concatenate(points).astype(np.uint64) * _A)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    found = []
    for level in range(1, TOP + 1):
        x, owner = _level(x, owner)
        size = np.bincount(owner, minlength=len(texts))
        if level >= LEVEL:
            found.append((owner, x))
        else:  # texts that end here keep their last phrase
            done = size[owner] == 1
            found.append((owner[done], x[done]))
        more = size[owner] > 1
        if not more.any():
            break
        x, owner = x[more], owner[more]
    key = np.unique(np.concatenate([o.astype(np.uint64) << np.uint64(32) | n >> np.uint64(32) for o, n in found]))
    own = (key >> np.uint64(32)).astype(np.int64)
    starts = np.searchsorted(own, np.arange(len(texts) + 1))
    names = key.astype(np.uint32)
    for i in range(len(texts)):
        out[i] = names[starts[i] : min(starts[i] + KEPT, starts[i + 1])]
    return out


def in_chunks(texts: list[str]) -> Iterator[np.ndarray]:
    """:func:`sketches` with bounded working memory (one very long text is a chunk of its own)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield from sketches(texts[lo:i])
            lo, size = i, 0
        size += len(t)
    yield from sketches(texts[lo:])


def text_of(sketch: np.ndarray) -> str:
    """A sketch as hexadecimal digits, eight per signature."""
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two sketches: 1 for two empty ones, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row. Null texts count as empty: an empty fingerprint. Equal texts have equal ones."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [text_of(s) for s in in_chunks([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(of, "doc_id long, fingerprint string")


# --- each document beside the next one ---

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(col: Column, cuts: list[int], lo: int, hi: int) -> Column:
    """How many of the ascending cuts[lo:hi] are above the value, plus what is above hi, by binary search."""
    if lo == hi:
        return F.lit(len(cuts) - lo)
    mid = (lo + hi) // 2
    return F.when(col >= cuts[mid], _bucket(col, cuts, mid + 1, hi)).otherwise(_bucket(col, cuts, lo, mid))


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets in order (bucket, guest, id descending, text): each row meets the one that follows it."""
    held: tuple | None = None
    rows: list[tuple[int | None, str, str]] = []
    size = 0
    for batch in batches:
        buckets, guests, ids, texts = (batch.column(i).to_pylist() for i in range(4))
        for bucket, guest, doc_id, text in zip(buckets, guests, ids, texts, strict=True):
            text = text or ""
            if held and held[0] == bucket and not held[1]:
                rows.append((held[2], held[3], text))
                size += len(held[3]) + len(text)
                if size > CHUNK:
                    yield _compared(rows)
                    rows, size = [], 0
            held = (bucket, guest, doc_id, text)
    if rows:
        yield _compared(rows)


def _compared(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in rows]
    # a row's text is mostly the one that came after the row before it: parsed once
    texts: dict[str, int] = {}
    for _, t, after in rows:
        texts.setdefault(t, len(texts))
        texts.setdefault(after, len(texts))
    for t in edited:
        texts.setdefault(t, len(texts))
    found = list(in_chunks(list(texts)))
    own = [found[texts[t]] for _, t, _ in rows]
    changed = [found[texts[t]] for t in edited]
    after = [found[texts[a]] for _, _, a in rows]
    arrays = [
        pa.array([i for i, _, _ in rows], pa.int64()),
        pa.array([len(t) for _, t, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(map(text_of, own), pa.string()),
        pa.array(map(text_of, changed), pa.string()),
        pa.array(map(likeness, own, changed), pa.float64()),
        pa.array(map(likeness, own, after), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _OUT.split(", ")])


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's fingerprint beside those of an edited text and of the next row.

    The edited text has its last third (code points, rounded down) replaced by as many first ones of
    the next row's text. Next: in descending order of id, ties by text, null ids last; the first
    follows the last (a single row follows itself). An empty table gives an empty result.

    Rows are dealt into ranges of ids in one shuffle; the first row of a range also goes to the range
    before it. The driver learns one id per range.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in slim.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    dealt = slim.withColumn("bucket", _bucket(F.col("key"), cuts, 0, len(cuts)))
    tops = dict(sorted(map(tuple, dealt.groupBy("bucket").agg(F.max("key")).collect())))  # one id per range
    if not tops:
        return spark.createDataFrame([], _OUT)
    buckets = list(tops)
    before = {buckets[i]: buckets[i - 1] for i in range(len(buckets))}  # wraps: the first follows the last
    table = F.create_map(*[x for b in buckets for x in (F.lit(b), F.struct(F.lit(tops[b]).alias("top"), F.lit(before[b]).alias("to")))])
    at = table[F.col("bucket")]
    places = F.when(F.col("key") == at["top"], F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(at["to"].alias("b"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))
    )
    rows = dealt.withColumn("place", F.explode(places)).select(F.col("place.b").alias("bucket"), F.col("place.guest").alias("guest"), "doc_id", "text", "key")
    together = rows.repartitionById(max(buckets) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.desc("key"), "text")
    return together.select("bucket", "guest", "doc_id", "text").mapInArrow(_beside, _OUT)
