"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: bit b is set when more than half of a text's shingle hashes (XXH64) have it set.

Candidates: cut the 64 bits into m = 4 segments on a ring. If two fingerprints differ in at most
d = 3 bits, then some segment starts a chain whose first l segments differ in at most l * d / m
bits, for every l (the pigeonring principle): none in the first, one in the first two, two in the
first three. Each such chain is turned into exact-match buckets of 32 to 37 bits: the first segment
as it is; then either the second as it is and one third of the third segment, or one half of the
second and one half of the third. Only rows that meet in a bucket reach the full Hamming check.

Buckets hold distinct fingerprints. One with more than ``BLOCK`` of them is split again: of the bits
it does not fix, cut in four, one part must be equal; so it becomes four kinds of narrower buckets,
until no bucket is large. A bucket that leaves r bits free holds at most 2**r fingerprints, which
ends the splitting, and no pair is lost. A small bucket is compared in one block of memory and
returns a star forest of its links, not its pairs.

Near copies by a similarity of word shingles (:func:`near_copies`). Two texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 differ in 15 % of a SimHash's bits, so an exact key of 32
bits out of it would have to be tried some 440 times to find 90 % of them, and more often the larger
the table. The same ring of segments is therefore filled from samples: segment i holds 32 bits of the
one shingle that comes first in the i-th order, and two segments are equal with a chance that is the
similarity, however wide they are. On this ring of 12 the pigeonring principle works as above: with at
most five differing segments some segment starts a chain that has none differing among its first two
and at most one among its first four. Each chain becomes two exact keys of three segments (96 bits),
so strangers never meet by chance, whatever the size of the table. Rows that meet take the full
Hamming check on a 256-bit SimHash, with a margin, and inside the groups of candidates that this
connects the shingles themselves decide.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices
from .components import connected_components

MAX_BITS = 3
BLOCK = 4096
RING, CHAIN = 12, 4  # segments, and how many of them a chain looks at
MISSED = 0.02  # share of pairs at the very threshold that may differ in more segments than the chains allow
MARGIN = 3  # standard deviations that the full Hamming check allows
SIGNATURES = 16_384  # rows compared in one block of memory
BLOCK_SHINGLES = 1 << 20
SIGNATURE = 4  # 64-bit words of the fingerprint of the full Hamming check
_CHUNK = 8192
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words than a shingle has make one shingle."""
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    k = min(words, len(tokens))
    stops = ends[k - 1 :].tolist()
    starts = (ends - lengths + 1)[: len(stops)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of n hashes, w wide, to w signed 64-bit words: the bits set in over half the rows."""
    count, wide = hashes.shape
    ones = np.zeros(wide * 64, np.int64)
    for at in range(0, count, _CHUNK):
        octets = hashes[at : at + _CHUNK].astype("<u8", copy=False).view(np.uint8)
        if len(octets) < 64:
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            places = octets + np.arange(0, wide * 8 * 256, 256, dtype=np.int32)
            ones += (np.bincount(places.ravel(), minlength=wide * 8 * 256).reshape(-1, 256) @ _BYTE_BITS).ravel().astype(np.int64)
    return np.packbits(ones * 2 > count, bitorder="little").view("<i8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text as a signed 64-bit number: A-Z lower-cased, ASCII white space splits words.

    Fewer words than a shingle has: the whole sequence is one shingle. No word at all (null, empty): 0.
    """
    tokens = (text or "").encode().lower().split()
    return int(_majority(_shingles(tokens, words)[:, None])[0]) if tokens else 0


def _spread(hashes: np.ndarray, wide: int) -> np.ndarray:
    """Each hash to ``wide`` independent ones: itself, then mixed with odd multiples of the golden ratio."""
    out = [hashes]
    for i in range(1, wide):
        x = hashes + np.uint64(i * 2 * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ x >> np.uint64(31))
    return np.stack(out, axis=1)


_XOR = np.array([(i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for i in range(RING)], np.uint64)[:, None]
_ODD = np.array([(i * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB | 1) & (1 << 64) - 1 for i in range(RING)], np.uint64)[:, None]


def ring_segments(hashes: np.ndarray) -> np.ndarray:
    """For each of ``RING`` orders of the hashes, 32 bits of the first one (signed)."""
    first = np.full(RING, np.iinfo(np.uint64).max)
    value = np.zeros(RING, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        order = (part ^ _XOR) * _ODD
        best = order.argmin(axis=1)
        least = order[np.arange(RING), best]
        value = np.where(least <= first, part[best], value)
        first = np.minimum(least, first)
    return (value >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Distinct shingle hashes; 0 alone without a word, so that texts without words are alike."""
    tokens = (text or "").encode().lower().split()
    return np.unique(_shingles(tokens, words)) if tokens else np.zeros(1, np.uint64)


def signature(text: str | None, words: int = 5) -> tuple[list[int], list[int]]:
    """The segments of the ring, and the words of the fingerprint of the full Hamming check."""
    found = shingle_set(text, words)
    return ring_segments(found).tolist(), _majority(_spread(found, SIGNATURE)).tolist()


def _fingerprints(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[str | None, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                if (fp := known.get(text)) is None:
                    fp = known[text] = fingerprint(text, words)
                out.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    return of


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; see :func:`fingerprint`."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(slim, _fingerprints(words), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of n nearly equal parts of some bit positions."""
    cut = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cut, cut[1:], strict=False)]


def chain_masks(bits: int = MAX_BITS) -> list[int]:
    """Masks of which two fingerprints that differ in at most ``bits`` bits (two or more) agree on one.

    The ring has bits + 1 segments, so a chain's first three may differ in 0, 1 and 2 bits: seven masks for each start.
    """
    masks = []
    m = bits + 1
    segments = [list(range(64 * i // m, 64 * (i + 1) // m)) for i in range(m)]
    for i in range(m):
        first, second, third = (segments[(i + j) % m] for j in range(3))
        whole = sum(1 << b for b in first)
        masks += [whole | sum(1 << b for b in second) | part for part in _parts(third, 3)]
        masks += [whole | a | b for a in _parts(second, 2) for b in _parts(third, 2)]
    return masks


def finer_masks(mask: int, bits: int = MAX_BITS) -> list[int]:
    """Narrower masks: of the free bits' bits + 1 parts, at least one is equal where at most ``bits`` differ."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | part for part in _parts(free, bits + 1)]


def _stars(words: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(member, root) by row numbers: the components of rows of 64-bit words within ``limit`` differing bits.

    A search from each first row not yet reached; every row is compared only with those still unreached.
    """
    rest = np.arange(len(words))
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count(words[rest] ^ words[todo.pop()]).sum(axis=1, dtype=np.int64) <= limit
            if near.any():
                hits = rest[near].tolist()
                rest = rest[~near]
                todo += hits
                yield from ((x, root) for x in hits)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star forest of the links inside each bucket."""
    for batch in batches:
        us, vs = [], []
        for bucket in batch.column(0):
            fps = np.unique(np.asarray(bucket.values, dtype=np.int64))
            for member, root in _stars(fps.view(np.uint64)[:, None], MAX_BITS):
                us.append(int(fps[member]))
                vs.append(int(fps[root]))
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def near_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect exactly what links of at most three bits connect."""
    masks = chain_masks()
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).select("fp", "mask", F.expr("fp & mask").alias("val"))
    links = None
    while True:
        # buckets with partners, few among all; sizes come from a partial aggregation
        sizes = rows.groupBy("mask", "val").agg(F.count("*").alias("n")).filter("n > 1")
        # Spark takes exploded rows for as few as there were before, and would broadcast them
        shared = materialize(rows.hint("merge").join(sizes, ["mask", "val"]))
        buckets = shared.filter(F.col("n") <= block).groupBy("mask", "val").agg(F.collect_list("fp").alias("fps"))
        small = arrow_map(buckets.select("fps"), _compare, "u long, v long")
        links = small if links is None else links.unionByName(small)
        large = shared.filter(F.col("n") > block)
        if large.isEmpty():
            return links
        hot = {r["mask"] for r in large.select("mask").distinct().collect()}  # some of the masks, however many rows
        finer = {m: finer_masks(m) for m in masks if _signed(m) in hot}
        masks = [x for own in finer.values() for x in own]
        table = F.create_map(*[x for m, own in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in own]))])
        rows = large.select("fp", F.explode(table[F.col("mask")]).alias("mask")).select("fp", "mask", F.expr("fp & mask").alias("val"))


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest id reachable over links of at most 3 bits).

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows share a
    component. Null ids count only where a component has no other (component_id is null then).
    An empty table gives an empty result; other columns are not read.
    """
    own = materialize(fingerprints(docs, words, id_col, text_col))
    least = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(least.select("fp"), block))
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = materialize(linked)
    classes = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(classes, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def candidate_limit(similarity: float) -> int:
    """Differing bits that texts of this similarity exceed by chance only beyond ``MARGIN`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * SIGNATURE * p + MARGIN * math.sqrt(64 * SIGNATURE * p * (1 - p)))


def spare_segments(similarity: float, segments: int = RING) -> int:
    """How many segments may differ: pairs of exactly this similarity exceed it in a share of ``MISSED`` at most."""
    below = 0.0
    for d in range(segments):
        below += math.comb(segments, d) * (1 - similarity) ** d * similarity ** (segments - d)
        if below >= 1 - MISSED:
            return d
    return segments - 1


def ring_chains(spare: int, segments: int = RING, length: int = CHAIN) -> list[tuple[int, ...]]:
    """Sets of segments of which two rings that differ in at most ``spare`` segments agree on one.

    A chain's first l segments may differ in at most l * spare / segments of them, for every l up to
    ``length``; a set is what is left of a chain when as many differ as may.
    """
    budget = [at * spare // segments for at in range(1, length + 1)]
    fits = [x for x in itertools.combinations(range(length), budget[-1]) if all(sum(y <= at for y in x) <= budget[at] for at in range(length))]
    return [tuple((start + at) % segments for at in range(length) if at not in x) for start in range(segments) for x in fits]


def _signatures(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [signature(t.as_py(), words) for t in batch.column(1)]
            bits = np.array([f for _, f in found], np.int64).reshape(-1, SIGNATURE)
            rings = pa.array([r for r, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rings, *(pa.array(bits[:, i]) for i in range(SIGNATURE))], names=["doc_id", "ring", *_BITS])

    return of


_BITS = [f"f{i}" for i in range(SIGNATURE)]


def _compare_signatures(limit: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for bucket in batch.column(0):
                fields = bucket.values.flatten()
                nodes, at = np.unique(fields[0].to_numpy(), return_index=True)
                words = np.stack([f.to_numpy()[at] for f in fields[1:]], axis=1).view(np.uint64)
                for member, root in _stars(words, limit):
                    us.append(int(nodes[member]))
                    vs.append(int(nodes[root]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return of


def _shingle_sets(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            digests = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
            arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["grp", "node", "digest", "shingles"])

    return of


def _alike(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """(member, root) by row numbers: the components of sets, one after another in ``flat``, of at least this Jaccard similarity.

    The search of :func:`_stars`: every set is compared only with those still unreached.
    """
    flat = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    marked = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    live = rest = np.arange(len(sizes))
    held, begins = flat, ends - sizes
    open_ = np.ones(len(sizes), bool)
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        open_[root] = False
        todo = [root]
        while todo and len(rest):
            if 2 * len(rest) < len(live):  # reached sets are left out of further sums
                live = rest
                held = np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in live])
                begins = np.cumsum(sizes[live]) - sizes[live]
            own = todo.pop()
            mine = flat[ends[own] - sizes[own] : ends[own]]
            marked[mine] = True
            both = np.add.reduceat(marked[held], begins, dtype=np.int64)
            marked[mine] = False
            near = (both / (sizes[live] + sizes[own] - both) >= similarity) & open_[live]
            if near.any():
                hits = live[near].tolist()
                open_[hits] = False
                rest = rest[open_[rest]]
                todo += hits
                yield from ((x, root) for x in hits)


def _compare_sets(similarity: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for bucket in batch.column(0):
                nodes, sets = bucket.values.flatten()
                nodes = nodes.to_numpy()
                for member, root in _alike(sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64), similarity):
                    if nodes[member] != nodes[root]:
                        us.append(int(nodes[member]))
                        vs.append(int(nodes[root]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return of


def _block_links(members: DataFrame, size: Column, block: int, compare) -> DataFrame:
    """Members (grp, node, ...) to edges (u, v) that connect exactly what the pairs of a group that ``compare`` links connect.

    A group whose sizes add up to no more than ``block`` is compared at once. A larger one is first
    dealt twice into random parts, each row going to one part of either dealing; as any two parts of
    different dealings share rows, a group of near copies hangs together by that. What it leaves in
    pieces is then compared in full: the rows outside the largest piece with all rows, by pairs of
    parts. So a group of n near copies costs 2n rows, and no pair is left out.
    """
    rest = [c for c in members.columns if c != "grp"]
    totals = members.groupBy("grp").agg(F.count("*").alias("n"), F.sum(size).alias("total")).filter("n > 1")
    sized = materialize(members.join(totals, "grp").withColumn("parts", F.ceil(2 * F.col("total") / block).cast("int")).drop("n"))

    def compared(rows: DataFrame, *keys: str) -> DataFrame:
        buckets = rows.groupBy("grp", *keys).agg(F.collect_list(F.struct(*rest)).alias("rows"))
        return arrow_map(buckets.select("rows"), compare, "u long, v long")

    links = compared(sized.filter(F.col("total") <= block))
    large = sized.filter(F.col("total") > block)
    if large.isEmpty():
        return links
    dealings = F.array(*[F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")) + F.col("parts") * seed for seed in (0, 1)])
    links = materialize(links.unionByName(compared(large.withColumn("part", F.explode(dealings)), "part")))
    roots = connected_components(links)
    pieces = large.join(roots.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").withColumn("piece", F.coalesce("root", "node")).drop("k", "root", "total", "parts")
    by_piece = pieces.groupBy("grp", "piece").agg(F.count("*").alias("c"), F.sum(size).alias("s"))
    main = by_piece.groupBy("grp").agg(F.max(F.struct("c", "piece"))["piece"].alias("main"), F.max(F.struct("c", "piece", "s"))["s"].alias("main_size"), F.sum("s").alias("all_size"), F.count("*").alias("n")).filter("n > 1")
    split = pieces.join(main, "grp")
    few = F.ceil(2 * (F.col("all_size") - F.col("main_size")) / block).cast("int")  # parts of the rows outside the largest piece
    many = F.ceil(2 * F.col("main_size") / block).cast("int")
    outside = F.col("piece") != F.col("main")
    hashed = F.xxhash64("node", F.lit(2))
    own = F.when(outside, F.pmod(hashed, few)).otherwise(few + F.pmod(hashed, many)).cast("int")
    others = F.sequence(F.lit(0), F.when(outside, few + many).otherwise(few) - 1)
    dealt = split.withColumn("own", own).withColumn("other", F.explode(others))
    pairs = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return links.unionByName(compared(pairs, "low", "high"))


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = SIGNATURES, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest id reachable over links; null without an id).

    Two texts link when the Jaccard similarity of their sets of shingles is at least ``similarity``
    (A-Z lower-cased, ASCII white space splits words; a text of fewer words than a shingle has is one
    shingle). That is decided by the shingles for all pairs of a group of candidates: what fingerprints
    within :func:`candidate_limit` connect, among texts that share a key of :func:`ring_chains`. Null
    and empty texts, and others without words, are alike. Rows with a null id belong to no component.
    Repeated rows of one id stand together. An empty table gives an empty result; other columns are
    not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = materialize(arrow_map(slim, _signatures(words), "doc_id long, ring array<int>, " + ", ".join(f"{n} long" for n in _BITS)))
    alike = ["ring", *_BITS]
    classes = materialize(own.groupBy(*alike).agg(F.min("doc_id").alias("node"), F.count("doc_id").alias("n")).filter("node IS NOT NULL"))
    # keys of the chains, 64-bit hashes of their place and segments; only those that two classes share go on
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("ring")[at] for at in chain]) for i, chain in enumerate(ring_chains(spare_segments(similarity)))])
    rows = classes.select("node", F.explode(keys).alias("grp"))
    shared = rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp")
    met = materialize(rows.join(shared, "grp"))
    members = met.join(classes.select("node", *_BITS), "node").select("grp", "node", *_BITS)
    near = connected_components(_block_links(members, F.lit(1), block, _compare_signatures(candidate_limit(similarity)))).select(F.col("node").alias("k"), "root")
    roots = near.unionByName(near.select(F.col("root").alias("k"), "root").distinct())
    grouped = classes.join(roots, classes["node"] == roots["k"], "left").filter("root IS NOT NULL OR n > 1").select(*alike, F.coalesce("root", "node").alias("grp"))
    ids = own.join(grouped, alike).select(F.col("doc_id").alias("node"), "grp").filter("node IS NOT NULL").distinct()
    texts = slim.join(ids, slim["doc_id"] == ids["node"]).select("grp", "node", "text")
    sets = materialize(arrow_map(texts, _shingle_sets(words), "grp long, node long, digest long, shingles array<long>"))
    # equal sets are one member, the others hang on it
    apart = sets.groupBy("grp", "digest").agg(F.min("node").alias("node"), F.first("shingles").alias("shingles"))
    copies = sets.select("grp", "digest", F.col("node").alias("u")).join(apart.select("grp", "digest", F.col("node").alias("v")), ["grp", "digest"]).filter("u <> v").select("u", "v")
    exact = _block_links(apart.select("grp", "node", "shingles"), F.size("shingles") + shingles // block, shingles, _compare_sets(similarity))
    linked = connected_components(exact.unionByName(copies)).select(F.col("node").alias("k"), "root")
    return own.select("doc_id").join(linked, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component of near copies, with all their columns.

    Rows with a null id are kept. Repeated rows of one id stay together. See :func:`near_copies`.
    """
    found = near_copies(docs, similarity, words, id_col, text_col)
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["__id"], "left_anti")
