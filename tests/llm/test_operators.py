"""Each operator on small hard tables (nulls, empty and long texts, ties, repeated rows, foreign columns), against plain versions of it."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridian.llm import chat, language_id, lcp, licenses, mixing, packing, simhash, tokens, toxicity, url_filter
from meridian.llm.common import LOWER, UPPER
from meridian.llm.components import connected_components
from meridian.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, radix_groups
from meridian.llm.tokens import RankTokenizer, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, grp string, fp string, kept string"
WORDS = "alpha beta gamma delta omega the of and idiot scum zeta eta theta iota kappa".split()


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 5, "x", "y", "z") for i, t, lang, src in rows], SCHEMA)


def hard_rows():
    rng = random.Random(3)
    base = " ".join(rng.choice(WORDS) for _ in range(300))
    rows = [(1, None, "en", "src1"), (2, "", "en", "src1"), (3, "Same Text", "en", None), (4, "same text", None, "src2"), (5, "SAME TEXT", "de", "src2"), (6, "É same", "fr", "src3"), (7, "é same", "fr", "src3")]
    rows += [(8, base, "en", "src0"), (9, base + " tail", "en", "src0"), (10, base.upper(), "en", "src0"), (11, base * 40, "en", "src0"), (12, base * 40 + "!", "en", "src9"), (13, "!!! ???", "en", "src12")]
    rows += [(14, "Same text", "en", "src1"), (14, "Same text", "en", "src1"), (None, "lonely", "en", "src1"), (None, None, None, None)]
    return rows + [(20 + i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))), "en", f"src{i % 5}") for i in range(60)]


def low(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def test_radix_groups_against_a_dictionary():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 90))) for _ in range(400)] + [b"a" * 1000, b"a" * 1000, b"a" * 1001, b"", b""]
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert sorted(map(sorted, radix_groups(texts, 4))) == sorted(want.values())


def test_exact_duplicates(spark):
    rows = hard_rows()
    got = exact_duplicates(table(spark, rows)).collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    assert len(got) == len(rows)
    for r in got:
        (text,) = [t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = [i for i in groups[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[text])) and r.doc_id in groups[text]
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_exact_duplicates(table(spark, rows))
    assert kept.count() == len(groups) and kept.columns == table(spark, rows).columns
    assert {low(r.text) for r in kept.collect()} == set(groups)
    unique = [r for r in rows if r[0] not in (14, None)]  # ids of one row each: the anti join alone
    best = {}
    for i, t, *_ in unique:
        best[low(t)] = max(best.get(low(t), -1), i)
    assert sorted(r.doc_id for r in drop_exact_duplicates(table(spark, unique)).collect()) == sorted(best.values())
    assert drop_exact_duplicates(table(spark, [])).count() == 0
    assert exact_duplicates(table(spark, [])).count() == 0


def plain_simhash(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", low(text).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprint():
    for _, t, *_ in hard_rows():
        assert simhash.fingerprint(t) % (1 << 64) == plain_simhash(t)


def test_chains_cover_every_pair_within_three_bits():
    rng = random.Random(2)
    masks = simhash.chain_masks()
    for _ in range(20_000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x |= 1 << b
        assert any(not x & m for m in masks)
        hit = [m for m in masks if not x & m]
        assert all(any(not x & f for f in simhash.finer_masks(m)) for m in hit)


@pytest.mark.parametrize("block", [4096, 40])
def test_near_links_connect_what_brute_force_connects(spark, block):
    rng = random.Random(4)
    points = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            points.add(x - (1 << 64) if x >> 63 else x)
    points = sorted(points)
    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    found = dict(connected_components(simhash.near_links(fps, block)).collect())
    root = {p: p for p in points}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert {p: found.get(p, p) for p in points} == {p: top(p) for p in points}


def test_bucket_rows_are_not_broadcast(spark, monkeypatch):
    """Their estimated size leaves out that each fingerprint is exploded into one row per mask."""
    plans = []
    written = simhash.materialize
    fps = written(spark.createDataFrame([(i,) for i in range(50)], "fp long"))
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    links = simhash.near_links(fps)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    assert links.count() > 0


def test_near_duplicates(spark):
    rows = hard_rows()
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got[(1, 0)] == got[(2, 0)] == 1 and got[(8, simhash.fingerprint(rows[7][1]))] == 8
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(table(spark, rows)).columns == table(spark, rows).columns


def test_ring_chains_cover_every_pair_within_the_spare_segments():
    spare = simhash.spare_segments(0.8)
    chains = simhash.ring_chains(spare)
    assert (spare, len(chains), {len(c) for c in chains}) == (5, 2 * simhash.RING, {3})
    for differing in itertools.combinations(range(simhash.RING), spare):
        assert any(not {*c} & {*differing} for c in chains)


def test_ring_segments_are_equal_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(1)
    equal = []
    for _ in range(300):
        hashes = rng.integers(0, 1 << 63, 30_000 // 100, dtype=np.uint64) * np.uint64(2)
        other = np.concatenate([hashes[:267], rng.integers(0, 1 << 63, 33, dtype=np.uint64)])
        equal.append(simhash.ring_segments(hashes) == simhash.ring_segments(other))
    assert abs(np.mean(equal) - 267 / 333) < 0.02
    assert (simhash.ring_segments(np.arange(20_000, dtype=np.uint64)) == simhash.ring_segments(np.arange(20_000, dtype=np.uint64)[::-1])).all()


def _jaccard_components(rows, similarity=0.8):
    """Smallest id reachable over links, from the shingles of all pairs."""
    sets = {}
    for i, t, *_ in rows:
        words = re.findall("[^\\x20\\x09-\\x0D]+", low(t))
        n = min(5, len(words))
        sets.setdefault(i, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else {()})
    top = {i: i for i in sets if i is not None}
    for a in top:
        for b in top:
            if a < b and top[a] != top[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = {i: new if t == old else t for i, t in top.items()}
    return top


@pytest.mark.parametrize("block, shingles", [(simhash.SIGNATURES, simhash.BLOCK_SHINGLES), (20, 1 << 20), (simhash.SIGNATURES, 3000)])
def test_near_copies_connect_what_brute_force_connects(spark, block, shingles):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, t, None, None) for i, t in enumerate([None, "", "one", "One", "one two three", "x" * 100_000])] + [(None, "no id", None, None), (None, None, None, None)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for i in range(25):
            copy = list(base)
            for _ in range(i // 3):
                copy[rng.randrange(300)] = rng.choice(vocabulary)
            if i % 5 == 4:  # one stretch instead of scattered words
                at = rng.randrange(250)
                copy = base[:at] + [rng.choice(vocabulary) for _ in range(4 * (i // 5))] + base[at + 4 * (i // 5) :]
            rows.append((100 * (g + 1) + i, " ".join(copy), None, None))
    rows += [(1000 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(60)]), None, None) for i in range(40)]  # a shared passage alone
    rows += [rows[20], (2000, rows[20][1].upper(), None, None)]
    got = [(r.doc_id, r.component_id) for r in simhash.near_copies(table(spark, rows), block=block, shingles=shingles).collect()]
    assert len(got) == len(rows) and {c for i, c in got if i is None} == {None}
    assert {i: c for i, c in got if i is not None} == _jaccard_components(rows)


def test_near_copies_at_the_threshold(spark):
    rng = random.Random(9)
    rows = []
    for g in range(100):
        base = [f"g{g}w{i}" for i in range(204)]
        other = list(base)
        for at in rng.sample(range(5, 199, 6), 4 if g % 2 else 5):  # 180 of 220 shingles are common: 0.818; with five words changed 175 of 225: 0.778
            other[at] = "new"
        rows += [(2 * g, " ".join(base), None, None), (2 * g + 1, " ".join(other), None, None)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(table(spark, rows)).collect()}
    assert [got[2 * g + 1] == 2 * g for g in range(0, 100, 2)] == [False] * 50
    assert sum(got[2 * g + 1] == 2 * g for g in range(1, 100, 2)) >= 48  # the chains allow for a missed pair in fifty
    kept = simhash.drop_near_duplicates(table(spark, rows)).collect()
    assert {r.doc_id for r in kept} == {i for i, c in got.items() if i == c}


def test_sets_are_searched_exactly():
    rng = random.Random(10)
    sets = [sorted(rng.sample(range(12), rng.randint(1, 10))) for _ in range(300)]
    top = list(range(300))
    for a in range(300):
        for b in range(a):
            if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8:
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
    found = dict(simhash._alike(np.asarray(sum(sets, [])), np.asarray([len(x) for x in sets]), 0.8))
    assert [found.get(i, i) for i in range(300)] == top


def test_near_copies_of_an_empty_table(spark):
    assert simhash.near_copies(table(spark, [])).count() == 0 and simhash.drop_near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(500, i) for i in range(501, 900)] + [(7, 7), (300, 301), (301, 300)]
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(found[i] == 100 for i in range(101, 201)) and all(found[i] == 500 for i in range(501, 900)) and found[301] == 300
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rank_tokenizer_equals_the_tokenizer():
    plain = Tokenizer.from_file(default_vocabulary())
    plain.encode_special_tokens = True
    rng = random.Random(12)
    bits = ["a", "b'", "'s", " ", "  ", "\n", "\t", "12", "é", "\u3000", "\xa0", ".", "Word", "\x85", "ß", "<|endoftext|>", "語", "Я", "🙂", "\u200d"]
    texts = ["", " ", "it's  ok", "don't\nwe'll go.", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)), *(t or "" for _, t, *_ in hard_rows())]
    t = RankTokenizer(default_vocabulary())
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(t.encode(x), "<u4").tolist() for x in texts] == want
    long = "".join(rng.choice(bits) for _ in range(600_000))
    assert len(long) > tokens.PART and np.frombuffer(t.encode(long), "<u4").tolist() == plain.encode(long, add_special_tokens=False).ids
    assert len(t.encode("x" * (tokens.PART + 5))) > 0


def test_packing(spark):
    rows = hard_rows()
    got = packing.pack_documents(table(spark, rows), capacity=64, keep_ids=True).toPandas()
    t = RankTokenizer(default_vocabulary())
    for i, text in [(8, rows[7][1]), (2, ""), (12, rows[11][1])]:
        own = got[got.doc_id == i].sort_values("piece")
        ids = t.encode(text) + b"\0\0\0\0"
        assert b"".join(own.ids) == ids and [zlib.crc32(x) for x in own.ids] == own.ids_crc32.tolist()
        assert own.length.iloc[1:].eq(64).all() and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
    laid = got.sort_values(["sequence_id", "offset"])
    assert ((laid.groupby("sequence_id").length.cumsum() - laid.length) == laid.offset).all()
    assert laid.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() <= 1.1 * -(-got.length.sum() // 64) + 2
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_packing_plan_places_every_rank_once():
    rng = np.random.default_rng(0)
    lengths = Counter(rng.integers(1, 200, 5000).tolist() + [200] * 30 + [77] * 900)
    made = packing.plan(dict(lengths), 200)
    plain = packing.Plan(200)  # best-fit alone, longest first
    for x in sorted(lengths, reverse=True):
        plain.best_fit(x, lengths[x])
    for x, n in lengths.items():
        spans = sorted((lo, hi) for length, lo, hi, _, _ in made.places if length == x)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    filled = Counter()
    for length, lo, hi, first, _ in made.places:
        for s in range(first, first + hi - lo):
            filled[s] += length
    assert max(filled.values()) <= 200 and made.sequences <= 1.01 * plain.sequences


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        words = [rng.choice("lorem ipsum dolor sit amet nunc erat velit odio".split()) for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["grobian", "grobianus", "scum", "idiot"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, "SCUM! you are an idiot", "en", "s")]
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], t) for i, _, t in labels if i % 5 == 0]
    assert sum((s >= 0.5) == t for s, t in held) >= 0.97 * len(held)
    assert got[1002] > 0.5 > got[1001] == got[1000] and len(got) == len(rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in got.values())
    nothing = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(docs, nothing).filter("score > 0.5").count() >= 1
    assert toxicity.score(table(spark, []), model).count() == 0


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < p, np.where(truth, 1, -1), rng.choice([-1, 0, 1], 4000)) for p in (0.9, 0.8, 0.7, 0.05)] , axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1).astype(np.int8)
    rates, share, post, linked = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == truth).mean() > 0.93
    assert any({a, b} == {0, 4} for a, b, _ in linked) or share[0] <= 1


def test_suffix_automaton_against_substrings():
    rng = random.Random(6)
    text = [rng.randint(0, 3) for _ in range(300)]
    moves = language_id.suffix_automaton(text)
    joined = "".join(map(str, text))
    for _ in range(3000):
        probe = [rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
        state = 1
        for c in probe:
            state = moves[state].get(c, 0)
        assert (state > 0) == ("".join(map(str, probe)) in joined)


def test_language_id(spark):
    rng = random.Random(7)
    sound = {"en": "the of and ing tion er".split(), "xx": "zuk oma laat prib wek ön".split()}
    rows = [(i, " ".join("".join(rng.choice(sound[x]) for _ in range(3)) for _ in range(40)), x, "s") for i, x in enumerate(["en", "xx"] * 60)]
    docs = table(spark, [*rows, (900, None, "en", "s"), (901, "123 !!", "xx", "s"), (902, "", None, "s"), (903, rows[1][1] * 50, "xx", "s")])
    model = language_id.fit(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == x for i, _, x, _ in rows) and got[903][0] == "xx"
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    empty = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def _plain_phrases(text, train):
    """Longest phrases of a text that stand in any of the training texts, block by block."""
    n = 0
    for at in range(0, len(text), language_id.BLOCK):
        block = text[at : at + language_id.BLOCK]
        i = 0
        while i < len(block):
            j = i + 1
            while j < len(block) and any(block[i : j + 1] in t for t in train):
                j += 1
            i, n = j, n + 1
    return n


def test_cross_parsing_counts_longest_phrases(monkeypatch):
    rng = random.Random(13)
    letters = [chr(c) for c in (*range(ord("a"), ord("g")), *range(0x4E00, 0x4E08))]
    samples = {"a": ["abcabd abe", "".join(rng.choice(letters[:6]) for _ in range(200))], "b": ["xyz xyy", "".join(rng.choice(letters) for _ in range(200))]}
    texts = ["abcxyabdq", "".join(rng.choice(letters) for _ in range(2000)), "q", "ab ab"]
    for dense in (64, 4):  # few symbols with a dense table: the others are found in the list
        monkeypatch.setattr(language_id, "DENSE", dense)
        model = language_id.Model(samples)
        counts = language_id.count_phrases([language_id.encode(t, model.tables["symbols"]) for t in texts], model.tables)
        assert counts.tolist() == [[_plain_phrases(t, samples[x]) for x in "ab"] for t in texts]


def test_languages_of_other_scripts(spark):
    """Han, kana, Hangul, Cyrillic, Arabic and Devanagari are told apart, by letters of any script."""
    words = {
        "zh": "我们 今天 天气 很好 他们 学习 中文 经济 发展 社会 问题", "ja": "私たち は 今日 天気 が いい 日本語 を 勉強 して います こと", "ko": "우리 는 오늘 날씨 가 좋다 한국어 를 공부 한다 문제",
        "ru": "мы сегодня погода хорошая они учат язык россия жизнь вопрос", "bg": "ние днес времето е хубаво те учат език българия живот въпрос", "ar": "نحن اليوم الطقس جميل هم يدرسون اللغة العربية الحياة", "hi": "हम आज मौसम अच्छा है वे हिन्दी भाषा पढ़ते हैं जीवन", "en": "we today the weather is good they study language life question",
    }
    rng = random.Random(14)
    rows = []
    for i in range(400):
        lang = sorted(words)[i // 4 % 8]
        rows.append((i, ("" if lang in ("zh", "ja") else " ").join(rng.choice(words[lang].split()) for _ in range(20)), lang, "s"))
    docs = table(spark, rows)
    model = language_id.fit(docs, F.col("doc_id") % 4 != 2, chars=4000)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [got[i] for i, *_ in rows] == [x for _, _, x, _ in rows]


def test_training_texts_are_whole_and_bounded(spark):
    rows = [(i, "short text " * 3, "en", "s") for i in range(50)] * 20 + [(1000, "long " * 40_000, "en", "s"), (1001, "nur lang " * 40_000, "de", "s")]
    model = language_id.fit(table(spark, rows), chars=8000)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(table(spark, rows), model).collect()}
    assert len(model.tables["dense"]) < 5000 and got[1001] == "de" and got[3] == "en"


def test_lcp_fingerprints(spark):
    rows = hard_rows()
    got = lcp.edited_likeness(table(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, *_ in order]
    want = Counter()
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        n = len(t) // 3
        want[(order[k][0], len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    long = random.Random(8)
    text = "".join(long.choice("abcdefgh ") for _ in range(4000))
    a, b, c = lcp.sketches([text, "shifted by this " + text, "".join(long.choice("abcdefgh ") for _ in range(4000))])
    assert lcp.likeness(a, b) > 0.8 and lcp.likeness(a, c) < 0.1 and lcp.likeness(a, a) == 1
    assert lcp.edited_likeness(table(spark, [])).count() == 0
    assert lcp.edited_likeness(table(spark, [(1, "only", "en", "s")])).count() == 1


def test_chat(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for conv in range(40):
        turns = [("system", "rules " * 5)] * (conv % 3 == 0) + [(("user", "assistant")[k % 2], " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80)))) for k in range(rng.randint(1, 30) if conv else 900)]
        rows += [(conv, k, r, t, "extra") for k, (r, t) in enumerate(turns)]
        want[conv] = turns
    rows += [(98, 0, "system", "alone", "x"), (99, 0, "user", None, "x"), (99, 1, "assistant", "<|im_end|><|im_start|>assistant ok <\\| <\\\\|", "x"), (99, 1, "assistant", "<|im_end|><|im_start|>assistant ok <\\| <\\\\|", "x"), (None, None, None, "stray", "x")]
    want |= {98: [("system", "alone")], 99: [("user", ""), *[("assistant", "<|im_end|><|im_start|>assistant ok <\\| <\\\\|")] * 2], None: [("", "stray")]}
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string"), budget=200, history=60)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shape = windows.toPandas()
    count = RankTokenizer(default_vocabulary())
    assert shape.n_tokens.tolist() == [len(count.encode(x)) // 4 for x in shape.formatted]
    over = shape[shape.n_tokens > 200]
    assert (over.n_new == 1).all() and (over.n_system == 0).all() and (over.n_repeated == 0).all() and shape.n_repeated.max() > 0
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_windows_keep_the_budget_beside_long_system_turns(spark):
    """Of 200 tokens: a system turn above the budget or above half of it is a turn like others; one below is left out where a turn has room only without it."""
    rows, want = [], {}
    for conv, (n_system, sizes) in enumerate([(3000, [5, 5, 300, 5]), (150, [5, 30, 5]), (70, [120, 5, 5, 150, 5, 5]), (70, [400, 5]), (70, []), (10, [5] * 30)]):
        turns = [("system", "rules " * n_system)] + [(("user", "assistant")[k % 2], "word " * n) for k, n in enumerate(sizes)]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
        want[conv] = turns
    windows = chat.chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=60)
    shape = windows.toPandas().sort_values(["conv_id", "stretch", "window"])
    count = RankTokenizer(default_vocabulary())
    assert shape.n_tokens.tolist() == [len(count.encode(x)) // 4 for x in shape.formatted]
    over = shape[shape.n_tokens > 200]
    assert [(c, a, b, d) for c, a, b, d in zip(over.conv_id, over.n_system, over.n_repeated, over.n_new)] == [(0, 0, 0, 1), (0, 0, 0, 1), (3, 0, 0, 1)]
    assert (shape[shape.conv_id == 0].n_system == 0).all() and (shape[shape.conv_id == 5].n_system == 1).all()
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv, turns in want.items():
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert got[conv].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(10)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\>a") for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_licenses(spark):
    rows = hard_rows()[:8] + [(100, "Licensed under the Apache License, Version 2.0. mit LICENSE mit license; CC-BY", "en", "s"), (101, "SPDX-License-Identifier: MPL-2.0", "en", "s"), (102, "GNU General Public License v3 or later\nall rights reserved", "en", "s"), (103, "x " * 5000 + "cc by " * 3, "en", "s")]
    got = {r.doc_id: r for r in licenses.license_labels(table(spark, rows)).collect()}
    a = got[100]
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels) == (14, 4, 3, 12, "apache,cc-by,mit") and "apache-2.0" in a.labels.split(",")
    assert got[101].labels == "mpl-2.0" and got[101].n_base == 0 and got[101].first_word is None
    assert {"gpl", "gpl-3.0", "all-rights-reserved"} == set(got[102].labels.split(","))
    assert (got[103].n_base, got[103].first_word, got[103].last_word) == (3, 5000, 5004)
    assert (got[1].n_words, got[1].labels, got[1].score) == (0, "", 0.0)
    every = licenses.rules()
    assert len(every) > 300 and all(any(s in r.keyword for s in licenses.stems(every)) for r in every)
    assert licenses.license_labels(table(spark, [])).count() == 0


def _phrases(parsed):
    """Every text that a license pattern matches; of a repeat, its least and greatest number (at most two)."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            ends = [chr(arg)]
        elif name == "IN":
            ends = [chr(c) for kind, x in arg for c in (range(x[0], x[1] + 1) if str(kind) == "RANGE" else [x])]
        elif name == "BRANCH":
            ends = [x for branch in arg[1] for x in _phrases(branch)]
        elif name == "SUBPATTERN":
            ends = _phrases(arg[3])
        else:
            low, high, inner = arg
            assert name == "MAX_REPEAT"
            ends = [x * n for x in _phrases(inner) for n in {low, min(int(high), 2)}]
        out = [a + b for a in out for b in dict.fromkeys(ends)]
    return out


def test_every_alternative_of_a_license_rule_contains_its_keywords():
    every = licenses.rules()
    stems = licenses.stems(every)
    for label, keyword, also, pattern, *_ in every:
        short = pattern.replace(licenses._GRANT, "licensed by ").replace(licenses._GRANT_UNDER, "licensed under ")
        for phrase in _phrases(re._parser.parse(short)):
            assert keyword in f" {phrase} " and also in f" {phrase} " and any(s in f" {phrase} " for s in stems), (label, phrase)


def test_license_names_without_the_usual_keyword(spark):
    texts = {"Licensed under the GNU GPL": "gpl", "Creative Commons Zero v1.0 Universal": "cc0-1.0", "The Software shall be used for Good, not Evil.": "json", "a Responsible AI License": "openrail-m"}
    got = licenses.license_labels(table(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == list(texts.values())


def test_license_texts(spark):
    """Sentences of license files, with their punctuation; a very long text around one of them."""
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
        "Redistribution and use in source and binary forms, with or without\n   modification, are permitted provided that the following conditions are met:\n 3. Neither the name of X may be used to endorse or promote products\n derived from this software without specific prior written permission.": "bsd,bsd-3-clause",
        "you may not use this file except in compliance with the License.": "apache-2.0",
        "lorem ipsum, " * 50_000 + "This is free and unencumbered software released into the public domain." + " dolor sit" * 50_000: "unlicense",
    }
    got = licenses.license_labels(table(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == list(texts.values())


def test_license_base_places_against_a_plain_scan(spark):
    rng = random.Random(18)
    bits = ["GNU", "general", "public", "License", "apache", "cc", "by", "CC-BY", "mit", "MIT", "license", "x", "É", ",", "\n", "\u00a0", "cc by by"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))), None, None) for i in range(300)] + [(900, None, None, None)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_labels(table(spark, rows)).collect()}
    for i, t, *_ in rows:
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low(t))
        found = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in found]
        assert got[i] == (len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def test_suppression_keeps_what_is_not_inside(spark):
    rules = [licenses.Rule("long", "a", "", "a b c", 2, 0.5, False), licenses.Rule("inner", "b", "", "b", 1, 0.5, False), licenses.Rule("cross", "c", "", "c d", 1, 0.5, False), licenses.Rule("strong", "b", "", "b c", 3, 0.5, False)]
    (r,) = licenses.detect(spark.createDataFrame([(1, "a b c d b")], "doc_id long, text string"), rule_list=rules).collect()
    assert sorted((h.label, h.first) for h in r.kept) == [("cross", 2), ("inner", 4), ("long", 0), ("strong", 1)]


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.NET/en/x?y=1#z"), (4, "http://fakeexample.net/en/"), (5, "ftp://a.org"), (6, "http://a.org/fr/?x"), (7, "http://b.example.com/de/1"), (8, "http://org/fr/"), (9, "http://net"), (9, "http://net"), (None, "http://q.net/x")]
    rows += [(100 + i, f"http://shop{i % 7}.example.com/en/{i}.html") for i in range(60)] + [(300 + i, f"http://www.casino-{i}.example.org/en/{i}") for i in range(30)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, None)] == [
        ("", "", None), ("", "", None), ("www.example.net", "/en/x", "example.net/en/"), ("fakeexample.net", "/en/", "net/"), ("a.org", "", None), ("a.org", "/fr/", "org/fr/"),
        ("b.example.com", "/de/1", "example.com/de/"), ("org", "/fr/", "org/fr/"), ("net", "", None), ("q.net", "/x", "net/"),
    ]
    assert got[4].verdict == "block" and got[3].verdict == "allow" and got[310].verdict == "block" and got[110].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_rare_block_words_are_mined(spark):
    rows = [(i, f"http://shop{i % 7}.example.com/en/{i}") for i in range(3000)] + [(5000, "http://www.cheap-pills.example.com/en/1")]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[5000].verdict, got[5000].mined_rule, got[5000].confidence) == ("block", "host:pills", 1.0)
    assert got[5].verdict == "allow"
    labelled = spark.createDataFrame([(["host:mirror"], "block")] * 25 + [(["host:few"], "block")] * 24 + [(["host:shop"], "allow")] * 5000, "tokens array<string>, label string")
    assert [(r.antecedent, r.verdict) for r in url_filter.mine(labelled).collect() if r.verdict == "block"] == [(["host:mirror"], "block")]  # half a percent of the rows
    (only,) = url_filter.judge(spark.createDataFrame([(1, "http://ads.example.com/en/1")], "page_id long, url string")).collect()
    assert only.verdict == "block"


def test_mining_a_template_of_many_tokens(spark):
    """Sixteen tokens that always stand together are one item; ten that mostly do are combined up to a limit."""
    fixed = [f"path:t{i:02}" for i in range(16)]
    rng = random.Random(16)
    rows = [([*fixed, "host:bad"], "block")] * 40 + [([*fixed, "host:good"], "allow")] * 60
    rows += [([x for x in (f"query:q{i}" for i in range(12)) if rng.random() < 0.97], "allow") for _ in range(100)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    made = [r["items"] for r in url_filter.items(labelled, 0.01, 8).collect()]
    assert len(made) == len(rows) and max(map(len, made)) <= 9
    assert Counter(tuple(sorted(x)) for x in made)[("host:bad", "path:t00", "verdict:block")] == 40
    rules = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_filter.mine(labelled, seeds=[]).collect()}
    assert rules[(("host:bad",), "block")] == 1.0 and not any("path:t01" in a for a, _ in rules)


def test_mined_rules_are_all_that_a_plain_enumeration_finds(spark):
    """Twelve tokens beside each other, most with both verdicts: all their subsets count."""
    rng = random.Random(18)
    names = [f"t{i:02}" for i in range(10)]
    rows = []
    for _ in range(300):
        own = [x for i, x in enumerate(names) if rng.random() < 0.95 - 0.04 * i]
        bad = {"t08", "t09"} <= {*own} or "t00" not in own and rng.random() < 0.8
        rows.append((sorted([*own, "all", *(["sure"] if bad and rng.random() < 0.4 else [])]), "block" if bad else "allow"))
    found, of_label = {}, Counter(v for _, v in rows)
    every = ["all", "sure", *names]
    for k in range(1, len(every) + 1):
        for x in itertools.combinations(sorted(every), k):
            having = Counter(v for t, v in rows if {*x} <= {*t})
            for v, n in having.items():
                confidence = n / having.total()
                if n >= 15 and confidence >= 0.7 and confidence / (of_label[v] / len(rows)) > 1:
                    found[x, v] = confidence
    want = {(x, v): c for (x, v), c in found.items() if not any(found.get((x[:i] + x[i + 1 :], v), 0) >= c for i in range(len(x)))}
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_filter.mine(labelled, min_support=0.05, seeds=[]).collect()}
    assert max(len(t) for t, _ in rows) > 10 and (("t08", "t09"), "block") in want
    assert got == want


def test_rules_apply_as_in_a_plain_scan(spark):
    rng = random.Random(17)
    names = [f"t{i}" for i in range(12)]
    rules = list({tuple(sorted(rng.sample(names, rng.randint(1, 3)))): (rng.choice(["block", "allow"]), rng.choice([0.7, 0.8, 0.9]), rng.choice([0.1, 0.2])) for _ in range(40)}.items())
    sets = list({tuple(sorted(rng.sample(names, rng.randint(0, 8)))) for _ in range(200)})
    table = spark.createDataFrame([(list(a), v, c, s, 2.0) for a, (v, c, s) in rules], "antecedent array<string>, verdict string, confidence double, support double, lift double")
    got = {tuple(r.tokens): (r.mined.verdict, r.mined.confidence, r.mined.antecedent) for r in url_filter.apply(spark.createDataFrame([(list(x),) for x in sets], "tokens array<string>"), table).collect()}
    want = {}
    for x in sets:
        fits = [(-c, -s, " ".join(a), v) for a, (v, c, s) in rules if {*a} <= {*x}]
        if fits:
            c, _, a, v = min(fits)
            want[x] = (v, -c, a)
    assert got == want


def test_mixing(spark):
    rows = hard_rows()
    got = mixing.mix(table(spark, rows), share=0.7, max_epochs=2).toPandas()
    per_leaf = got.groupby(["domain", "lang", "source"]).agg(t=("taken_tokens", "sum"), b=("leaf_budget", "first"))
    assert (per_leaf.t == per_leaf.b).all()
    assert (got[got.epoch == 0].taken_tokens <= got[got.epoch == 0].n_tokens).all()
    assert mixing.mix(table(spark, [])).count() == 0
    kept = mixing.select_documents(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and 0 < kept.count() <= len(rows)


def test_shortages_go_to_siblings_first():
    leaves = [mixing.Leaf(("web", "en", "a"), 10), mixing.Leaf(("web", "en", "b"), 1000), mixing.Leaf(("books", "en", "c"), 1000)]
    weights = {"web": (1, {"en": (1, {"a": (1, {}), "b": (1, {})})}), "books": (1, {})}
    assert mixing.budgets(leaves, weights, 400, 1) == {("web", "en", "a"): 10, ("web", "en", "b"): 190, ("books", "en", "c"): 200}
    assert mixing.budgets(leaves, weights, 2000, 1) == {("web", "en", "a"): 10, ("web", "en", "b"): 990, ("books", "en", "c"): 1000}
    assert mixing.share_out(7, [1, 1, 1], [1, 9, 9]) == [1, 3, 3]


def test_children_of_weight_zero_are_no_room():
    leaves = [mixing.Leaf(("a", "x"), 10), mixing.Leaf(("a", "y"), 1000), mixing.Leaf(("b", "z"), 1000)]
    weights = {"a": (1, {"x": (1, {}), "y": (0, {})}), "b": (1, {})}
    assert mixing.budgets(leaves, weights, 300, 1) == {("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 290}


def test_mixing_against_a_plain_selection(spark):
    """Documents in the order of their hash, leaf by leaf, until the budget is used; documents without tokens count where they stand."""
    rng = random.Random(15)
    rows = [(i, " ".join(["w"] * rng.choice([0, 0, 1, 5, 40])), rng.choice(["en", "de", None]), f"src{rng.randrange(12)}") for i in range(800)]
    docs = table(spark, rows)
    got = Counter((r.doc_id, r.epoch, r.taken_tokens) for r in mixing.mix(docs, share=0.9, max_epochs=2, seed=3).collect())
    sizes = {i: len((t or "").split()) for i, t, *_ in rows}
    leaf = {r.doc_id: (r.domain, r.lang or "", r.source) for r in docs.select("doc_id", mixing.domain_of(F.col("source")).alias("domain"), "lang", "source").collect()}
    have = Counter()
    for i, n in sizes.items():
        have[leaf[i]] += n
    budget = mixing.budgets([mixing.Leaf(k, n) for k, n in have.items()], mixing.WEIGHTS, int(sum(have.values()) * 0.9), 2)
    full = {k: budget[k] // have[k] if have[k] else 0 for k in have}
    keyed = spark.createDataFrame([(i, full[leaf[i]]) for i in sizes], "__id long, __full long")
    place = {r[0]: r[1] for r in keyed.select("__id", mixing._order(3)).collect()}
    want = Counter()
    for k in have:
        left = budget[k] - full[k] * have[k]
        for epoch in range(full[k]):
            want.update((i, epoch, sizes[i]) for i in sizes if leaf[i] == k)
        for i in sorted((i for i in sizes if leaf[i] == k), key=lambda i: (place[i], i)):
            if left > 0:
                want[(i, full[k], min(left, sizes[i]))] += 1
                left -= min(left, sizes[i])
    assert got == want


def test_mixing_of_more_leaves_than_the_driver_takes(spark, monkeypatch):
    """Budgets of windows over siblings equal those of the plain recursion, with weights of 0, unnamed nodes and budgets below one token a leaf."""
    rng = random.Random(4)
    weights = {"web": (0.61, {"en": (0.55, {"src1": (3, {}), "src2": (0, {})}), "de": (0, {})}), "books": (0.25, {"fr": (0.3, {})}), "forum": (0, {})}
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 60])), rng.choice(["en", "de", "fr", None]), f"src{rng.randrange(23)}") for i in range(600)]
    docs = table(spark, rows)
    keyed = mixing._keyed(docs, None).cache()

    def both(w, total, epochs):
        found = []
        for most in (100_000, 0):
            monkeypatch.setattr(mixing, "MAX_LEAVES", most)
            found.append(sorted(map(tuple, mixing._leaf_budgets(keyed, w, total, 0.7, epochs).rows.select(*mixing._LEAF, "__budget", "__full", "__part").collect())))
        return found

    for w in (weights, mixing.WEIGHTS, {}):
        for total, epochs in ((None, 1), (5, 1), (0, 2), (1234, 2), (10**9, 1)):
            few, many = both(w, total, epochs)
            assert few == many and len(few) > 50
    plain = sorted(map(tuple, mixing.mix(docs, weights).collect()))
    assert plain == sorted(map(tuple, (monkeypatch.setattr(mixing, "MAX_LEAVES", 100_000), mixing.mix(docs, weights))[1].collect()))
    monkeypatch.setattr(mixing, "MAX_LEAVES", 0)
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.select_documents(docs).count() > 0
    for _ in range(200):
        n = rng.randrange(1, 7)
        w, room, budget = [rng.choice([0, 0.1, 1, 2.5]) for _ in range(n)], [rng.randrange(20) for _ in range(n)], rng.randrange(60)
        got = mixing.share_out(budget, w, room)
        assert all(0 <= g <= r for g, r in zip(got, room, strict=True)) and sum(got) == min(budget, sum(r for r, x in zip(room, w, strict=True) if x))
