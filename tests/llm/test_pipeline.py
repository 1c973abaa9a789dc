"""The stages on the small documents of the driver, each against what it should have done to its input."""

import random

import corpus_pipeline
from meridian.llm import toxicity
from meridian.llm.common import materialize, read_table
from meridian.llm.simhash import near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    model = toxicity.fit(docs, read_table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.5").collect()}
    clean = materialize(stages["toxicity"](spark, docs, SF))
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    single = materialize(stages["exact dedup"](spark, clean, SF))
    best = {}
    for r in clean.collect():
        key = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in single.collect()} == set(best.values())
    apart = materialize(stages["SimHash near-dedup"](spark, single, SF))
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in near_copies(single).collect()}
    mixed = materialize(stages["mixing sources to target weights"](spark, apart, SF))
    assert mixed.columns == columns and 0.7 * apart.count() < mixed.count() <= apart.count()
    packed = stages["best-fit packing"](spark, mixed, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in mixed.collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def _hard(spark, rows):
    """Documents with further columns whose names the stages use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, "a", "b", 7, 8) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, node string, n long, root long")


def test_every_stage_on_nulls_repeats_ties_and_nothing(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(150)]
    near = base[:70] + ["changed"] + base[71:]
    rows = [(1, None, None, None), (2, "", "en", "src1"), (None, None, "en", "src1"), (None, "no id", "de", None), (3, "Same", "en", "src1"), (4, "same", "en", "src2"), (5, "same", "en", "src9"), (5, "same", "en", "src9")]
    rows += [(6, " ".join(base), "en", "src3"), (7, " ".join(near), "en", "src3"), (8, " ".join(base).upper(), "fr", "src20"), (9, "long " * 60_000, "en", "src4")]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 50))), rng.choice(["en", "de"]), f"src{i % 20}") for i in range(40)]
    spark.createDataFrame([(6, 1, 0), (20, 1, 0), (None, 1, 1), (21, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(_hard(spark, rows))
    none = materialize(_hard(spark, []))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name != "best-fit packing":
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    clean = stages["toxicity"](spark, docs, str(tmp_path)).collect()
    assert len(clean) == len(rows)  # no seed word in them
    single = materialize(stages["exact dedup"](spark, docs, str(tmp_path)))
    best = {}
    for r in docs.collect():
        text = (r.text or "").lower()
        best[text] = max(best.get(text, r), r, key=key)
    assert sorted(single.collect(), key=key) == sorted(best.values(), key=key)
    kept = materialize(stages["SimHash near-dedup"](spark, single, str(tmp_path)))
    gone = {r.doc_id for r in single.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {8}  # near copy of 7; 6 had gone as its exact copy
    mixed = materialize(stages["mixing sources to target weights"](spark, kept, str(tmp_path)))
    ids = [r.doc_id for r in mixed.collect()]
    assert len(ids) == len(set(ids)) and 2 in ids and set(ids) <= {r.doc_id for r in kept.collect()}
    packed = stages["best-fit packing"](spark, docs, str(tmp_path)).toPandas()
    whole = packed.groupby("doc_id", dropna=False).length.sum()
    assert whole[2.0] == 1 and whole[5.0] == 2 * whole[4.0] and packed.groupby("sequence_id").length.sum().max() <= 2048
    assert len(packed[packed.doc_id.isna()]) == 2
