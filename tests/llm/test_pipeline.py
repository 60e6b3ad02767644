"""The corpus pipeline on a small table: stages work on what the one before kept, and their decisions take effect."""

import random

import corpus_pipeline as C
from veilframe.llm import decontaminate, ngram_join, quality, suffix_dedup
from veilframe.llm.common import materialize

from .conftest import near, prose


def test_stages_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    clean = [prose(rng, rng.randint(20, 90)) for _ in range(60)]
    passage = prose(rng, 20)
    texts = clean + [near(rng, clean[0], 1), clean[1], None, "", f"{prose(rng, 15)} {passage} {prose(rng, 15)}"]
    texts += [" ".join(f"{w}###" for w in prose(rng, 40).split()) for _ in range(25)]
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts) - 25), 0) for i in range(len(texts)) if texts[i]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, d), name)
        if name != C.STAGES[-1][0]:
            assert docs.columns == C.COLUMNS
        seen.append({r.doc_id: r.text for r in docs.collect()})
    kept = seen[1]
    assert set(range(60)) <= set(kept) and not any("###" in (t or "") for t in kept.values())
    groups = ngram_join.brute_force(list(kept.items()))
    assert set(seen[2]) == {i for i in kept if groups[i][1] == i}
    cut = suffix_dedup.brute_force(list(seen[2].items()))
    assert {i: len(t.encode()) for i, t in seen[3].items()} == {i: x[0] - x[1] for i, x in cut.items()}
    assert all(decontaminate.brute_force(t, [("1", passage)])[1] == 0 for t in seen[4].values()) and set(seen[4]) == set(seen[3])
    assert seen[5] == seen[4]
    assert quality.THRESHOLD == 0.3 and C.run(spark, d).count() == len(seen[5])


def small_tables(spark, folder, documents):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i, *_ in documents if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    small_tables(spark, tmp_path, [])
    out = C.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]


def test_very_long_texts_and_clean_up(spark, tmp_path):
    from veilframe.llm import common

    rng = random.Random(5)
    long = prose(rng, 150_000)
    texts = [long, prose(rng, 40), "y" * 300_000, None]
    small_tables(spark, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)])
    folder = __import__("pathlib").Path(common.shared_dir(spark).removeprefix("file:")) / "veilframe"
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = C.run(spark, str(tmp_path))
    got = {r.doc_id: r.text for r in rows.collect()}
    kept = quality.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert set(got) == {r.doc_id for r in kept.filter(f"score >= {quality.THRESHOLD}").collect()}
    assert all(len(got[i]) <= len(texts[i] or "") for i in got) and (0 not in got or got[0] == long)
    left = set(folder.iterdir()) - before
    assert len(left) == 1 and rows.inputFiles()[0].find(left.pop().name) > 0  # nothing but the result stays


def test_stages_keep_documents_without_an_id_of_their_own(spark):
    rng = random.Random(4)
    texts = [prose(rng, 40) + f" {i}" for i in range(12)]
    ids = [0, 1, 2, 3, 3, 3, None, None, 8, 9, 9, 10]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)] + [(9, texts[0], "en", "s", len(texts[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = materialize(C.near_duplicate_stage(spark, docs, ""), "kept")
    assert kept.columns == C.COLUMNS and sorted(map(str, kept.collect())) == sorted(map(str, docs.limit(12).collect()))
    cut = C.repeat_stage(spark, docs, "")
    texts_out = sorted((str(r.doc_id), r.text, r.n_chars) for r in cut.collect())
    assert cut.columns == C.COLUMNS and texts_out == sorted([(str(i), t, len(t)) for i, t in zip(ids, texts)] + [("9", "", 0)])


def test_quality_stage_learns_from_every_label(spark, tmp_path):
    """More labelled documents than any bound that there was: of those that are learnt from, the stage rejects exactly as many as
    have label 0. Labels that are held out are turned to 0, so that learning from them would reject more."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("aeinorst .,#") if rng.random() < 0.8 - i % 2 * 0.2 else "#" for _ in range(rng.randint(60, 120))) for i in range(30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    learnt = {r.doc_id for r in docs.filter(~quality.held_out("doc_id")).collect()}
    spark.createDataFrame([(i, int(i % 2 and i in learnt), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in C.quality_stage(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert len(learnt) > 20_000 and len(learnt - kept) == sum(i % 2 == 0 for i in learnt)
