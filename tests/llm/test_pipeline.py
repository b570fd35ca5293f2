"""The pipeline's stages against a brute-force version, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from pagewright.llm import bt_quality, quality_rules

from .test_operators import WORD, assert_packed, lines_by_hand, near_by_hand, odd_docs, rules_by_hand

SF = "/root/testdata/sf0.001"


def rules_keep(text):
    """The verdict of the threshold table, counted by hand."""
    n_words, chars, symbols, dup_lines, _, base_failed = rules_by_hand(text)
    t = text or ""
    plain = t.lower().translate(str.maketrans(dict.fromkeys(quality_rules.MARKS, " ")))
    stops = sum(w in quality_rules.STOP_WORDS for w in WORD.findall(plain))
    n_lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    bad = symbols > 0.1 * n_words or chars > 25 * n_words or chars < 1.5 * n_words or (n_words >= 30 and (stops < 0.02 * n_words or dup_lines > 0.5 * n_lines))
    return not base_failed and not bad


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == names
    texts = [{r["doc_id"]: r["text"] for r in x.collect()} for x in seen]
    assert texts[1] == {d: t for d, t in texts[0].items() if rules_keep(t)}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in texts[1] if labels.get(d) == 1]
    assert len([d for d in good if d in texts[2]]) > 0.9 * len(good)
    model = bt_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    features = {r["doc_id"]: r["x"] for r in docs.select("doc_id", bt_quality.features(F.col("text")).alias("x")).collect()}
    assert texts[2] == {d: t for d, t in texts[1].items() if sum(w * x for w, x in zip(model.weights, features[d], strict=True)) >= model.threshold}
    cut = lines_by_hand(texts[2])
    assert texts[3] == {d: t for d, t in cut.items() if t == texts[2][d] or t.strip(" \t\n\r")}
    near = near_by_hand(texts[3], 5)
    assert set(texts[4]) == {d for d in texts[3] if near[d][1] == d}
    assert_packed(corpus_pipeline.packing(spark, seen[-1], SF).collect(), texts[4])


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    assert_packed(corpus_pipeline.run(spark, SF).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_stages_on_odd_rows(spark, tmp_path):
    for docs in (odd_docs(spark), odd_docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs.withColumn("n_chars", F.lit(1)), SF)
            assert set(out.columns) == {*docs.columns, "n_chars"}, name
            out.count()
