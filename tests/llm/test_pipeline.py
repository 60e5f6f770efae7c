"""The pipeline's stages against their operators, and on odd rows."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from mealops.llm import mil_quality, mixing, near_dups, target_ratio
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return Counter(map(str, df.collect()))


def test_stages(spark, data_dir, tmp_path):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data_dir)
        if name != "pack":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            judged = target_ratio.judge(docs.select("doc_id", "text"), labels)
            assert _rows(out) == _rows(docs.join(judged.filter("kept").select("doc_id"), "doc_id").select(COLUMNS))
            assert out.count() < docs.count()
        elif name == "quality_classifier":
            raw = spark.read.parquet(f"{data_dir}/documents.parquet")
            score = mil_quality.scorer(mil_quality.train(raw, labels))(F.col("text"))
            assert _rows(out) == _rows(docs.filter(score >= 0.3))
        elif name == "near_dedup":
            kept = near_dups.near_duplicates(docs).filter("kept").select("doc_id")
            assert _rows(out) == _rows(docs.join(kept, "doc_id").select(COLUMNS))
            assert near_dups.near_duplicates(out).filter("NOT kept").count() == 0
        elif name == "mix_sources":
            plan = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
            assert Counter(r["doc_id"] for r in out.collect()) == Counter(
                {i: n for i, (t, s) in plan.items() if (n := int(t / s + 0.5) if s else 0)})
        else:
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
        docs = out


def test_classifier_rejects(spark):
    d = "/root/testdata/sf0.01"
    raw = spark.read.parquet(f"{d}/documents.parquet")
    kept = pipeline.quality_classifier(spark, raw, d)
    bad = raw.join(spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0"), "doc_id")
    assert kept.count() < raw.count()
    assert kept.join(bad.select("doc_id"), "doc_id").count() < 0.2 * bad.count()


def test_odd_rows(spark, data_dir):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", None), (1, text, "en", "a", None), (2, text + " more", None, None, 3), (None, text, "en", "a", 1),
            (3, None, None, None, None), (4, "", "en", "b", 0), (5, "short one", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumn("row", F.lit(1)).withColumn("score", F.lit("s")).withColumn("kept", F.lit(0)).withColumn("_copies", F.lit(2))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data_dir)
        if name != "pack":
            assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), data_dir).count() == 0
    one = pipeline.near_dedup(spark, docs, data_dir).collect()
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "3", "4", "5", "None"]


def test_run(spark, data_dir):
    out = pipeline.run(spark, data_dir)
    assert out.filter("length > 2048 OR length < 1").count() == 0 and out.count() > 0
