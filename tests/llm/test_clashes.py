"""Extra columns whose names clash with those that an operator makes or uses: made ones are replaced, all others keep their values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import langid, minhash, mixing, quality, sharding, suffix_dedup
from larkspur.llm.common import Tables

NAMES = "doc tie runs wanted cdf whole rate draws hash depth fine_prefix overflow trusted score label node component h1 bands key u v ids path kind start count shard __letter".split()


@pytest.fixture()
def clashing(spark):
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", "a" * 300, "x " * 60 + "many words that follow one another in this text", "x " * 60 + "many words that follow one another in this text"]
    rows = [(k, t, "en", f"s{k % 2}", 1) for k, t in enumerate(texts)] + [(None, "of no id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})


def kept(before, after, made=()):
    names = [n for n in NAMES if n not in made]
    pick = lambda df: {tuple(r) for r in df.select("doc_id", *[F.col(f"`{n}`") for n in names]).collect()}
    got, want = pick(after), pick(before)
    return got <= want and bool(got) and all(r[1] is not None for r in got)


def test_operators(spark, clashing):
    assert kept(clashing, mixing.mix(clashing)) and kept(clashing, sharding.shard(clashing, 200, Tables(spark, "t")))
    assert kept(clashing, suffix_dedup.dedup(clashing, Tables(spark, "t")))
    assert kept(clashing, langid.identify(clashing, langid.fit(clashing, 50), clashing.columns), ("score",))
    assert minhash.link(clashing, Tables(spark, "t")).count() == clashing.count()
    assert quality.rate(clashing, spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"), Tables(spark, "t")).count() == clashing.count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, clashing, name, stage):
    out = stage(spark, clashing, None)
    if name == "sentencepiece":
        assert kept(clashing, out, ("ids",)) and out.count() == clashing.count()
    else:
        assert out.columns == clashing.columns and kept(clashing, out)
    again = stage(spark, clashing.unionByName(clashing), None)  # repeated rows
    assert again.columns == out.columns and {r.doc_id for r in again.collect()} >= {r.doc_id for r in out.where("doc_id is not null").collect()} - {3, 6}


@pytest.mark.parametrize("labels", [500_000, 0])
def test_labels_beyond_a_broadcast(spark, clashing, monkeypatch, labels):
    monkeypatch.setattr(quality, "BROADCAST_LABELS", labels)
    rated = quality.rate(clashing, spark.createDataFrame([(5, 1, 0), (6, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int"), Tables(spark, "t"))
    got = {r.doc_id: (r.n_words, r.kept) for r in rated.collect()}
    assert got[5] == got[6] and len(got) == 8 and rated.first()["threshold"] is not None


@pytest.mark.parametrize("mean", [0.5, 31, 33, 1000])
def test_counts_are_poisson_at_every_rate(spark, mean):
    n = 2_000 if mean < 100 else 400
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    per = {r["doc_id"]: r["count"] for r in mixing.mix(docs, {"a": 1}, rows=n * mean, shuffle=False).groupBy("doc_id").count().collect()}
    count = np.array([per.get(k, 0) for k in range(n)])
    assert abs(count.mean() - mean) < 4 * (mean / n) ** 0.5 and 0.8 < count.var() / mean < 1.2
