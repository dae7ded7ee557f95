"""Chat formatting, neighbour search and the pipeline against brute force and SQL."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import ann, chat, langid, minhash, mixing, queries, sentencepiece_ops, suffix_dedup
from larkspur.llm.common import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


def test_chat_is_reversible(spark):
    rng = random.Random(3)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "é", " a", "\n", "s>", "/INST]"]
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL) for t in ("".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(3_000)))
    rows = [(c, k, rng.choice(["user", "assistant", "system", "[ROLE]x", None]), rng.choice([None, "", "".join(rng.choices(bits, k=8))])) for c in (1, 2, None) for k in (0, 1, 2, 2, None)]
    rows.append(rows[0])
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(turns)).collect()}
    for c in (1, 2, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda v: v[:2])
        got = out[c]
        assert got.n_turns == len(own) and got.loss_chars == sum(len(x) for *_, r, x in own if r == "assistant")
    flat = chat.format_chats(turns).where("conv_id = 2").orderBy("seq").collect()
    place = 0
    for r in flat:
        assert r.token_start == place and len(r.ids) == len(r.loss_mask)
        place += len(r.ids)
    assert "".join(r.formatted for r in flat).startswith("<s>") and chat.format_chats(turns.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3_000)] + 0.3 * rng.normal(size=(3_000, 16))).astype(np.float32)
    x[10:40] = x[0]
    rows = [(k, x[k].tolist()) for k in range(3_000)] + [(100_000, None), (100_100, []), (100_200, [0.0] * 16), (100_300, [float("nan")] * 16), (100_400, [None] * 16), (None, x[5].tolist()), (7, x[7].tolist())]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.search(given, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3_000, 100))
    hit = 0
    exact = x.astype(np.float64)
    for q, found in got.items():
        far = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        best = [k for k in np.lexsort((np.arange(3_000), far)) if k != q][:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        hit += len(set(best) & {v for _, v, _ in found})
        assert all(abs(s - far[v]) < 1e-12 for _, v, s in found)
    assert hit / (10 * len(got)) > 0.97
    assert [v for _, v, _ in sorted(got[0])] == list(range(10, 20))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    x = rng.normal(size=(600, 8))
    once = [(k, v.tolist()) for k, v in enumerate(x)]
    schema = "vec_id long, embedding array<double>"
    ask = lambda rows: sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect())
    want = ask(once)
    assert len(want) == 60 and ask(once * 2) == want and ask(once + once[1:2] * 900) == want
    # One id with many different vectors near a query takes one of its ten places.
    near = [(7, (x[0] + 1e-3 * rng.normal(size=8)).tolist()) for _ in range(40)]
    got = [r[2] for r in ask(once + near) if r[0] == 0]
    far = np.sqrt(((x - x[0]) ** 2).sum(1))
    assert got[0] == 7 and len(got) == 10 and got[1:] == [k for k in np.argsort(far) if k not in (0, 7)][:9]


@pytest.mark.parametrize("kind,most", [("even", 0.3), ("clusters", 0.05)])
def test_neighbours_verify_few(kind, most):
    """Recall against brute force in one block, and the share of the block that is verified."""
    rng = np.random.Generator(np.random.PCG64(8))
    x = rng.normal(size=(6_000, 64))
    if kind == "clusters":
        x = rng.normal(size=(100, 64))[rng.integers(0, 100, 6_000)] + 0.3 * x
    block = ann.Block(x, np.arange(len(x)))
    hit = 0
    for q in range(40):
        at, far = block.search(x[q], q, 10)
        exact = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert np.allclose(far, exact[at], atol=1e-12)
        exact[q] = np.inf
        hit += len(set(at.tolist()) & set(np.argsort(exact)[:10].tolist()))
    assert hit >= 0.93 * 400 and block.verified < most * 40 * len(x)


def test_neighbours_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_BLOCK", 100)
    monkeypatch.setattr(ann, "BLOCK_GROWTH", 1)
    rng = np.random.Generator(np.random.PCG64(9))
    x = rng.normal(size=(1_500, 8))
    got = {}
    for r in ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = lambda q: set([k for k in np.argsort(((x - x[q]) ** 2).sum(1)) if k != q][:10])
    assert len(got) == 15 and sum(len(got[q] & exact(q)) for q in got) >= 0.95 * 150


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "mixing", "sentencepiece"]
    from test_text_operators import near_components, without_repeats

    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "12 34", None, "s", 5)], d.schema)
    first = corpus_pipeline.language_id(spark, d.unionByName(odd), SF)
    assert first.columns == d.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in d.collect()}
    second = corpus_pipeline.near_dedup(spark, d, SF)
    texts = {r.doc_id: r.text for r in d.collect()}
    want = near_components(list(texts.items()), 80)
    assert {r.doc_id for r in second.collect()} == {i for i, v in want.items() if v[2]}
    third = {r.doc_id: r for r in corpus_pipeline.suffix_dedup_stage(spark, d, SF).collect()}
    for i, (n, gone, _, digest) in without_repeats(list(texts.items())).items():
        if gone == 0:
            assert third[i].text == texts[i]
        elif i in third:
            assert hashlib.sha256(third[i].text.encode()).hexdigest() == digest or len(third[i].text.encode()) < n - gone
            assert third[i].n_chars == len(third[i].text)
    fourth = corpus_pipeline.mixing_stage(spark, d, SF)
    assert fourth.columns == d.columns and sorted(r.doc_id for r in fourth.collect()) == sorted(r.doc_id for r in mixing.mix(d).collect())
    last = corpus_pipeline.encode(spark, d, SF)
    back = sentencepiece_ops.decode(last, ["doc_id"])
    assert {r.doc_id: r.decoded for r in back.collect()} == texts
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


__all__ = ["Tables", "langid", "minhash", "suffix_dedup"]
