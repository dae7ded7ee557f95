"""Operators on texts against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid, minhash, mixing, quality, sentencepiece_ops, sharding, suffix, suffix_dedup
from larkspur.llm import textnp as X
from larkspur.llm.common import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def corpus(n=60, seed=3):
    """Texts with exact and near copies, shared passages, blank, null and very long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ漢") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [None, "", " \n\t ", "one", "ONE", "two words", "x" * 30_000, " ".join(rng.choice(vocabulary) for _ in range(9_000)), "ab " * 400]
    base = [rng.choice(vocabulary) for _ in range(120)]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.35:
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        elif kind < 0.55:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(20)) + " " + passage + "\n" + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20))))
        elif kind < 0.65:
            texts.append(rng.choice(texts))
        else:
            texts.append("\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))))
    return [(k, t, "en", f"s{k % 3}", 0) for k, t in enumerate(texts)]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in ids}


def without_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_minhash(spark):
    rows = corpus(120)
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(docs(spark, rows), Tables(spark, "t"), percent).collect()}
        assert got == near_components([r[:2] for r in rows], percent)


@pytest.mark.parametrize("few,nodes", [(1, 7), (16, 1024)])
def test_minhash_in_blocks(spark, monkeypatch, few, nodes):
    """A large group of texts near one base, many of them not near each other."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK_NODES", nodes)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(80):
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.random()}"
        rows.append((k, " ".join(w), None, None, None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(docs(spark, rows), Tables(spark, "t"), 85).collect()}
    want = near_components([r[:2] for r in rows], 85)
    assert got == want and len({v[1] for v in want.values()}) > 3


def test_minhash_edges(spark):
    assert minhash.link(docs(spark, []), Tables(spark, "t"), 80).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (2, None, None, None, None), (3, "A b\tC d e f", None, None, None)]
    got = [tuple(r) for r in minhash.link(docs(spark, rows), Tables(spark, "t"), 80).collect()]
    assert collections.Counter(got) == collections.Counter([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False)])


def test_sketch_fills_every_coordinate():
    for n in (1, 2, 5, 200, 3000):
        values = np.sort(X.mix(np.arange(n, dtype=np.uint64)))
        assert (minhash.sketches(values, np.array([0, n])) != minhash._FULL).all()
    a, b = X.mix(np.arange(0, 900, dtype=np.uint64)), X.mix(np.arange(100, 1000, dtype=np.uint64))
    s = minhash.sketches(np.concatenate([a, b]), np.array([0, 900, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.15


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(200):
        k, n = rng.choice([1, 2, 3, 26, 256]), rng.randint(1, 150)
        t = bytes(rng.randrange(k) for _ in range(n)) * rng.choice([1, 1, 3])
        a = np.frombuffer(t, np.uint8)
        sa = suffix.suffix_array(a)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffix.permuted_common_prefixes(a, sa)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist()):
            m = 0
            while i + m < len(t) and j + m < len(t) and t[i + m] == t[j + m]:
                m += 1
            assert shared[i] == m


@pytest.mark.parametrize("crowd,held,shard", [(20_000, 2_000_000, 2 << 20), (1, 4, 2_000)])
def test_suffix_dedup(spark, monkeypatch, crowd, held, shard):
    for name, v in (("CROWD", crowd), ("HELD", held), ("SHARD_BYTES", shard)):
        monkeypatch.setattr(suffix_dedup, name, v)
    rows = corpus(90, 4)
    given = docs(spark, rows).withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(given, Tables(spark, "t"), ["doc_id"], "kept_sha256").collect()}
    assert got == without_repeats([r[:2] for r in rows])
    assert sum(v[1] for v in got.values()) > 5_000


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup(docs(spark, []), Tables(spark, "t")).count() == 0
    long_ = "".join(chr(97 + k % 23) + chr(97 + k * k % 19) for k in range(200))
    rows = [(5, long_, None, None, None), (5, long_, None, None, None), (6, long_, None, None, None), (None, None, None, None, None)]
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed, r.kept_text) for r in suffix_dedup.dedup(docs(spark, rows), Tables(spark, "t"), ["doc_id"], "kept_text").collect())
    own = got[0][2]
    assert [g[2] for g in got] == [own, own, 400, 0] and got[2][3] == "" and got[3][3] == ""


def test_quality_counts(spark):
    rows = corpus(80, 6)
    got = {r.doc_id: r for r in quality.rate(docs(spark, rows), spark.createDataFrame([(k, 1, 0) for k in range(20, 60)], "doc_id long, quality int, toxic int"), Tables(spark, "t")).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(8)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and r.kept == (not r.base_failed and r.score >= r.threshold)


def test_quality_ratio_by_hand(spark):
    rows = [(1, "good text here", "", "", 0), (2, "bad noise there", "", "", 0), (3, "good noise", "", "", 0)]
    trusted = docs(spark, rows).withColumn("trusted", F.col("doc_id") == 1)
    weights = quality.fit(trusted)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t, *_ in rows:
        buffer = np.frombuffer(t.encode(), np.uint8)
        starts, ends, first = X.words(buffer, np.array([0, len(buffer)]))
        single, pair = quality.ngram_buckets(X.span_hashes(buffer, starts, ends), first)
        for b in [*single, *pair[pair >= 0]]:
            raw[b] += 1
            target[b] += i == 1
    want = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(weights, want)
    none = quality.rate(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), Tables(spark, "t"))
    assert all(r.score == 0 and r.base_failed for r in none.collect())
    assert quality.rate(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"), Tables(spark, "t")).count() == 0


def test_language_id_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = langid.fit(d, 800)
    out = langid.identify(d.withColumn("score", F.lit("clash")), network, ["doc_id", "lang", "score"]).withColumn("held_out", langid.held_out()).where("held_out")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97
    odd = langid.identify(docs(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "12 ... 34", None, None, None), (4, "the of and the thing " * 20_000, None, None, None)]), network, ["doc_id"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in odd.collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "en"
    assert langid.fit(docs(spark, [])) is None
    assert langid.identify(docs(spark, [(1, "text", None, None, None)]), None, ["doc_id"]).first()["lang_pred"] == "und"


def test_language_tables_equal_the_network():
    rng = np.random.Generator(np.random.PCG64(2))
    net = langid.Network(["a", "b", "c"])
    windows = rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    tops = np.concatenate([net.responses(windows, w).max(1) for w in langid.WIDTHS], 1)
    want = langid.softmax(np.maximum(tops + net.p["b"], 0) @ net.p["d"] + net.p["c"])
    assert np.allclose(net.distributions(windows, net.tables()), want, atol=1e-5)


def test_pieces_round_trip(spark):
    vocabulary = sentencepiece_ops.vocabulary(sentencepiece_ops.MODEL)
    rng = random.Random(8)
    texts = [None, "", " ", "  two  spaces ", "a▁b", "\n\n", "é日本\x00𝄞 z", "w" * 300 + " q", " " * 500, "the thing, " * 3_000, *thue_morse()]
    texts += ["".join(rng.choice("abc de\n▁é") for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(9_000)), " ".join(thue_morse()), texts[3]]
    given = docs(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]).withColumns({"ids": F.lit("clash"), "decoded": F.lit("clash")})
    coded = sentencepiece_ops.encode(given, ["doc_id", "ids"])
    assert coded.columns == ["doc_id", "ids"]
    back = {r.doc_id: r.decoded for r in sentencepiece_ops.decode(coded.withColumn("decoded", F.lit("clash")), ["doc_id", "decoded"]).collect()}
    assert [back[k] for k in range(len(texts))] == texts
    assert all(r.spells_text or texts[r.doc_id] is None for r in sentencepiece_ops.query(spark, given).collect())
    assert sentencepiece_ops.encode(docs(spark, []), ["doc_id"]).count() == 0 and sentencepiece_ops.decode(coded.limit(0), ["doc_id"]).count() == 0
    assert vocabulary.longest > 8


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_segmentation_is_the_best_of_all(monkeypatch, cells):
    """Against a search over all segmentations, with pieces of equal scores, uncovered characters and, at few cells, parts cut into blocks."""
    monkeypatch.setattr(sentencepiece_ops, "CELLS", cells)
    rng = random.Random(cells)
    for trial in range(60):
        alphabet = rng.choice(["a", "ab", "abé"])
        pieces = sorted({"".join(rng.choice(alphabet + " ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))} - {" "})
        pieces = [x for x in pieces if " " not in x[1:]] or ["a"]
        rng.shuffle(pieces)
        coded = [(256 + k, x.encode()) for k, x in enumerate(pieces)]
        v = sentencepiece_ops.Vocabulary(coded, np.arange(256), 256 + len(pieces))
        if trial % 2:
            v.scores[:] = v.scores[0]  # many ties
        score = {b: (int(s), i) for (i, b), s in zip(coded, v.scores)}
        for _ in range(12):
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))
            raw = word.encode()
            got, _ = sentencepiece_ops.segment(v, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            best = None
            for mask in range(1 << (len(raw) - 1)):
                ends = [k + 1 for k in range(len(raw) - 1) if mask >> k & 1] + [len(raw)]
                total, ids, sizes = 0, [], []
                for x, y in zip([0, *ends], ends):
                    part = raw[x:y]
                    if part in score:
                        total, ids = total + score[part][0], [*ids, score[part][1]]
                    elif len(part) == 1:
                        total, ids = total + (v.uncovered if part[0] & 0xC0 != 0x80 else 0), [*ids, part[0]]
                    else:
                        break
                    sizes.append(y - x)
                else:
                    own = (total, [-n for n in reversed(sizes)], ids)
                    best = max(best, own) if best else own
            assert got.tolist() == best[2], (word, pieces)


def thue_morse():
    """Two words of 1,024 letters that any polynomial hash modulo a power of two confuses."""
    bits = [bin(k).count("1") % 2 for k in range(1_024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    one, two = thue_morse()
    rows = [(1, one, None, None, None), (2, two, None, None, None), (3, one + "\n" + two, None, None, None)]
    got = {r.doc_id: r.component_id for r in minhash.link(docs(spark, rows), Tables(spark, "t"), 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    rated = {r.doc_id: r.n_dup_lines for r in quality.rate(docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"), Tables(spark, "t")).collect()}
    assert rated == {1: 0, 2: 0, 3: 0}


def test_equal_hashes_of_different_bytes(spark, monkeypatch):
    """With a hash that confuses nearly all, bytes still decide: lines, windows and words."""
    real = X.span_hashes
    poor = lambda buffer, starts, ends: real(buffer, starts, ends) % np.uint64(3)
    monkeypatch.setattr(X, "span_hashes", poor)
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 4))) for _ in range(30)) for _ in range(8)]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buffer = np.frombuffer(raw, np.uint8)
    starts, ends, first = X.words(buffer, offsets)
    dup = quality.duplicate_lines(buffer, offsets, starts)
    again = quality.repeated_words(poor(buffer, starts, ends), first, buffer, starts, ends)
    for k, t in enumerate(texts):
        lines = [x for x in t.split("\n") if WORD.search(x)]
        w = WORD.findall(t)
        count = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        assert dup[k] == len(lines) - len(set(lines))
        assert again[k] == len({j + i for j in range(len(w) - 7) if count[tuple(w[j : j + 8])] > 1 for i in range(8)})
    vocabulary = sentencepiece_ops.vocabulary(sentencepiece_ops.MODEL)
    ids, bounds = sentencepiece_ops.encode_texts(vocabulary, buffer, offsets)
    out, at = sentencepiece_ops.decode_ids(vocabulary, ids, bounds)
    assert out.tobytes() == raw and at.tolist() == offsets.tolist()


def test_scores_depend_on_the_text_alone():
    rng = random.Random(2)
    weights = np.random.Generator(np.random.PCG64(1)).normal(size=quality.BUCKETS)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 300))) for _ in range(50)]
    score = lambda rows: [x for b in quality._score(weights)(iter([pa.RecordBatch.from_pylist([{"doc_id": 1, "text": t, "trusted": False} for t in rows])])) for x in b.column("score").to_pylist()]
    assert score(texts) == [score([t])[0] for t in texts]


def test_sharding(spark):
    rows = corpus(200, 5) + [(7, "same", None, None, None)] * 30
    limit = 6_000
    out = sharding.shard(docs(spark, rows).withColumn("shard_page", F.lit("clash")), limit, Tables(spark, "t")).collect()
    assert len(out) == len(rows)
    size = collections.Counter()
    for r in out:
        size[r.shard_depth, r.shard_prefix, r.shard_page] += r.n_bytes
    assert all(v <= limit or k[0] == -1 for k, v in size.items())
    whole = collections.Counter()
    for r in out:
        for depth in range(r.shard_depth):
            whole[depth, r.shard_prefix >> (r.shard_depth - depth)] += r.n_bytes
    assert all(v > limit for v in whole.values())  # only oversized prefixes were split
    assert sum(r.shard_depth == -1 for r in out) == sum(len((t or "").encode()) > limit for _, t, *_ in rows)
    assert sharding.shard(docs(spark, []), limit, Tables(spark, "t")).count() == 0


def test_sharding_of_rows_that_no_bit_parts(spark):
    out = sharding.shard(docs(spark, [(1, "x" * 100, None, None, None)] * 50 + [(2, "y", None, None, None)]), 450, Tables(spark, "t")).collect()
    size = collections.Counter()
    for r in out:
        size[r.shard_depth, r.shard_prefix, r.shard_page] += r.n_bytes
    assert len(out) == 51 and max(size.values()) <= 450


def test_mixing(spark):
    rows = [(k, "t", None, "big" if k % 10 else "small", None) for k in range(3_000)] + [(None, "t", None, None, None)]
    given = docs(spark, rows).withColumn("replica", F.lit("clash"))
    out = mixing.mix(given, {"big": 1, "small": 1}, rows=6_000)
    count = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(count["big"] - 3_000) < 250 and abs(count["small"] - 3_000) < 250 and None not in count
    per = collections.Counter(r["doc_id"] for r in out.where("source = 'small'").collect())
    assert max(per.values()) <= 30 and sorted((r["doc_id"], r["replica"]) for r in out.where("doc_id = 0").collect()) == [(0, k) for k in range(per[0])]
    again = mixing.mix(given, {"big": 1, "small": 1}, rows=6_000)
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in again.collect()]
    assert mixing.mix(docs(spark, [])).count() == 0
    high = mixing.mix(docs(spark, [(1, "t", None, "a", None)]), {"a": 1}, rows=1_000).count()
    assert 950 <= high <= 1_050


def test_mixing_of_high_rates_is_poisson(spark):
    rows = [(k, "t", None, "a", None) for k in range(400)]
    out = mixing.mix(docs(spark, rows), {"a": 1}, rows=400 * 300)
    count = np.array([r["count"] for r in out.groupBy("doc_id").count().collect()])
    assert len(count) == 400 and abs(count.mean() - 300) < 4 and 0.75 < count.var() / 300 < 1.25


def test_whole_rows_are_mixed_and_sharded(spark, monkeypatch):
    given = docs(spark, corpus(120, 5))
    written = []
    cut = Tables.cut
    monkeypatch.setattr(mixing.Tables, "cut", lambda self, df: written.append(cut(self, df)) or written[-1])
    plain = mixing.query(spark, given)
    texts = {r.doc_id: tuple(r) for r in given.collect()}
    mixed = written[0].collect()
    assert len(mixed) == plain.count() > 0 and all(tuple(r)[:5] == texts[r.doc_id] for r in mixed)
    monkeypatch.undo()
    tables = Tables(spark, "t")
    laid = sharding.lay_out(sharding.shard(given, 6_000, tables), f"{tables.root}/rows")
    assert sorted(map(repr, (tuple(r)[:5] for r in laid.collect()))) == sorted(map(repr, texts.values()))
    files = laid.select(*sharding.SHARD, F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == len({tuple(r)[:3] for r in files}) == len({r.file for r in files}) > 3


def test_suffix_dedup_of_a_passage_that_many_share(spark, monkeypatch):
    """Equal windows of a crowded anchor are never held together: one row of bytes for each batch, and no suffix array."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = letters(160)
    rows = [(k, letters(rng.randint(0, 50)) + passage + letters(120)) for k in range(300)]
    batches = [pa.RecordBatch.from_pylist([{"doc": i, "tie": 0, "text": t} for i, t in rows[k : k + 100]]) for k in (0, 100, 200)]
    met = pa.Table.from_batches(suffix_dedup.meet(pa.Table.from_batches(suffix_dedup.scan(batches)).sort_by([(c, "ascending") for c in ("anchor", "whole", "doc", "tie", "start")]).combine_chunks().to_batches(500))).to_pylist()
    wanted = collections.defaultdict(list)
    for r in met:
        if r["classes"]:
            wanted[r["doc"]].append({k: r[k] for k in ("anchor", "start", "count", "classes")})
    cut = pa.Table.from_batches([x for k in (0, 100, 200) for x in suffix_dedup.cutter()([pa.RecordBatch.from_pylist([{"doc": i, "tie": 0, "text": t, "wanted": wanted[i]} for i, t in rows[k : k + 100] if i in wanted])])])
    rows_with_bytes = collections.Counter(r["bytes"] for r in cut.to_pylist() if r["bytes"])
    assert len(rows_with_bytes) > 300 and max(rows_with_bytes.values()) <= 3
    monkeypatch.setattr(suffix_dedup, "repeats_in", lambda *_: pytest.fail("a suffix array of equal windows"))
    order = [(c, "ascending") for c in ("kind", "shard", "doc", "tie", "start")]
    runs = pa.Table.from_batches(suffix_dedup.compare(cut.sort_by(order).combine_chunks().to_batches(50))).to_pylist()
    runs += [r for r in met if not r["classes"]]
    gone = {(r["doc"], s) for r in runs for s in range(r["start"], r["start"] + r["count"])}
    seen, want = set(), set()
    for i, t in rows:
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                want.add((i, s))
            seen.add(t[s : s + 100])
    assert gone == want and len(want) >= 61 * 299


def test_windows_of_one_hash_and_different_bytes():
    earliest = suffix_dedup.Earliest()
    a, b = np.full(100, 97, np.uint8), np.full(100, 98, np.uint8)
    ask = lambda *rows: (rows := [(*r, 0) for r in rows]) and earliest.later(*(np.array([r[k] for r in rows]) for k in (0, 1, 4, 2)), np.stack([r[3] for r in rows])).tolist()
    assert ask((1, 1, 0, a), (1, 1, 5, b), (1, 2, 0, a), (2, 1, 7, a), (2, 1, 7, a)) == [False, False, True, False, False]
    assert ask((2, 3, 0, a), (2, 3, 1, b), (2, 4, 1, b), (3, 0, 0, b)) == [True, False, True, False]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_suffix_dedup_of_rows_of_one_id_or_none(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, other = letters(100), letters(130)
    texts = [(None, letters(100) + passage + letters(100)), (None, letters(700) + passage + letters(200)), (None, None), (None, letters(50)), (5, other + letters(170)), (5, letters(600) + other), (6, letters(300) + passage + other)]
    rows = [(i, t, None, None, None) for i, t in texts]
    got = sorted((len(r.kept_bytes), bytes(r.kept_bytes), r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(docs(spark, rows), Tables(spark, "t"), ["doc_id"]).collect())
    hashes = [r[0] for r in docs(spark, rows).select(F.xxhash64("text")).collect()]
    place = sorted(range(len(rows)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0, hashes[k]))
    want = without_repeats([(n, texts[k][1]) for n, k in enumerate(place)])
    assert sorted((a, hashlib.sha256(b).hexdigest(), n, gone) for a, b, n, gone in got) == sorted((n - gone, digest, n, gone) for n, gone, _, digest in want.values())
    assert sum(g[3] for g in got) == 100 + 130 + 230


def test_language_sample_is_even(spark):
    rows = [(k, f"text number {k} of many", "a" if k % 60 else "rare", None, None) for k in range(1, 24_000)]
    rows += [(30_000 + k, f"text number {k} of some", f"l{k % 10}", None, None) for k in range(20_000)]
    given = docs(spark, rows)
    _, labels, langs = langid.sample(given, 2_400)
    count = dict(zip(langs, np.bincount(labels).tolist()))
    have = {r.lang: r["count"] for r in given.where(~langid.held_out()).groupBy("lang").count().collect()}
    assert len(count) == 12 and len(labels) <= 2_400
    assert have["rare"] > 200 and all(170 <= count[k] <= 200 for k in count), count
