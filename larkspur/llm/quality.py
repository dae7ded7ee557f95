"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio with a fixed threshold.

Words and pairs of adjoining words are hashed to BUCKETS buckets. Two multinomials are counted over all documents: one of the
trusted target (documents labelled quality 1), one of the raw corpus. A document's score is the mean, over its n-grams,
of the log ratio of the two smoothed probabilities. The threshold is the score under which TAIL of the trusted
documents lie, read off a histogram of all of their scores; a document is kept if it scores that or more.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .common import Tables

BUCKETS = 1 << 14
SMOOTH = 1.0
TAIL = 0.005
#: Scores are compared in steps of this, so that the histogram has a bounded number of rows.
STEP = 1 / 1024
#: Ids of at most so many trusted documents (under 100 MB as a hash table) are broadcast; more are joined by shuffle, with ids and scores only but for the trusted texts.
BROADCAST_LABELS = 500_000
WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_LEAD_IN_WORD = X.IS_LEAD & X.IS_WORD


def ngram_buckets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of the pairs that begin at each word (-1 at a text's last word)."""
    single = (X.mix(hashes ^ X.SEEDS[0]) % np.uint64(BUCKETS)).astype(np.int64)
    pair = np.full(len(hashes), -1, np.int64)
    if len(hashes) > 1:
        joined = X.mix(hashes[:-1] * X.MULTIPLIERS[0] + hashes[1:] * X.MULTIPLIERS[1]) % np.uint64(BUCKETS)
        pair[:-1] = joined
        last = first[1:] - 1
        pair[last[last >= 0]] = -1
    return single, pair


def repeated_words(hashes: np.ndarray, first: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By row, the words in WINDOW-word windows that the text holds more than once."""
    rows = X.rows_of(first)
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return np.zeros(len(first) - 1, np.int64)
    key = rows[:n].astype(np.uint64) * X.MULTIPLIERS[20]
    for k in range(WINDOW):
        key += hashes[k : k + n] * X.MULTIPLIERS[k]
    key = X.mix(key)
    whole = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    order = whole[np.argsort(key[whole], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    again = np.flatnonzero(~new)
    if not len(again):
        return np.zeros(len(first) - 1, np.int64)
    at, of = order[again], order[head[again]]
    sizes = ends - starts
    same = rows[at] == rows[of]
    for k in range(WINDOW):
        same &= sizes[at + k] == sizes[of + k]
        same[same] = X.equal_spans(buffer, starts[at[same] + k], starts[of[same] + k], sizes[at[same] + k])
    at = np.union1d(at[same], of[same])
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out = X.per_row(np.int64, np.cumsum(cover)[:-1] > 0, first)
    for row in np.unique(rows[order[again[~same]]]):  # different windows of one hash: counted word by word
        own = [buffer[a:b].tobytes() for a, b in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]], strict=True)]
        windows = [tuple(own[k : k + WINDOW]) for k in range(len(own) - WINDOW + 1)]
        times = collections.Counter(windows)
        out[row] = len({k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(WINDOW)})
    return out


def duplicate_lines(buffer: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """By row, the lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(buffer == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(buffer)]
    ends = np.append(starts[1:], len(buffer))
    with_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[with_word], ends[with_word]
    ends = ends - (buffer[ends - 1] == 10)
    rows = np.searchsorted(offsets, starts, "right") - 1
    hashes = X.span_hashes(buffer, starts, ends)
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    again = np.flatnonzero(~new)
    if not len(again):
        return np.zeros(len(offsets) - 1, np.int64)
    at, of = order[again], order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))[again]]
    same = (ends - starts)[at] == (ends - starts)[of]
    same[same] = X.equal_spans(buffer, starts[at[same]], starts[of[same]], (ends - starts)[at[same]])
    out = np.bincount(rows[at], minlength=len(offsets) - 1)
    for row in np.unique(rows[at[~same]]):  # different lines of one hash: compared as such
        own = [buffer[a:b].tobytes() for a, b in zip(starts[rows == row], ends[rows == row], strict=True)]
        out[row] = len(own) - len(set(own))
    return out


def _slices(batch: pa.RecordBatch):
    for row, end, buffer, offsets in X.slices(*X.text_bytes(batch.column("text"))):
        starts, ends, first = X.words(buffer, offsets)
        yield row, end, buffer, offsets, starts, ends, first, X.span_hashes(buffer, starts, ends)


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = np.asarray(batch.column("trusted").to_numpy(zero_copy_only=False), bool)
        for row, end, _, _, _, _, first, hashes in _slices(batch):
            single, pair = ngram_buckets(hashes, first)
            own = trusted[row:end][X.rows_of(first)]
            for grams in (single, pair):
                raw += np.bincount(grams[grams >= 0], minlength=BUCKETS)
                target += np.bincount(grams[(grams >= 0) & own], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])


def _score(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            got = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")}
            for _, _, buffer, offsets, starts, ends, first, hashes in _slices(batch):
                single, pair = ngram_buckets(hashes, first)
                n = np.diff(first)
                grams = n + np.maximum(n - 1, 0)
                total = X.per_row(np.float64, weights[single] + np.where(pair >= 0, weights[pair], 0.0), first)
                got["n_words"].append(n)
                got["word_chars"].append(X.per_row(np.int64, _LEAD_IN_WORD[buffer], offsets))
                got["n_symbols"].append(X.per_row(np.int64, SYMBOLS[buffer], offsets))
                got["n_dup_lines"].append(duplicate_lines(buffer, offsets, starts))
                got["n_repeat_words"].append(repeated_words(hashes, first, buffer, starts, ends))
                got["score"].append(np.round(total / np.maximum(grams, 1) / STEP) * STEP)
            columns = [pa.array(np.concatenate(v).astype(np.float64 if k == "score" else np.int64)) if v else pa.array([], pa.float64() if k == "score" else pa.int64()) for k, v in got.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *got])

    return run


def trusted_ids(labels: DataFrame) -> tuple[DataFrame, bool]:
    """(good) the ids of documents that some label gives quality 1, without null ids, and whether they are few enough to be broadcast."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__lk_good")).distinct()
    few = good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return (F.broadcast(good) if few else good), few


def with_trust(docs: DataFrame, good: DataFrame) -> DataFrame:
    """docs plus trusted boolean (false for a null id), a row for each row; repeated rows are trusted each. Columns named trusted are replaced."""
    return docs.drop("trusted").join(good, docs["doc_id"] == good["__lk_good"], "left").withColumn("trusted", F.col("__lk_good").isNotNull()).drop("__lk_good")


def fit(trusted: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from counts over all rows of (text, trusted). What reaches the driver is BUCKETS rows.

    Null and empty texts count nothing, repeated rows count each; without rows, or without trusted ones, all ratios are 0.
    """
    return ratios(_counts(trusted))


def _counts(trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counts = trusted.select("text", "trusted").mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def ratios(counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    raw, target = counts
    if not target.sum():
        return np.zeros(BUCKETS)
    log = lambda n: np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))
    return log(target) - log(raw)


def rate(docs: DataFrame, labels: DataFrame, tables: Tables, tail: float = TAIL) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score, threshold).

    Null and empty texts have no words, so they fail the base rules; long texts are read whole. Repeated rows are rated each, and equal texts alike.
    A score equal to the threshold is kept. Rows with a null doc_id are never trusted. Without trusted
    documents all scores are 0 and the base rules alone decide. No rows in, no rows out. Other columns of docs
    are not read.
    """
    docs = docs.select("doc_id", "text")
    good, few = trusted_ids(labels)
    if few:
        weights = fit(with_trust(docs, good))
    else:
        raw, _ = _counts(docs.withColumn("trusted", F.lit(False)))
        _, target = _counts(docs.join(good, docs["doc_id"] == good["__lk_good"], "left_semi").withColumn("trusted", F.lit(True)))
        weights = ratios((raw, target))
    scored = tables.cut(docs.mapInArrow(_score(weights), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    passed = scored.where(~failed).select("doc_id", "score")
    histogram = sorted(passed.join(good, passed["doc_id"] == good["__lk_good"], "left_semi").groupBy("score").count().collect())
    allowed, threshold = tail * sum(r["count"] for r in histogram), float("-inf")
    for r in histogram:
        allowed -= r["count"]
        if allowed < 0:
            threshold = r["score"]
            break
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(threshold))).withColumn("threshold", F.lit(threshold))


def query(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return rate(docs, labels, Tables(spark, "quality")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")


def base_counts(docs: DataFrame, tables: Tables) -> DataFrame:
    """The columns of `rate` that depend on the text alone: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    none = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    return rate(docs, none, tables).drop("kept", "score", "threshold")


BASE_ORACLE = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM given),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM given) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS k FROM words)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, sum(least(8, coalesce(next - k, 8))) AS n FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM twice) GROUP BY doc_id),
counted AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM words w LEFT JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted"""
