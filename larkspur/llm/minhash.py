"""Near-duplicate detection: fast similarity sketches, banding, and exact verification on the full shingle sets.

Sketch. A set's elements are thrown into COORDINATES bins in rounds. In round i < COORDINATES every element gets a hashed bin and a hashed
value, in round COORDINATES + b all elements go to bin b; a bin keeps the least (round, value) it saw. Rounds end for a set once all of its
bins are filled, so every coordinate is filled after at most twice as many rounds as there are bins, usually two or three.

Links. Documents of equal words are one node (by a cryptographic hash of the words). Nodes that agree on all coordinates of a band share a bucket. In a bucket the
smallest node is compared with all others, by their full sets, and components are formed. Where a bucket then holds several
components, the nodes outside its largest one are compared with all of its nodes: in a bucket of at most FEW nodes as pairs, in a larger one in
blocks, where a product of incidence matrices counts the shared shingles of all pairs of two blocks and only links that join
components are given out. So no large bucket is expanded into pairs, yet any two nodes that shared a bucket are compared
or already connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .common import Tables
from .components import components

SHINGLE = 5
COORDINATES = 128
#: Pairs of one centre that one group of a task handles.
PAIRS_A_GROUP = 256
#: Centres with more pairs (16 bytes each) are broadcast up to so many, so that a frequent centre's pairs are dealt without meeting first.
BROADCAST_HOT = 500_000
#: Nodes of a bucket whose pairs may be rows; nodes and shingles of a block, about; columns of a matrix product.
FEW = 16
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1_000_000
COLUMNS = 4096
_FULL = np.uint64(2**64 - 1)


def band_rows(percent: int, miss: float = 1e-6) -> int:
    """The most coordinates a band may have so that a pair at the threshold shares no bucket with a probability under `miss`."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (COORDINATES // r) < miss]
    return max(fits, default=1)


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, ascending within the row, and the index of each row's first."""
    lowered = X.LOWER[buffer]
    starts, ends, first = X.words(lowered, offsets)
    hashes = X.span_hashes(lowered, starts, ends)
    rows = X.rows_of(first)
    n = np.diff(first)
    parts, owners = [], []
    m = len(hashes) - SHINGLE + 1
    if m > 0:
        whole = rows[:m] == rows[SHINGLE - 1 :]
        key = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            key += hashes[k : k + m] * X.MULTIPLIERS[k]
        parts.append(X.mix(key[whole]))
        owners.append(rows[:m][whole])
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        key = X.SEEDS[n[few]].copy()
        for k in range(SHINGLE - 1):
            has = n[few] > k
            key[has] += hashes[first[few][has] + k] * X.MULTIPLIERS[k]
        parts.append(X.mix(key))
        owners.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    values, owner = np.concatenate(parts), np.concatenate(owners)
    if len(few) and m > 0:
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def exact_set(text: bytes) -> frozenset:
    """The shingles themselves."""
    w = text.lower().split()
    return frozenset(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else frozenset([tuple(w)] if w else [])


def reach(a: frozenset, b: frozenset, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def digests(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 2) halves of a cryptographic hash of each row's lowered words in order."""
    raw = buffer.tobytes()
    found = [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, COORDINATES) of (round << 32 | value); rows without elements keep all bits set."""
    t = COORDINATES
    rows = len(bounds) - 1
    table = np.full(rows * t, _FULL)
    owner = X.rows_of(bounds)
    for i in range(2 * t):
        if not len(values):
            break
        h = X.mix(values ^ X.SEEDS[100 + i])
        bins = ((h >> np.uint64(40)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(table, owner * t + bins, (h & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        open_ = (table.reshape(rows, t) == _FULL).any(1)
        left = open_[owner]
        values, owner = values[left], owner[left]
    return table.reshape(rows, t)


def band_keys(table: np.ndarray, rows: int) -> np.ndarray:
    bands = COORDINATES // rows
    out = np.empty((len(table), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(table), X.SEEDS[400 + b])
        for k in range(rows):
            key += table[:, b * rows + k] * X.MULTIPLIERS[k]
        out[:, b] = X.mix(key)
    return out


def sketcher(rows: int):
    bands = COORDINATES // rows

    def run(batches):
        for batch in batches:
            size, halves, keys = [], [], []
            for _, _, buffer, offsets in X.slices(*X.text_bytes(batch.column("text"))):
                values, bounds = shingle_sets(buffer, offsets)
                size.append(np.diff(bounds))
                halves.append(digests(buffer, offsets))
                keys.append(band_keys(sketches(values, bounds), rows))
            if not size:
                continue
            size, keys, halves = np.concatenate(size).astype(np.int64), np.concatenate(keys), np.concatenate(halves)
            flat = pa.array(X.as_long(np.ascontiguousarray(keys)).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), lists], ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return run


def verifier(percent: int):
    """Pairs that reach the threshold, from rows in the order (u, salt, kind): a centre (kind 0), then those to compare with it. Hashes refuse, the shingles themselves confirm."""

    def run(batches):
        group, centres = None, []
        for batch in batches:
            u, salt, kind, node = (batch.column(c).to_numpy() for c in ("u", "salt", "kind", "node"))
            found = []
            for row, _, buffer, offsets in X.slices(*X.text_bytes(batch.column("text"))):
                values, bounds = shingle_sets(buffer, offsets)
                for k in range(len(bounds) - 1):
                    own = values[bounds[k] : bounds[k + 1]]
                    at = row + k
                    if group != (u[at], salt[at]):
                        group, centres = (u[at], salt[at]), []
                    text = buffer[offsets[k] : offsets[k + 1]]
                    if kind[at] == 0:
                        centres.append((own.copy(), text.tobytes(), []))
                        continue
                    for centre, centre_text, centre_set in centres:
                        if 100 * min(len(own), len(centre)) < percent * max(len(own), len(centre)) or not len(centre):
                            continue
                        place = np.searchsorted(centre, own)
                        place[place == len(centre)] = 0
                        both = int((centre[place] == own).sum())
                        if 100 * both < percent * (len(own) + len(centre) - both):
                            continue
                        if not centre_set:
                            centre_set.append(exact_set(centre_text))
                        if reach(exact_set(text.tobytes()), centre_set[0], percent):
                            found.append((int(u[at]), int(node[at])))
                            break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets reach the threshold. A centre with many partners is spread over several groups."""
    hot = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_GROUP).alias("salts")).where("salts > 1").withColumnRenamed("u", "hot")
    few = hot.limit(BROADCAST_HOT + 1).count() <= BROADCAST_HOT
    salted = pairs.join(F.broadcast(hot) if few else hot, F.col("u") == F.col("hot"), "left").select("u", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).alias("salt"), "v")
    wanted = salted.select("u", "salt", F.lit(1).alias("kind"), F.col("v").alias("node")).unionByName(salted.select("u", "salt").distinct().select("u", "salt", F.lit(0).alias("kind"), F.col("u").alias("node")))
    rows = wanted.join(texts, F.col("node") == F.col("doc_id")).select("u", "salt", "kind", "node", "text")
    return rows.repartition("u", "salt").sortWithinPartitions("u", "salt", "kind").mapInArrow(verifier(percent), "u long, v long")


def near(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def link(docs: DataFrame, tables: Tables, percent: int = 80) -> DataFrame:
    """docs: doc_id long, text -> (doc_id, n_shingles, component_id, kept), a row for each row.

    Documents are linked if 100 * intersection >= percent * union of their sets of SHINGLE-word shingles (A-Z lowered; a text
    of fewer words is one shingle; null, empty and blank texts have none and are linked with nothing). component_id is
    the smallest doc_id reachable, kept says that it is the row's own. Rows whose doc_id is null have a null component and are kept.
    Rows that repeat a doc_id are one document, ties go to the smaller doc_id, and long texts are read whole. No rows in, no rows out. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = band_rows(percent)
    sketched = tables.cut(docs.mapInArrow(sketcher(rows), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"))
    in_play = sketched.where("n_shingles > 0 and doc_id is not null")
    nodes = tables.cut(in_play.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    bands = nodes.select("node", "n", F.explode("bands").alias("key"))
    nodes = nodes.select("h1", "h2", "node")
    shared = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("k"), F.col("c.node").alias("u"), F.col("c.n").alias("m"))
    buckets = tables.cut(bands.join(shared, F.col("key") == F.col("k")).where(F.col("node") != F.col("u")).select("key", "node", "n", "u", "m"))
    labels = None
    if not buckets.isEmpty():
        texts = docs.join(buckets.select("node").unionByName(buckets.select(F.col("u").alias("node"))).distinct(), F.col("doc_id") == F.col("node"), "left_semi")
        texts = tables.cut(texts)
        pairs = tables.cut(buckets.where(near("n", "m", percent)).select("u", F.col("node").alias("v")).distinct())
        labels = _connect(buckets.select("key", "node", "n"), texts, pairs, percent, tables)
    classes = nodes.withColumn("component", F.col("node"))
    if labels is not None:
        classes = nodes.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").withColumn("component", F.coalesce("label", "node"))
    classes = classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component")
    out = sketched.select("doc_id", "n_shingles", "h1", "h2").join(classes, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _connect(left: DataFrame, texts: DataFrame, pairs: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(node, label). left: the nodes of each bucket that are still to be compared with each other; pairs: those to compare first."""
    labels = components(verified(pairs, texts, percent), tables)
    named = left.join(labels.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("c").alias("size"), F.sum("s").alias("total"), F.max(F.struct("c", "s", "label")).alias("m")).where("labels > 1")
    blocks = lambda c, s: F.greatest(F.ceil(c / BLOCK_NODES), F.ceil(s / BLOCK_SHINGLES))
    mixed = mixed.select(F.col("key").alias("k"), "size", F.col("m.label").alias("main"), blocks(F.col("size") - F.col("m.c"), F.col("total") - F.col("m.s")).alias("minor"), blocks(F.col("size"), F.col("total")).alias("whole"))
    left = tables.cut(named.join(mixed, F.col("key") == F.col("k")).drop("k"))
    few = left.where(F.col("size") <= FEW)
    other = few.select(F.col("key").alias("k"), F.col("node").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"))
    fresh = few.join(other, (F.col("key") == F.col("k")) & (F.col("node") < F.col("x")) & (F.col("label") != F.col("xl")) & near("n", "xn", percent)).select(F.col("node").alias("u"), F.col("x").alias("v")).distinct()
    fresh = tables.cut(fresh.join(pairs.select(F.col("u").alias("tu"), F.col("v").alias("tv")), (F.col("u") == F.col("tu")) & (F.col("v") == F.col("tv")), "left_anti"))
    more = tables.cut(verified(fresh, texts, percent).unionByName(_in_blocks(left.where(F.col("size") > FEW), texts, percent)))
    return labels if more.isEmpty() else components(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more), tables)


def _in_blocks(crowds: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components of each bucket: every block of nodes outside the main component meets every block of the bucket."""
    place = lambda n: F.pmod(F.xxhash64(F.lit("block"), "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    minor = crowds.where("label <> main").select("key", place("minor").alias("a"), every("whole").alias("b"), F.lit(0).alias("side"), "node", "label")
    whole = crowds.select("key", every("minor").alias("a"), place("whole").alias("b"), F.lit(1).alias("side"), "node", "label")
    rows = minor.unionByName(whole).join(texts, F.col("node") == F.col("doc_id")).select("key", "a", "b", "side", "label", "text")
    return rows.groupBy("key", "a", "b").applyInArrow(block_links(percent), "u long, v long")


def block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        side, label = np.asarray(table.column("side")), np.asarray(table.column("label"))
        column = table.column("text").combine_chunks()
        values, bounds = shingle_sets(*_rebased(column))
        size = np.diff(bounds)
        owner = X.rows_of(bounds)
        _, token = np.unique(values, return_inverse=True)
        first = side[owner] == 0
        both = np.intersect1d(token[first], token[~first])
        new = np.full(token.max() + 1 if len(token) else 0, -1)
        new[both] = np.arange(len(both))
        token = new[token]
        owner, token = owner[token >= 0], token[token >= 0]
        rows = [np.flatnonzero(side == s) for s in (0, 1)]
        place = np.empty(len(side), np.int64)
        for r in rows:
            place[r] = np.arange(len(r))
        shared = np.zeros((len(rows[0]), len(rows[1])), np.float32)
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        for at in range(0, len(both), COLUMNS):
            a, b = np.searchsorted(token, (at, at + COLUMNS))
            parts = []
            for s in (0, 1):
                m = np.zeros((len(rows[s]), min(COLUMNS, len(both) - at)), np.float32)
                own = side[owner[a:b]] == s
                m[place[owner[a:b][own]], token[a:b][own] - at] = 1
                parts.append(m)
            shared += parts[0] @ parts[1].T
        shared = shared.astype(np.int64)
        union = size[rows[0]][:, None] + size[rows[1]][None] - shared
        i, j = np.nonzero((100 * shared >= percent * union) & (label[rows[0]][:, None] != label[rows[1]][None]))
        parent: dict[int, int] = {}
        sets: dict[int, frozenset] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        def set_of(row: int) -> frozenset:
            if row not in sets:
                sets[row] = exact_set((column[row].as_py() or "").encode())
            return sets[row]

        kept = []
        for x, y in zip(rows[0][i].tolist(), rows[1][j].tolist(), strict=True):
            a, b = top(int(label[x])), top(int(label[y]))
            if a != b and reach(set_of(x), set_of(y), percent):
                parent[max(a, b)] = min(a, b)
                kept.append((min(int(label[x]), int(label[y])), max(int(label[x]), int(label[y]))))
        return pa.table({"u": pa.array([u for u, _ in kept], pa.int64()), "v": pa.array([v for _, v in kept], pa.int64())})

    return run


def _rebased(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buffer, offsets = X.text_bytes(column)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def query(spark, docs: DataFrame) -> DataFrame:
    return link(docs, Tables(spark, "minhash"), 85)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS k FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least_ AS (SELECT x, min(y) AS m FROM reached GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ l ON l.x = d.doc_id"""
