"""Suffix-array dedup: removal of every byte that a LENGTH-byte string covers which also starts earlier.

Where a string starts is (doc_id, hash of the text, byte), so that rows of one doc_id or none but different texts are documents of
their own, called (doc, tie) below; matches never cross documents. Three steps:

1. Every start of LENGTH bytes belongs to the anchor of its window: the GRAM-byte string in it of the least hash, the leftmost of
   equal ones. Equal windows have equal anchors at equal places, so starts that can match meet if they are grouped by anchor. The
   consecutive starts of an anchor are one snippet (on average LENGTH + 27 bytes); only hashes of snippets are shuffled.
   A snippet that equals an earlier one whole is a repeat at all of its starts.
2. Anchors with different snippets need exact comparison: their distinct snippets are dealt to shards by anchor. A shard
   gets a suffix array by induced sorting and permuted common prefixes; neighbours that share LENGTH bytes are a
   class, and all starts of a class but the earliest are repeats. An anchor of more than CROWD distinct snippets is dealt
   start by start, by the hash of the window: of equal windows that a task reads together only the earliest goes on, and those
   are read in order, so that nothing but the earliest of the window at hand is held, however many documents share it.
3. The repeats of a document are united and cut out of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .common import Tables
from .suffix import permuted_common_prefixes, suffix_array

LENGTH = 100
GRAM = 44
#: Bytes of snippets that one suffix array is built for (a whole anchor at least), and distinct snippets of an anchor beyond which it is dealt by window.
SHARD_BYTES = 2 << 20
CROWD = 20_000
#: Starts of crowded anchors of which equal windows are looked for at once.
WINDOWS = 500_000
#: Rows of one anchor that are held at once.
HELD = 2_000_000
_SPAN = LENGTH - GRAM + 1
_PIECE = 20_000
#: Rows with a null doc_id come first.
NULL_ID = -(2**63)


def snippets(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start in the row, starts, anchor hash, snippet hash) of all snippets, in order."""
    n = len(buffer)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < LENGTH:
        return none
    prefix = X.prefix_hashes(buffer)
    hashes = X.window_hashes(prefix, GRAM)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= _SPAN:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < _SPAN:
        more = _SPAN - width
        key = np.minimum(key[: len(key) - more], key[more:])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    long_ = np.flatnonzero(np.diff(offsets) >= LENGTH)
    inside[offsets[:-1][long_]] += 1
    inside[offsets[1:][long_] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside)[: len(place)])
    if not len(starts):
        return none
    at = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    rows = np.searchsorted(offsets, starts, "right") - 1
    new[1:] |= rows[1:] != rows[:-1]
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(starts)))
    first = starts[head]
    whole = np.concatenate([X.span_hashes(buffer, first[k : k + _PIECE], (first + count)[k : k + _PIECE] + LENGTH - 1) for k in range(0, len(first), _PIECE)])
    return rows[head], first - offsets[rows[head]], count, hashes[at[head]], whole


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").to_numpy().astype(np.int64), batch.column("tie").to_numpy()


def place_hash(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    return X.mix(doc.view(np.uint64) * X.MULTIPLIERS[0] + tie.view(np.uint64) * X.MULTIPLIERS[1] + start.astype(np.uint64))


def scan(batches):
    """Snippet rows. Of equal snippets of a batch only the first goes on as open; the others are repeats already."""
    for batch in batches:
        ids, ties = ids_of(batch)
        got = [(ids[row + r], ties[row + r], a, c, anchor, whole) for row, _, buffer, offsets in X.slices(*X.text_bytes(batch.column("text"))) for r, a, c, anchor, whole in [snippets(buffer, offsets)]]
        if not got:
            continue
        doc, tie, a, c, anchor, whole = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(doc):
            continue
        both = whole ^ X.mix(anchor)
        order = np.lexsort((a, tie, doc, both))
        new = np.ones(len(doc), bool)
        new[1:] = both[order][1:] != both[order][:-1]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        open_ = np.empty(len(doc), bool)
        open_[order] = (doc[order] == doc[head]) & (tie[order] == tie[head]) & (a[order] == a[head])
        # A repeat needs no comparison: it is dealt by a hash of its place, so that frequent anchors don't meet in one task.
        anchor = np.where(open_, anchor, place_hash(doc, tie, a))
        arrays = [pa.array(X.as_long(anchor)), pa.array(X.as_long(whole)), pa.array(doc), pa.array(tie), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int16)), pa.array(open_)]
        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "whole", "doc", "tie", "start", "count", "open"])


def meet(batches):
    """From snippets in the order (anchor, whole, doc, tie, start): the repeats, and of each anchor with several distinct snippets the first of each.

    classes is 0 for a repeat, else the number of distinct snippets of the anchor. An anchor of more than HELD rows is not held
    until it ends: what was read of it is given out as crowded, and the first row of its last snippet stays for those that follow.
    """
    names = ["anchor", "whole", "doc", "tie", "start", "count", "open"]
    join = lambda rows: [np.concatenate([x[k] for x in rows]) for k in range(len(names))]

    def settle(rows: list[np.ndarray], crowded: bool = False):
        anchor, whole, doc, tie, start, count, open_ = rows
        fresh, edge = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        edge[1:] = anchor[1:] != anchor[:-1]
        fresh[1:] = edge[1:] | (whole[1:] != whole[:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(anchor)), 0))
        later = (doc != doc[head]) | (tie != tie[head]) | (start != start[head]) | ~open_
        of = np.cumsum(edge) - 1
        classes = np.bincount(of, fresh & open_)[of].astype(np.int64)
        keep = later | (fresh & (classes > 1))
        classes = np.where(later, 0, CROWD + 1 if crowded else classes)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, doc, tie, start, count, classes)], ["anchor", "doc", "tie", "start", "count", "classes"])

    held: list = []
    size, spilling = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held and rows[0][-1] != held[0][0][0]:
            rows = join([*held, rows])
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if spilling:
                first = int(np.searchsorted(rows[0], rows[0][0], "right"))
                yield settle([x[:first] for x in rows], True)
                if cut > first:
                    yield settle([x[first:cut] for x in rows])
            else:
                yield settle([x[:cut] for x in rows])
            held, size, spilling = [[x[cut:] for x in rows]], len(rows[0]) - cut, False
            continue
        if not held:
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield settle([x[:cut] for x in rows])
            rows = [x[cut:] for x in rows]
        held.append(rows)
        size += len(rows[0])
        if size > HELD:
            rows = join(held)
            yield settle(rows, True)
            first = int(np.searchsorted(rows[1], rows[1][-1]))
            held, size, spilling = [[x[first : first + 1] for x in rows]], 1, True
    if held:
        yield settle(join(held), spilling)


SNIPPET, WINDOW, REPEAT = 0, 1, 2


def runs_of(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tie, first start, count) of the runs of consecutive starts."""
    order = np.lexsort((start, tie, doc))
    d, t, s = doc[order], tie[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(d))[: len(head)] - 1
    return d[head], t[head], s[head], s[last] - s[head] + 1


def distinct_windows(buffer: np.ndarray, first: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, which are the earliest of their bytes here, which are repeats of those). Bytes are compared, not only hashes."""
    view = np.lib.stride_tricks.sliding_window_view(buffer, LENGTH)
    weights = X.powers(X.BASE, LENGTH)[:LENGTH]
    pieces = range(0, len(first), _PIECE)
    hashes = np.concatenate([X.mix((X.BYTE_VALUES[view[first[at : at + _PIECE]]] * weights).sum(1, dtype=np.uint64)) for at in pieces])
    order = np.lexsort((start, tie, doc, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = np.concatenate([(view[first[order[at : at + _PIECE]]] == view[first[head[at : at + _PIECE]]]).all(1) for at in pieces])
    open_, later = np.empty(len(order), bool), np.empty(len(order), bool)
    open_[order] = new | ~same
    later[order] = same & ((doc[order] != doc[head]) | (tie[order] != tie[head]) | (start[order] != start[head]))
    return hashes, open_, later


def cutter():
    """The bytes asked for: rows (kind, shard, doc, tie, start, count, bytes). Starts of crowded anchors are windows of their own, or repeats already (without bytes)."""

    def rows_of(kind, shard, doc, tie, start, count, pieces):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind, np.int8)), pa.array(shard), pa.array(doc), pa.array(tie), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pieces],
            ["kind", "shard", "doc", "tie", "start", "count", "bytes"],
        )

    def pieces_of(kind, buffer, shard, doc, tie, start, count, first):
        size = count + LENGTH - 1
        for at in range(0, len(doc), _PIECE):
            part = slice(at, at + _PIECE)
            ends = np.concatenate([[0], np.cumsum(size[part])])
            take = np.arange(ends[-1]) + np.repeat(first[part] - ends[:-1], size[part])
            pieces = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(buffer[take].tobytes())])
            yield rows_of(kind, shard[part], doc[part], tie[part], start[part], count[part], pieces)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ties = ids_of(batch)
            buffer, offsets = X.text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.asarray(wanted.value_lengths().fill_null(0)))
            anchor, start, count, classes = (flat.field(k).to_numpy() for k in ("anchor", "start", "count", "classes"))
            start, count = start.astype(np.int64), count.astype(np.int64)
            crowded = classes > CROWD
            few = ~crowded
            yield from pieces_of(SNIPPET, buffer, anchor[few], ids[row[few]], ties[row[few]], start[few], count[few], offsets[row[few]] + start[few])
            row, start, count = row[crowded], start[crowded], count[crowded]
            turn = np.cumsum(count) // WINDOWS
            for k in np.unique(turn):
                here = turn == k
                each = count[here]
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                r, s = np.repeat(row[here], each), np.repeat(start[here], each) + place
                doc, tie, first = ids[r], ties[r], offsets[r] + s
                hashes, open_, later = distinct_windows(buffer, first, doc, tie, s)
                yield from pieces_of(WINDOW, buffer, X.as_long(hashes[open_]), doc[open_], tie[open_], s[open_], np.ones(int(open_.sum()), np.int64), first[open_])
                d, t, s, c = runs_of(doc[later], tie[later], s[later])
                if len(d):
                    # A repeat needs no comparison: it is dealt by a hash of its place.
                    shard = X.as_long(place_hash(d, t, s))
                    yield rows_of(REPEAT, shard, d, t, s, c, pa.array([b""] * len(d), pa.binary()))

    return run


def repeats_in(t: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, tie, start) of all starts of LENGTH bytes in the snippets of t that are not the earliest of their class."""
    sa = suffix_array(t)
    shared = permuted_common_prefixes(t, sa)
    klass = np.empty(len(t), np.int64)
    klass[sa] = np.cumsum(shared[sa] < LENGTH)
    snippet = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(snippet)) - np.repeat(np.cumsum(count) - count, count)
    k, d, e, s = klass[bounds[:-1][snippet] + within], doc[snippet], tie[snippet], start[snippet] + within
    order = np.lexsort((s, e, d, k))
    k, d, e, s = k[order], d[order], e[order], s[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    later = (d != d[head]) | (e != e[head]) | (s != s[head])
    return d[later], e[later], s[later]


class Earliest:
    """Repeats among windows in the order (shard, doc, tie, start). Only the earliest place of each window of the shard at hand is held."""

    def __init__(self):
        self.shard, self.seen = None, {}

    def later(self, shard: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        new = np.ones(len(shard), bool)
        new[1:] = shard[1:] != shard[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(shard)), 0))
        out = (doc != doc[head]) | (tie != tie[head]) | (start != start[head])
        # Shards that go on from the batch before or hold windows of different bytes are gone through one by one.
        slow = ~(windows == windows[head]).all(1)
        group = np.cumsum(new) - 1
        slow = np.bincount(group, slow)[group] > 0
        if shard[0] == self.shard:
            slow |= group == 0
        slow |= group == group[-1]
        for k in np.flatnonzero(slow):
            if shard[k] != self.shard:
                self.shard, self.seen = shard[k], {}
            place = (doc[k], tie[k], start[k])
            out[k] = self.seen.setdefault(windows[k].tobytes(), place) != place
        return out


def compare(batches):
    """Repeats (doc, tie, start, count) from rows in the order (kind, shard, doc, tie, start): suffix arrays of whole shards of snippets, several small
    ones at a time; windows one after another; repeats as they are."""
    held: list = []
    size = 0
    earliest = Earliest()

    def given(doc, tie, start, count):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["doc", "tie", "start", "count"])

    def settle(rows):
        doc, tie, start, count, t = (np.concatenate([x[k] for x in rows]) for k in range(1, 6))
        count = count.astype(np.int64)
        return given(*runs_of(*repeats_in(t, doc, tie, start.astype(np.int64), count, np.concatenate([[0], np.cumsum(count + LENGTH - 1)]))))

    for whole_batch in batches:
        kinds = whole_batch.column("kind").to_numpy()
        bounds = np.searchsorted(kinds, [SNIPPET, WINDOW, REPEAT, REPEAT + 1])
        batch, windows, repeats = (whole_batch.slice(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
        if repeats.num_rows:
            yield repeats.select(["doc", "tie", "start", "count"])
        if windows.num_rows:
            shard, doc, tie, start = (windows.column(c).to_numpy() for c in ("shard", "doc", "tie", "start"))
            later = earliest.later(shard, doc, tie, start, _bytes(windows.column("bytes")).reshape(-1, LENGTH))
            yield given(*runs_of(doc[later], tie[later], start[later]))
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in ("shard", "doc", "tie", "start", "count")]
        rows.append(_bytes(batch.column("bytes")))
        held.append(rows)
        size += len(rows[5])
        if size < SHARD_BYTES:
            continue
        shard = np.concatenate([x[0] for x in held])
        cut = int(np.searchsorted(shard, shard[-1]))
        if cut:
            whole = [np.concatenate([x[k] for x in held]) for k in range(6)]
            at = int((whole[4][:cut].astype(np.int64) + LENGTH - 1).sum())
            yield settle([[x[:cut] for x in whole[:5]] + [whole[5][:at]]])
            held = [[x[cut:] for x in whole[:5]] + [whole[5][at:]]]
            size = len(held[0][5])
    if held:
        yield settle(held)


def _bytes(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def remover(keep: list[str], output: str):
    """Each row with its repeats cut out. In kept_text a character that a cut went through is dropped."""

    def run(batches):
        for batch in batches:
            buffer, offsets = X.text_bytes(batch.column("text"))
            runs = batch.column("runs")
            lengths = np.asarray(runs.value_lengths().fill_null(0))
            flat = runs.flatten()
            start, count = flat.field("start").to_numpy().astype(np.int64), flat.field("count").to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(lengths)])
            removed, spans, texts = [], [], []
            for k in range(batch.num_rows):
                own = buffer[offsets[k] : offsets[k + 1]]
                a, c = start[at[k] : at[k + 1]], count[at[k] : at[k + 1]]
                if not len(a):
                    removed.append(0)
                    spans.append(0)
                    texts.append(own.tobytes())
                    continue
                cover = np.zeros(len(own) + 1, np.int64)
                np.add.at(cover, a, 1)
                np.add.at(cover, a + c + LENGTH - 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                texts.append(own[~gone].tobytes())
            made = {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
            if output == "kept_sha256":
                made[output] = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            elif output == "kept_text":
                made[output] = pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string())
            else:
                made[output] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(made.values()), [*keep, *made])

    return run


def dedup(docs: DataFrame, tables: Tables, keep: list[str] | None = None, output: str = "kept_bytes") -> DataFrame:
    """The kept columns (None: all but text) plus n_bytes, n_removed, n_spans and the output (kept_bytes, kept_text or kept_sha256), a row for each row.

    A null text is empty. Texts under LENGTH bytes lose nothing. Rows that repeat a doc_id and its text are one document: starts at the same
    byte of it are not earlier than each other. Rows of one doc_id with different texts are documents in the order of the texts' hashes;
    those without a doc_id come before all others. Long texts are read whole. No rows in, no rows out. Columns named
    like an added one are replaced; names that begin with __lk_ are reserved, and all other columns keep their values.
    """
    made = {"n_bytes", "n_removed", "n_spans", output, "text"}
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in made and not c.startswith("__lk_")]
    kinds = dict(docs.dtypes)
    inner = {c: f"__lk_keep{k}" for k, c in enumerate(keep)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("tie"), "text")
    found = named.select("doc", "tie", "text").mapInArrow(scan, "anchor long, whole long, doc long, tie long, start int, count smallint, open boolean")
    met = found.repartition("anchor").sortWithinPartitions("anchor", "whole", "doc", "tie", "start")
    met = tables.cut(met.mapInArrow(meet, "anchor long, doc long, tie long, start int, count smallint, classes long"))
    # A document has fewer snippets and runs than bytes.
    wanted = met.where("classes > 0").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "start", "count", "classes")).alias("wanted"))
    cut = named.select("doc", "tie", "text").join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(cutter(), "kind byte, shard long, doc long, tie long, start int, count int, bytes binary")
    compared = cut.repartition("shard").sortWithinPartitions("kind", "shard", "doc", "tie", "start").mapInArrow(compare, "doc long, tie long, start int, count int")
    runs = met.where("classes = 0").select("doc", "tie", "start", F.col("count").cast("int").alias("count")).unionByName(compared)
    runs = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    last = f"{output} {'binary' if output == 'kept_bytes' else 'string'}"
    out = named.join(runs, ["doc", "tie"], "left").select(*inner.values(), "text", "runs").mapInArrow(
        remover(list(inner.values()), output), ", ".join([*(f"{n} {kinds[c]}" for c, n in inner.items()), "n_bytes long, n_removed long, n_spans long", last])
    )
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], "n_bytes", "n_removed", "n_spans", output)


def query(spark, docs: DataFrame) -> DataFrame:
    return dedup(docs, Tables(spark, "suffix"), ["doc_id"], "kept_sha256")


ORACLE = r"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, low, substr(h, 2 * low + 1, 2198) AS p FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 1000)) AS low FROM raw)),
starts AS (SELECT doc_id, low, p, unnest(range(0, least(length(p) // 2 - 99, 1000))) AS k FROM chunks),
named AS (SELECT doc_id, low + k AS s, md5_number(substr(p, 2 * k + 1, 200)) AS g FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS place FROM named) WHERE place > 1),
marked AS (SELECT doc_id, s, coalesce(s - lag(s) OVER w > 100, true) AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked),
spans AS (SELECT doc_id, span, min(s) AS a, max(s) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, span, coalesce(lag(b) OVER w, 0) AS a, a AS b, lead(b) OVER w IS NULL AS last, b AS tail FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY span)),
pieces AS (SELECT r.doc_id, g.span, substr(h, 2 * g.a + 1, 2 * (g.b - g.a)) || CASE WHEN last THEN substr(h, 2 * tail + 1) ELSE '' END AS p FROM gaps g JOIN raw r USING (doc_id)),
left_ AS (SELECT doc_id, string_agg(p, '' ORDER BY span) AS k, count(*) AS n FROM pieces GROUP BY doc_id)
SELECT r.doc_id, length(h) // 2 AS n_bytes, (length(h) - length(coalesce(k, h))) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM raw r LEFT JOIN left_ USING (doc_id)"""
