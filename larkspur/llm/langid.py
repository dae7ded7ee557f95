"""Language ID: a byte convolutional network over fixed-length windows of the whole text.

Bytes are embedded; filters of widths 2, 3 and 4 slide over a window of WINDOW bytes; each filter's largest response is
kept, and a dense layer with softmax gives the window's language. A text is cut into windows that cover all of it (the
last one filled with zero bytes); its prediction is the mean of the windows' distributions, weighted by their bytes.

The network is trained in numpy on a bounded sample of labelled documents (TRAIN_DOCS in all, in even shares by language,
with at most TRAIN_DOCS windows). For prediction, all filter responses of a byte pair are tabulated, so a position costs two table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnp as X

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: The bound of the training sample (documents, all languages together), and windows of a document where documents are few.
TRAIN_DOCS = 6_000
MOST_WINDOWS = 8
EPOCHS = 14
LEAST_STEPS = 400
BATCH = 128
FOLDS = 5
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from; a null id counts as one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS, F.lit(0)) == 0


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, label numbers and languages, from rows that are not held out: at most train_docs rows reach the driver.

    Languages get even shares, and one with fewer rows than its share gives all; within a language those rows are taken whose hash is smallest. A row gives the windows at
    places that its hash picks: one, or several where there are few rows. All languages are learned, as long as the sample has a row for each.
    Rows with a null text or lang are not learned from; ties of the hash are in the order of doc_id and text; no rows in, no languages out.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(train_docs).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = train_docs / len(counts)
    mark = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    unit = F.shiftrightunsigned(mark, 11).cast("double") / float(2**53)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.1 * share / r["count"]))])
    chosen = unit < F.try_element_at(rate, F.col("lang"))
    each = max(1, min(MOST_WINDOWS, int(train_docs / sum(min(share, r["count"]) for r in counts))))
    turn = F.explode(F.sequence(F.lit(0), F.lit(each - 1)))
    place = F.pmod(F.xxhash64(mark, "turn"), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "turn", "cut"))
    rows = (
        usable.where(chosen).select("lang", "text", "doc_id", unit.alias("u"), turn.alias("turn"))
        .select("lang", "doc_id", "u", "turn", F.substring(F.col("text"), (place + 1).cast("int"), WINDOW).alias("cut"))
        .withColumn("rank", rank).where(F.col("rank") <= max(1, int(share)) * each)
        .orderBy("u", "doc_id", "turn", "cut").limit(train_docs).collect()
    )
    langs = sorted({r["lang"] for r in rows})
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for k, r in enumerate(rows):
        piece = r["cut"].encode()[:WINDOW]
        windows[k, : len(piece)] = np.frombuffer(piece, np.uint8)
    return windows, np.array([langs.index(r["lang"]) for r in rows]), langs


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))} | {f"w{w}": rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
        self.p |= {"b": np.zeros(FILTERS * len(WIDTHS)), "d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "c": np.zeros(len(langs))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def responses(self, windows: np.ndarray, w: int) -> np.ndarray:
        """(windows, places, filters) of one width, before the bias."""
        places = WINDOW - w + 1
        out = 0
        for j in range(w):
            out = out + np.take(self.p["e"] @ self.p[f"w{w}"][j], windows[:, j : j + places], axis=0)
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> Network:
        rng = np.random.Generator(np.random.PCG64(11))
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        each = -(-len(labels) // BATCH)
        epochs = max(epochs, -(-LEAST_STEPS // each))
        step, steps = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
                step += 1
                self._step(self._gradients(x, y), moments, step, rate * (1 - step / (steps + 1)))
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        best, tops = [], []
        for w in WIDTHS:
            r = self.responses(x, w)
            best.append(r.argmax(1))
            tops.append(np.take_along_axis(r, best[-1][:, None], 1)[:, 0])
        pre = np.concatenate(tops, 1) + p["b"]
        h = np.maximum(pre, 0)
        prob = softmax(h @ p["d"] + p["c"])
        prob[np.arange(n), y] -= 1
        out = prob / n
        g = {"d": h.T @ out, "c": out.sum(0), "e": np.zeros_like(p["e"])}
        back = (out @ p["d"].T) * (pre > 0)
        g["b"] = back.sum(0)
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                byte = np.take_along_axis(x, best[k] + j, 1)  # (windows, filters)
                g[f"w{w}"][j] = np.einsum("nfe,nf->ef", p["e"][byte], own)
                np.add.at(g["e"], byte, own[:, :, None] * p[f"w{w}"][j].T[None])
        return g

    def _step(self, g: dict, moments: dict, step: int, rate: float) -> None:
        for k, v in g.items():
            m, s = moments[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by byte pair: of all widths to the pair at a place, and of widths 3 and 4 to the pair two places on."""
        part = {(w, j): self.p["e"] @ self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        nothing = np.zeros((256, FILTERS), np.float32)
        here = np.concatenate([pair(part[w, 0], part[w, 1]) for w in WIDTHS], 1)
        on = np.concatenate([pair(part[3, 2], nothing), pair(part[4, 2], part[4, 3])], 1)
        return np.ascontiguousarray(here), np.ascontiguousarray(on)

    def distributions(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(windows, languages). Places at which the widest filter doesn't fit are left to no filter but those that fit."""
        here, on = tables
        top = np.full((len(windows), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for at in range(0, len(windows), 64):
            x = windows[at : at + 64].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            r = np.take(here, pairs[:, :-2], axis=0)
            r[:, :, FILTERS:] += np.take(on, pairs[:, 2:], axis=0)
            top[at : at + 64] = r.max(1)
            tail = np.take(here[:, :FILTERS], pairs[:, -2:], axis=0).max(1)
            top[at : at + 64, :FILTERS] = np.maximum(top[at : at + 64, :FILTERS], tail)
            last = here[pairs[:, -2], FILTERS : 2 * FILTERS] + on[x[:, -1] * 256, :FILTERS]
            top[at : at + 64, FILTERS : 2 * FILTERS] = np.maximum(top[at : at + 64, FILTERS : 2 * FILTERS], last)
        return softmax(np.maximum(top + self.p["b"], 0) @ self.p["d"] + self.p["c"])


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows, the row of each and the bytes of text in each."""
    sizes = np.diff(offsets)
    each = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), each)
    first = np.concatenate([[0], np.cumsum(each)])
    starts = offsets[:-1][rows] + (np.arange(len(rows)) - first[rows]) * WINDOW
    filled = np.minimum(offsets[1:][rows] - starts, WINDOW)
    padded = np.concatenate([buffer, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]
    short = filled < WINDOW
    out[short] = np.where(np.arange(WINDOW) < filled[short][:, None], out[short], 0)
    return out, rows, filled


def predictor(network: Network | None, keep: list[str], least: float | None = None):
    """least None: predictions beside the kept columns; else the kept columns of the rows that have a language and that score."""

    def run(batches):
        tables = network.tables() if network else None
        langs = np.array([*(network.langs if network else []), UNKNOWN], dtype=object)
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, len(langs) - 1), np.zeros(n)
            if network:
                lettered = np.asarray(batch.column("__lk_letter").to_numpy(zero_copy_only=False), bool)
                for row, end, buffer, offsets in X.slices(*X.text_bytes(batch.column("text"))):
                    windows, rows, filled = windows_of(buffer, offsets)
                    if not len(rows):
                        continue
                    p = network.distributions(windows, tables) * filled[:, None]
                    total = np.stack([np.bincount(rows, p[:, k], end - row) for k in range(p.shape[1])], 1) / np.maximum(np.bincount(rows, filled, end - row), 1)[:, None]
                    best[row:end], score[row:end] = total.argmax(1), total.max(1)
                best[~lettered], score[~lettered] = len(langs) - 1, 0
            if least is None:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(langs[best], pa.string()), pa.array(np.clip(score, 0, 1))], [*keep, "lang_pred", "score"])
            else:
                yield batch.select(keep).filter(pa.array((best < len(langs) - 1) & (score >= least)))

    return run


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """None where there is nothing to learn from; then every text is `und`."""
    windows, labels, langs = sample(docs, train_docs)
    return Network(langs).train(windows, labels) if langs else None


def _given(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__lk_letter")
    kinds = dict(docs.dtypes)
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])], letter), ", ".join(f"`{c}` {kinds[c]}" for c in keep)


def identify(docs: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """The kept columns plus lang_pred string and score double (0 to 1) of each text, a row for each row.

    Texts that are null or have no letter are `und` with score 0, and so are all texts where there is no network. Repeated
    rows are predicted each; of equal scores the language that is first by name counts. Long texts are read whole. No rows in, no rows out. Columns
    named lang_pred or score are replaced; names that begin with __lk_ are reserved.
    """
    keep = [c for c in keep if c.lower() not in {"lang_pred", "score"}]
    given, schema = _given(docs, keep)
    return given.mapInArrow(predictor(network, keep), f"{schema}, lang_pred string, score double")


def accept(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, that have a language with at least that score: none whose text is null, empty or has no letter.

    Repeated rows stay or go together; other columns, whatever their names, are passed on. No rows in, no rows out.
    """
    given, schema = _given(docs, docs.columns)
    return given.mapInArrow(predictor(network, docs.columns, least), schema)


def query(spark, docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs), ["doc_id"]).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
