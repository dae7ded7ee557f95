"""SentencePiece encoding and decoding: Viterbi over all words of many texts at once.

A text gets a space in front and is cut into words before each run of spaces; no piece crosses such a cut, so words are
segmented by themselves and equal words once. The substrings of all words are hashed length by length and looked up among the sorted hashes of
the pieces (found pieces are compared byte by byte). Where no piece found crosses a place between two bytes, a word falls into parts
that are segmented by themselves too; long words without spaces, as in Chinese, become many short parts so. Parts of equal length advance
together: for each end the best start is a maximum over the lengths, stored as the backpointer. A very long part goes on from block to block
with the best scores of the last places carried over.

The vocabulary file orders pieces by rank and has no log probabilities, so a piece of rank r scores -log(r + 2.7) minus the log of
their sum, as by Zipf's law, in whole units of 1 / UNIT. A segmentation's score is the sum of its pieces' scores; of equal sums that one counts whose last piece is
shorter, and so on from the end. A byte that no piece covers becomes a byte piece. Encoding loses nothing: a space is the piece character
U+2581, a literal U+2581 is spelled in bytes, and `decode` gives back every text exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnp as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SLICE_BYTES = 1 << 20
#: How much worse than the worst piece an uncovered character is.
PENALTY = 10.0
#: Scores are whole numbers of this part, so that sums are exact in any order.
UNIT = 1 << 24
#: Scores of a block (lengths x places x parts).
CELLS = 2_000_000
_NEVER = -(2**62)
_MAYBE = 1 << 22
_STEP = np.uint64(0x9FB21C651E98DF25)
_loaded = {}


def longer(hashes: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one byte longer."""
    out = (hashes ^ X.BYTE_VALUES[byte]) * _STEP
    return out ^ (out >> np.uint64(32))


def low_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(_MAYBE - 1)).astype(np.int64)


class Vocabulary:
    """Pieces by id: bytes (spaces for U+2581), scores, and tables for lookup by hash."""

    def __init__(self, pieces: list[tuple[int, bytes]], byte_ids: np.ndarray, size: int):
        """pieces: (id, bytes) in order of rank; byte_ids: the ids of the 256 byte pieces; size: how many ids there are."""
        raw = -np.log(np.arange(len(pieces)) + 2.7)
        raw = raw - np.log(np.exp(raw).sum())
        self.ids = np.array([i for i, _ in pieces], np.int32)
        self.scores = np.rint(raw * UNIT).astype(np.int64)
        self.byte_ids = byte_ids.astype(np.int32)
        self.uncovered = int(self.scores.min() if len(pieces) else 0) - int(PENALTY * UNIT)
        sizes = np.array([len(b) for _, b in pieces], np.int64)
        self.longest = int(sizes.max()) if len(pieces) else 1
        joined = np.frombuffer(b"".join(b for _, b in pieces), np.uint8)
        starts = np.cumsum(sizes) - sizes
        #: Which low bits of a hash some piece, or some beginning of a piece, of each length has.
        self.maybe_piece, self.maybe_more = np.zeros(_MAYBE, bool), np.zeros(_MAYBE, bool)
        self.keys: list = [None]  # by length: sorted hashes, and the pieces that have them
        hashes, left = np.zeros(len(pieces), np.uint64), np.arange(len(pieces))
        for n in range(1, self.longest + 1):
            left = left[sizes[left] >= n]
            hashes[left] = longer(hashes[left], joined[starts[left] + n - 1])
            own = left[sizes[left] == n]
            order = own[np.argsort(hashes[own], kind="stable")]
            if len(np.unique(hashes[own])) < len(own):
                raise ValueError("two pieces have one hash")
            self.keys.append((hashes[order], order))
            self.maybe_piece[low_bits(hashes[own])] = True
            self.maybe_more[low_bits(hashes[left[sizes[left] > n]])] = True
        #: The pieces' bytes in blocks of 8, filled with zeros.
        wide = np.zeros((len(pieces), 8 * -(-self.longest // 8)), np.uint8)
        for k, (_, b) in enumerate(pieces):
            wide[k, : len(b)] = np.frombuffer(b, np.uint8)
        self.blocks = wide.view("<u8")
        spelled = [b""] * size
        for i, b in pieces:
            spelled[i] = b
        for value, i in enumerate(byte_ids):
            spelled[i] = bytes([value])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(b) for b in spelled])])


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in usual}
        # Pieces of spaces alone stand at the front of the file without a rank of their own; they go last.
        ranked = sorted(usual, key=lambda i: (-model.get_score(i), i))
        inner = [i for i in ranked if SPACE in text[i].lstrip(SPACE)]
        bytes_ = np.array([model.piece_to_id(f"<0x{v:02X}>") for v in range(256)])
        _loaded[path] = Vocabulary([(i, text[i].replace(SPACE, " ").encode()) for i in ranked if i not in set(inner)], bytes_, n)
    return _loaded[path]


def found_pieces(vocabulary: Vocabulary, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece) of all pieces in the words of text; ends: the end of each byte's word."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    at8 = np.ndarray(len(text) + 1, "<u8", wide, strides=(1,))
    at, hashes = np.arange(len(text)), np.zeros(len(text), np.uint64)
    got = []
    for n in range(1, vocabulary.longest + 1):
        fits = at + n <= ends[at]
        at, hashes = at[fits], hashes[fits]
        if not len(at):
            break
        hashes = longer(hashes, text[at + n - 1])
        bits = low_bits(hashes)
        keys, pieces = vocabulary.keys[n]
        hit = np.flatnonzero(vocabulary.maybe_piece[bits])
        if len(hit) and len(keys):
            place = np.minimum(np.searchsorted(keys, hashes[hit]), len(keys) - 1)
            same = keys[place] == hashes[hit]
            hit, piece = hit[same], pieces[place[same]]
            same = np.ones(len(hit), bool)
            for block in range(-(-n // 8)):
                filled = min(8, n - 8 * block)
                mask = np.uint64((1 << (8 * filled)) - 1)
                same &= (at8[at[hit] + 8 * block] & mask) == vocabulary.blocks[piece, block]
            got.append((at[hit[same]], np.full(int(same.sum()), n), piece[same]))
        more = vocabulary.maybe_more[bits]
        at, hashes = at[more], hashes[more]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3


def segment_together(vocabulary: Vocabulary, text: np.ndarray, starts: np.ndarray, length: int, part: np.ndarray, end: np.ndarray, n: np.ndarray, score: np.ndarray) -> np.ndarray:
    """(length + 1, parts): at the end of each piece of the best segmentations its length, else 0.

    starts: of parts of one length in text. part, end, n, score: the pieces found in them.
    """
    m, most = len(starts), min(length, vocabulary.longest)
    best = np.full((length + 1, m), _NEVER, np.int64)
    best[0] = 0
    back = np.zeros((length + 1, m), np.int16)
    width = max(1, CELLS // (most * m))
    if width < length:
        by_end = np.argsort(end, kind="stable")
        part, end, n, score = part[by_end], end[by_end], n[by_end], score[by_end]
    for low in range(0, length, width):
        high = min(length, low + width)
        scores = np.full((most, high - low, m), _NEVER, np.int64)
        scores[0] = np.where(X.IS_LEAD[text[starts[None, :] + np.arange(low, high)[:, None]]], vocabulary.uncovered, 0)
        a, b = np.searchsorted(end, [low, high], "right") if width < length else (0, len(end))
        scores[n[a:b] - 1, end[a:b] - 1 - low, part[a:b]] = score[a:b]
        for e in range(low + 1, high + 1):
            k = min(e, most)
            sums = best[e - k : e][::-1] + scores[:k, e - 1 - low]
            step = sums.argmax(0)
            back[e] = step + 1
            best[e] = np.take_along_axis(sums, step[None], 0)[0]
    kept = np.zeros((length + 1, m), np.int16)
    where, live = np.full(m, length), np.arange(m)
    while len(live):
        own = back[where[live], live]
        kept[where[live], live] = own
        where[live] -= own
        live = live[where[live] > 0]
    return kept


def segment(vocabulary: Vocabulary, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of text, one after another, and the bounds of each word's ids; bounds: of the words, none of them empty."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    start, n, piece = found_pieces(vocabulary, text, ends)
    over = n > 1
    crossed = np.bincount(start[over] + 1, minlength=len(text) + 1)[: len(text) + 1] - np.bincount(start[over] + n[over], minlength=len(text) + 1)[: len(text) + 1]
    free = np.cumsum(crossed)[:-1] == 0
    cuts = np.flatnonzero(free)
    size = np.diff(np.append(cuts, len(text)))
    of = (np.cumsum(free) - 1)[start]
    by_size, hits_by_size = _by_size(size), _by_size(size[of])
    edges = np.append(np.flatnonzero(np.diff(size[by_size], prepend=0)), len(size))
    hit_edges = np.searchsorted(size[of[hits_by_size]], size[by_size[edges[:-1]]])
    place = np.empty(len(size), np.int64)  # in its group
    place[by_size] = np.arange(len(size)) - np.repeat(edges[:-1], np.diff(edges))
    token = np.zeros(len(text) + 1, np.int16)
    for a, b, x, y in zip(edges[:-1], edges[1:], hit_edges, np.append(hit_edges[1:], len(of)), strict=True):
        length = int(size[by_size[a]])
        if length == 1:
            token[cuts[by_size[a:b]] + 1] = 1
            continue
        step = max(1, CELLS // (min(length, vocabulary.longest) * min(length, 512)))
        for low in range(0, b - a, step):
            hits = hits_by_size[x:y]
            if b - a > step:
                hits = hits[(place[of[hits]] >= low) & (place[of[hits]] < low + step)]
            at = cuts[by_size[a + low : min(b, a + low + step)]]
            end = start[hits] + n[hits] - cuts[of[hits]]
            kept = segment_together(vocabulary, text, at, length, place[of[hits]] - low, end, n[hits], vocabulary.scores[piece[hits]])
            token[at[None, :] + np.arange(1, length + 1)[:, None]] = kept[1:]
    stop = np.flatnonzero(token)
    taken = np.full(len(text) + 1, -1, np.int32)
    used = token[start + n] == n
    taken[(start + n)[used]] = piece[used]
    own = taken[stop]
    ids = np.where(own >= 0, vocabulary.ids[own], vocabulary.byte_ids[text[stop - 1]])
    return ids, np.searchsorted(stop, bounds, "right")


def _by_size(size: np.ndarray) -> np.ndarray:
    """The order by size; small numbers are sorted by their digits."""
    return np.argsort(size.astype(np.uint16) if len(size) and size.max() < 1 << 16 else size, kind="stable")


def encode_texts(vocabulary: Vocabulary, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, one after another, and the bounds of each row's ids."""
    some = np.diff(offsets) > 0
    fronted = np.insert(buffer, offsets[:-1][some], 32)
    bounds = offsets + np.concatenate([[0], np.cumsum(some)])
    space = fronted == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[bounds[:-1][some]] = True
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    size = np.diff(np.append(starts, len(fronted)))
    _, first, of = np.unique(X.span_hashes(fronted, starts, starts + size), return_index=True, return_inverse=True)
    same = size == size[first[of]]
    same[same] = X.equal_spans(fronted, starts[same], starts[first[of[same]]], size[same])
    odd = np.flatnonzero(~same)  # words of one hash and different bytes
    of[odd] = len(first) + np.arange(len(odd))
    first = np.concatenate([first, odd])
    ends = np.concatenate([[0], np.cumsum(size[first])])
    pool, at = segment(vocabulary, fronted[np.arange(ends[-1]) + np.repeat(starts[first] - ends[:-1], size[first])], ends)
    each = np.diff(at)[of]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = pool[np.arange(ends[-1]) + np.repeat(at[:-1][of] - ends[:-1], each)]
    return ids, ends[np.searchsorted(starts, bounds)]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows and their offsets; ids that spell nothing (control pieces, ids out of range) are skipped."""
    ids = np.where((ids >= 0) & (ids < len(vocabulary.spelled_at) - 1), ids, 0)
    start, size = vocabulary.spelled_at[ids], np.diff(vocabulary.spelled_at)[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    out = vocabulary.spelled[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    offsets = ends[bounds]
    front = offsets[:-1][(np.diff(offsets) > 0)]
    front = front[out[front] == 32]
    gone = np.zeros(len(out) + 1, np.int64)
    gone[front + 1] = 1
    return np.delete(out, front), offsets - np.cumsum(gone)[offsets]


def encoder(model: str, keep: list[str]):
    """Batches go out in pieces of about SLICE_BYTES of text, so that memory follows the longest text and not the batch."""

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            for row, end, buffer, offsets in X.slices(*X.text_bytes(batch.column("text")), SLICE_BYTES):
                part = batch.slice(row, end - row)
                ids, bounds = encode_texts(vocab, buffer, offsets)
                null = part.column("text").is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=null if null.true_count else None)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists], [*keep, "ids"])

    return run


def decoder(model: str, keep: list[str]):
    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            sizes = np.asarray(batch.column("ids").value_lengths().fill_null(0))
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES // 2, "right")) - 1)
                part = batch.slice(row, end - row)
                lists = part.column("ids")
                data, offsets = decode_ids(vocab, np.asarray(lists.flatten().fill_null(0)), bounds[row : end + 1] - bounds[row])
                raw, null = data.tobytes(), lists.is_null().to_pylist()
                texts = [None if null[k] else raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace") for k in range(end - row)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(texts, pa.string())], [*keep, "decoded"])
                row = end

    return run


def encode(docs: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The kept columns plus ids array<int>, a row for each row.

    A null text has null ids, an empty one none; long texts are encoded whole. Equal texts, as in repeated rows, have equal ids, and ties between segmentations are
    broken as said above. No rows in, no rows out. Columns named ids are replaced, all others keep their values.
    """
    keep = [c for c in keep if c.lower() != "ids"]
    kinds = dict(docs.dtypes)
    given = docs.select(*dict.fromkeys([*keep, "text"]))
    return given.mapInArrow(encoder(model, keep), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>"]))


def decode(coded: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """The kept columns plus decoded string: the text that the ids spell, a row for each row.

    Null ids give null, no ids an empty text; null elements and ids that spell nothing are skipped. Equal ids, as in repeated rows, give equal texts. No rows in, no
    rows out. Columns named decoded are replaced, all others keep their values.
    """
    keep = [c for c in keep if c.lower() != "decoded"]
    kinds = dict(coded.dtypes)
    return coded.mapInArrow(decoder(model, keep), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded string"]))


def round_trip(model: str):
    """Encoder and decoder one after the other in a task: doc_id, ids, n_pieces, and whether the ids spell the text again."""

    def run(batches):
        for coded in encoder(model, ["doc_id", "text"])(batches):
            back = [t for b in decoder(model, ["doc_id"])(iter([coded])) for t in b.column("decoded").to_pylist()]
            same = [a == b for a, b in zip(coded.column("text").to_pylist(), back, strict=True)]
            yield pa.RecordBatch.from_arrays([coded.column("doc_id"), coded.column("ids"), coded.column("ids").value_lengths().fill_null(0).cast(pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "spells_text"])

    return run


def query(spark, docs: DataFrame, model: str = MODEL) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(round_trip(model), "doc_id long, ids array<int>, n_pieces long, spells_text boolean")
