"""Chat formatting: every turn is encoded by itself, reserved ids are spliced around it, and the loss mask follows from prefix sums.

Template (control strings are single reserved ids, which no text can produce):

    <s> begins a conversation
    user        [INST]text[/INST]
    assistant   text</s>
    other roles [ROLE]role[/ROLE]text</s>

Inside texts and role names a backslash is doubled, and a control string gets a backslash after its first character, so the
formatted text holds control strings only where the template put them; `unescape` undoes both. Text is encoded with a
byte-level vocabulary, which gives back every text exactly. The loss mask covers the assistant's text and nothing else.

The output has one row for each turn (formatted text, ids, mask, place of its first token), so that a conversation
of any length is never gathered in one row.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_FOUND = re.compile(r"(<|\[)(?=/?s>|/?INST\]|/?ROLE\])")
_ESCAPED = re.compile(r"\\(\\?)")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded = {}


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _FOUND.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def encoding(path: str):
    """The vocabulary at path; the control ids follow its last one."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        first = max(ranks.values()) + 1
        _loaded[path] = tiktoken.Encoding("larkspur", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {s: first + k for k, s in enumerate(CONTROL)}
    return _loaded[path]


def segments(role: str, text: str) -> list[tuple[str, bool, bool]]:
    """(string, is control, is under the loss) of one turn."""
    if role == "user":
        return [("[INST]", True, False), (escape(text), False, False), ("[/INST]", True, False)]
    if role == "assistant":
        return [(escape(text), False, True), ("</s>", True, False)]
    return [("[ROLE]", True, False), (escape(role), False, False), ("[/ROLE]", True, False), (escape(text), False, False), ("</s>", True, False)]


def encode_turns(path: str, keep: list[str]):
    def run(batches):
        encoder, reserved = encoding(path)
        for batch in batches:
            rows = [segments(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            flat = [s for row in rows for s in row]
            plain = iter(encoder.encode_ordinary_batch([s for s, control, _ in flat if not control], num_threads=1))
            parts = [[reserved[s]] if control else next(plain) for s, control, _ in flat]
            # Prefix sums of the segments' lengths place every segment; the mask is the running sum of +1 and -1 at the ends of those under the loss.
            places = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            under = np.array([loss for _, _, loss in flat], bool)
            step = np.zeros(places[-1] + 1, np.int8)
            np.add.at(step, places[:-1][under], 1)
            np.add.at(step, places[1:][under], -1)
            mask = np.cumsum(step[:-1], dtype=np.int8)
            bounds = pa.array(places[np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)].astype(np.int32))
            ids = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
            made = [pa.array(["".join(s for s, _, _ in row) for row in rows], pa.string()), pa.ListArray.from_arrays(bounds, pa.array(ids)), pa.ListArray.from_arrays(bounds, pa.array(mask))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, "formatted", "ids", "loss_mask"])

    return run


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """turns: conv_id, turn, role, text -> (conv_id, turn, role, formatted, ids, loss_mask, formatted_chars, seq, token_start), a row for each turn.

    formatted_chars counts the code points of formatted. seq orders a conversation's rows: by turn (null first), and where turns tie by role and ids, so repeated rows stay and
    stand together; texts themselves are not shuffled for that. token_start is the place of the row's first token in its conversation. A null text or role is empty. Rows
    whose conv_id is null are one conversation. An empty table gives no rows; other columns are not read.
    """
    kind = dict(turns.dtypes)["conv_id"]
    given = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    coded = given.mapInArrow(encode_turns(vocabulary, ["conv_id", "turn", "role"]), f"conv_id {kind}, turn long, role string, formatted string, ids array<int>, loss_mask array<tinyint>")
    coded = coded.withColumn("formatted_chars", F.length("formatted").cast("long"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "ids")
    opens = F.col("seq") == 1
    begin = encoding(vocabulary)[1]["<s>"]
    placed = coded.withColumn("seq", F.row_number().over(by_turn).cast("long")).withColumns(
        {
            "formatted": F.when(opens, F.concat(F.lit("<s>"), "formatted")).otherwise(F.col("formatted")),
            "formatted_chars": F.when(opens, F.col("formatted_chars") + len("<s>")).otherwise(F.col("formatted_chars")),
            "ids": F.when(opens, F.concat(F.array(F.lit(begin)), "ids")).otherwise(F.col("ids")),
            "loss_mask": F.when(opens, F.concat(F.array(F.lit(0).cast("tinyint")), "loss_mask")).otherwise(F.col("loss_mask")),
        }
    )
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("token_start", F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0)))


def read_turn(ids: np.ndarray, mask: np.ndarray, encoder, control: dict[int, str]) -> tuple[str, str, str]:
    """(role, text, text under the loss), from the ids and mask alone."""
    role, text, open_, marks = "assistant", "", "", []
    at = 0
    for k in [*np.flatnonzero(ids >= min(control)).tolist(), len(ids)]:
        if k > at:
            piece = unescape(encoder.decode_bytes(ids[at:k].tolist()).decode())
            if open_ == "[ROLE]":
                role = piece
            else:
                text = piece
        if k < len(ids):
            open_ = control[int(ids[k])]
            marks.append(open_)
        at = k + 1
    if "[INST]" in marks:
        role = "user"
    elif "[ROLE]" in marks and role == "assistant":
        role = ""
    under = ids[mask.astype(bool)]
    return role, text, unescape(encoder.decode_bytes(under.tolist()).decode()) if len(under) else ""


def digest_turns(path: str):
    """A row for each conversation from rows that lie in its order; only hashes and counts are held."""

    def run(batches):
        encoder, reserved = encoding(path)
        control = {v: k for k, v in reserved.items()}
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state, done = None, []

        def close():
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            lists = batch.column("ids")
            places = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
            all_ids, all_masks = np.asarray(lists.flatten()), np.asarray(batch.column("loss_mask").flatten())
            for k, (conv, chars) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted_chars").to_pylist(), strict=True)):
                ids, mask = all_ids[places[k] : places[k + 1]], all_masks[places[k] : places[k + 1]]
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, under = read_turn(ids, mask, encoder, control)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += chars
            if len(done) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, kind if k == 0 else None) for k, v in enumerate(zip(*done, strict=True))], names)
                done = []
        if state is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, kind if k == 0 else None) for k, v in enumerate(zip(*done, strict=True))], names)

    return run


def digest(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from ids and masks.

    A conversation, the one with the null conv_id too, has one row; its turns are read in the order of seq, so that ties and repeated rows count each. Empty texts and roles
    count as such. Long conversations are read turn by turn. No rows in, no rows out; other columns are not read.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    ordered = formatted.select("conv_id", "seq", "formatted_chars", "ids", "loss_mask").repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(digest_turns(vocabulary), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, turns: DataFrame) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return digest(format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(probe)))


ORACLE = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?s>|/?INST\]|/?ROLE\])', '\1\\\2', 'g')) AS n,
    length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?s>|/?INST\]|/?ROLE\])', '\1\\\2', 'g')) AS m FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(n + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE m + 17 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""
