"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat, html_extract, langid, minhash, mixing, quality, sentencepiece_ops, sharding, suffix_dedup
from .common import Tables, load


def queries() -> dict:
    return {
        "op1_langid": lambda s, d: langid.query(s, load(s, d, "documents")),
        "op2_chat": lambda s, d: chat.query(s, load(s, d, "conversations")),
        "op4_minhash": lambda s, d: minhash.query(s, load(s, d, "documents")),
        "op5_sentencepiece": lambda s, d: sentencepiece_ops.query(s, load(s, d, "documents")),
        "op6_html": lambda s, d: html_extract.query(s, load(s, d, "pages")),
        "op7_ann": lambda s, d: ann.query(s, load(s, d, "embeddings")),
        "op8_suffix_dedup": lambda s, d: suffix_dedup.query(s, load(s, d, "documents")),
        "op9_quality": lambda s, d: quality.query(s, load(s, d, "documents"), load(s, d, "labels")),
        "quality_base": lambda s, d: quality.base_counts(load(s, d, "documents"), Tables(s, "quality")),
        "op3_sharding": lambda s, d: sharding.query(s, load(s, d, "documents")),
        "op10_mixing": lambda s, d: mixing.query(s, load(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": chat.ORACLE, "op3_sharding": sharding.oracle(), "op4_minhash": minhash.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE, "quality_base": quality.BASE_ORACLE, "op10_mixing": mixing.ORACLE,
    }
