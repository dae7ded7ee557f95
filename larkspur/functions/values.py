"""Scalar functions on columns: canonical JSON, buckets of ids, rounding and change, sealed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_bucket(id_: Column, digits: int = 2) -> Column:
    """The first hex digits of the id's SHA-256: which bucket of a bucketed collection holds it."""
    return F.substring(F.sha2(id_, 256), 1, digits)


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys, of a string that holds JSON or of a nested column."""
    return F.to_json(F.parse_json(c))


def content_key(c: Column) -> Column:
    """Address of a content: equal contents share it."""
    return F.sha2(c, 256)


def percent_change(now: Column, base: Column, digits: int = 2) -> Column:
    """NULL against a base of 0, but 0 if both are 0."""
    return F.when(base == 0, F.when(now == 0, F.lit(0.0))).otherwise(F.round((now - base) / base * 100, digits))


def url_component(c: Column) -> Column:
    """Percent encoding, a space as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def seal(text: Column, key: Column, bound_to: Column) -> Column:
    """AES-GCM of the text as base64, valid only together with the string it is bound to. The nonce is a hash of both, so that reruns agree."""
    nonce = F.unhex(F.substring(F.sha2(F.concat(bound_to, F.lit("/"), text), 256), 1, 24))
    return F.base64(F.call_function("aes_encrypt", text.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, bound_to))


def unseal(sealed: Column, key: Column, bound_to: Column) -> Column:
    return F.call_function("aes_decrypt", F.unbase64(sealed), key, F.lit("GCM"), F.lit("DEFAULT"), bound_to).cast("string")
