"""Query trees to DataFrame expressions.

Predicates are two-valued: a missing field makes a comparison false, and ne and not true. Where an expression stands under no not, NULL drops the row
as false does, so the plain comparison is used, which Parquet scans take as a pushed filter; under a not it is closed with coalesce.

Two forms of collections compile: typed columns, where NULL is a missing field (there is no JSON null), and one VARIANT column, which keeps both apart.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import And, Comparison, Not, Or, Order, QueryError

_INTEGER = re.compile(r"(0|-?[1-9][0-9]*)\Z")


def canonical(value: Any) -> str:
    """JSON text with sorted keys; whole numbers without a fraction, as Spark prints parsed numbers."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class Typed:
    """A row of declared columns. binary_safe: string fields whose binary order is their collation order; their comparisons reach the scan.

    id_source: the column of integers whose text is the id, if the id is not stored as text.
    """

    def __init__(self, schema: T.StructType, id_column: str = "id", id_source: str | None = None, binary_safe: frozenset[str] = frozenset()):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.id_column, self.id_source = id_column, id_source
        self.binary_safe = binary_safe | ({"id"} if id_source else frozenset())

    def column(self, name: str) -> Column | None:
        if name == "id":
            return F.col(self.id_source).cast("string") if self.id_source else F.col(f"`{self.id_column}`")
        return F.col(f"`{name}`") if name in self.types else None

    def kind(self, name: str) -> str:
        if name == "id":
            return "string"
        t = self.types.get(name)
        if isinstance(t, T.StringType):
            return "string"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "time"
        if isinstance(t, T.ArrayType):
            return "array"
        return "missing" if t is None else "object"

    def equal(self, name: str, value: Any) -> Column:
        c, kind = self.column(name), self.kind(name)
        if c is None or value is None:
            return F.lit(False)
        if name == "id" and self.id_source:
            # Only the text of an integer can be an id; as a number it is pushed to the scan.
            fits = isinstance(value, str) and _INTEGER.match(value) and -(2**63) <= int(value) < 2**63
            return F.col(self.id_source) == F.lit(int(value)) if fits else F.lit(False)
        if kind == "string":
            return c == F.lit(value) if isinstance(value, str) else F.lit(False)
        if kind == "number":
            return c == F.lit(value) if is_number(value) else F.lit(False)
        if kind == "boolean":
            return c == F.lit(value) if isinstance(value, bool) else F.lit(False)
        if kind == "time":
            return c == F.lit(value).cast(self.types[name]) if isinstance(value, str) else F.lit(False)
        return _json(c) == F.lit(canonical(value)) if isinstance(value, (list, tuple, dict)) else F.lit(False)

    def ordered(self, name: str, operator: str, value: Any) -> Column:
        c, kind = self.column(name), self.kind(name)
        if kind == "number" and is_number(value):
            return _compare(c, operator, F.lit(value))
        if kind == "time" and isinstance(value, str):
            return _compare(c, operator, F.lit(value).cast(self.types[name]))
        if kind == "string" and isinstance(value, str):
            if name in self.binary_safe:
                return _compare(c, operator, F.lit(value))
            return _compare(F.collate(c, "UNICODE"), operator, F.collate(F.lit(value), "UNICODE"))
        return F.lit(False)

    def contains(self, name: str, value: Any) -> Column:
        c, kind = self.column(name), self.kind(name)
        if kind == "string":
            return c.contains(F.lit(value)) if isinstance(value, str) else F.lit(False)
        if kind != "array" or value is None:
            return F.lit(False)
        element = self.types[name].elementType
        if isinstance(element, T.StringType):
            return F.array_contains(c, F.lit(value)) if isinstance(value, str) else F.lit(False)
        if isinstance(element, T.NumericType):
            return F.exists(c, lambda x: x == F.lit(value)) if is_number(value) else F.lit(False)
        if isinstance(element, T.BooleanType):
            return F.array_contains(c, F.lit(value)) if isinstance(value, bool) else F.lit(False)
        return F.exists(c, lambda x: _json(x) == F.lit(canonical(value)))

    def sort_keys(self, order: Order) -> list[Column]:
        c = self.column(order.field)
        if c is None:
            return []
        if self.kind(order.field) == "string" and order.field not in self.binary_safe:
            c = F.collate(c, "UNICODE")
        elif self.kind(order.field) in ("array", "object"):
            c = F.collate(_json(c), "UNICODE")
        return [c.desc_nulls_first() if order.descending else c.asc_nulls_last()]


class Variants:
    """A row of id and one VARIANT column; fields are its top-level members, and a dot is part of a name."""

    id_column, id_source = "id", None
    binary_safe: frozenset[str] = frozenset()

    def __init__(self, column: str = "doc"):
        self.doc = column

    def member(self, name: str) -> Column:
        path = name.replace("\\", "\\\\").replace('"', '\\"')
        return F.try_variant_get(F.col(self.doc), f'$["{path}"]', "variant")

    def _tag(self, v: Column) -> Column:
        return F.schema_of_variant(v)

    def _number(self, v: Column) -> Column:
        return F.when(self._tag(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))

    def _string(self, v: Column) -> Column:
        return F.when(self._tag(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def column(self, name: str) -> Column:
        return F.col("id") if name == "id" else F.to_json(self.member(name))

    def _equals(self, v: Column, value: Any) -> Column:
        if value is None:
            return self._tag(v) == "VOID"
        if isinstance(value, bool):
            return F.when(self._tag(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")) == F.lit(value)
        if is_number(value):
            return self._number(v) == F.lit(float(value))
        if isinstance(value, str):
            return self._string(v) == F.lit(value)
        return F.to_json(v) == F.lit(canonical(value))

    def equal(self, name: str, value: Any) -> Column:
        if name == "id":
            return F.col("id") == F.lit(value) if isinstance(value, str) else F.lit(False)
        return self._equals(self.member(name), value)

    def ordered(self, name: str, operator: str, value: Any) -> Column:
        if name == "id":
            left = F.col("id")
        else:
            left = self._number(self.member(name)) if is_number(value) else self._string(self.member(name))
        if is_number(value):
            return F.lit(False) if name == "id" else _compare(left, operator, F.lit(float(value)))
        return _compare(F.collate(left, "UNICODE"), operator, F.collate(F.lit(value), "UNICODE"))

    def contains(self, name: str, value: Any) -> Column:
        if name == "id":
            return F.col("id").contains(value) if isinstance(value, str) else F.lit(False)
        v = self.member(name)
        inside = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(self._equals(x, value), F.lit(False)))
        inside = F.when(self._tag(v).startswith("ARRAY"), inside)
        return F.coalesce(inside, self._string(v).contains(F.lit(value))) if isinstance(value, str) else inside

    def sort_keys(self, order: Order) -> list[Column]:
        """Between types the order of their JSON texts: negative numbers, strings, arrays, objects, other numbers, false, null, true; missing last."""
        if order.field == "id":
            keys = [F.collate(F.col("id"), "UNICODE")]
        else:
            v = self.member(order.field)
            tag, number = self._tag(v), self._number(v)
            rank = F.when(v.isNull(), None).when(number < 0, 0).when(tag == "STRING", 1).when(tag.startswith("ARRAY"), 2).when(tag.startswith("OBJECT"), 3).when(number >= 0, 4)
            rank = rank.when(tag == "VOID", 6).when(F.to_json(v) == "true", 7).otherwise(5)
            text = F.coalesce(self._string(v), F.when(tag.startswith("ARRAY") | tag.startswith("OBJECT"), F.to_json(v)))
            keys = [rank, number, F.collate(text, "UNICODE")]
        return [k.desc_nulls_first() if order.descending else k.asc_nulls_last() for k in keys]


def _json(c: Column) -> Column:
    """Canonical JSON of a nested column: keys sorted."""
    return F.to_json(F.parse_json(F.to_json(c)))


def _compare(a: Column, operator: str, b: Column) -> Column:
    return {"lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b}[operator]


def predicate(e: Any, form: Typed | Variants, positive: bool = True) -> Column:
    """positive: NULL may stand for false."""
    close = (lambda c: c) if positive else (lambda c: F.coalesce(c, F.lit(False)))
    match e:
        case Comparison(name, "eq", value):
            return close(form.equal(name, value))
        case Comparison(name, "ne", value):
            return ~F.coalesce(form.equal(name, value), F.lit(False))
        case Comparison(name, "in", values):
            return close(_one_of(form, name, values))
        case Comparison(name, "contains", value):
            return close(form.contains(name, value))
        case Comparison(name, operator, value):
            return close(form.ordered(name, operator, value))
        case And(parts) | Or(parts):
            out = predicate(parts[0], form, positive)
            for p in parts[1:]:
                more = predicate(p, form, positive)
                out = out & more if isinstance(e, And) else out | more
            return out
        case Not(part):
            return ~predicate(part, form, False)
    raise QueryError(f"not an expression: {e!r}")


def _one_of(form: Typed | Variants, name: str, values) -> Column:
    """isin where all candidates are plain values of the field's type, which is pushed; else an or of equalities."""
    kind = form.kind(name) if isinstance(form, Typed) else ""
    plain = (kind == "string" and not form.id_source and all(isinstance(v, str) for v in values)) or (kind == "string" and name != "id" and all(isinstance(v, str) for v in values)) or (kind == "number" and all(is_number(v) for v in values))
    if plain:
        return form.column(name).isin(list(values))
    out = form.equal(name, values[0])
    for v in values[1:]:
        out = out | form.equal(name, v)
    return out


def order_columns(order_by, form: Typed | Variants) -> list[Column]:
    """The keys asked for, then the id; ids that collate equal are ordered by their bytes."""
    keys = [k for o in order_by for k in form.sort_keys(o)]
    id_ = form.column("id")
    return [*keys, *([id_.asc()] if "id" in form.binary_safe else [F.collate(id_, "UNICODE").asc(), id_.asc()])]
