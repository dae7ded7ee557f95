"""Collections: a DataFrame with an id, its indexes, and a builder of queries that never changes in place."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.lifecycle import RESERVED_FIELD
from .plans.ast import REFERENCE, And, Fields, Limits, Or, Order, Query, QueryError
from .plans.compile import Typed, Variants
from .plans.planner import Index, Result, check_indexes, execute, explain

COLLECTION_NAME = re.compile(r"[A-Za-z0-9._-]{1,128}\Z")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not COLLECTION_NAME.match(name) or name in (".", ".."):
        raise QueryError(f"Not a collection name: {name!r}")
    return name


@dataclass(frozen=True)
class Collection:
    """Live documents under a name. Build with `typed` or `variant`."""

    name: str
    df: DataFrame
    form: Typed | Variants
    indexes: tuple[Index, ...] = ()
    limits: Limits = REFERENCE
    coverings: dict = field(default_factory=dict)
    available: frozenset | None = None

    @staticmethod
    def typed(name: str, df: DataFrame, id_column: str = "id", indexes=(), limits: Limits = REFERENCE, binary_safe=(), integer_id: bool = False, **more) -> Collection:
        """integer_id: id_column holds integers, and their text is the id."""
        form = Typed(df.schema, id_column, id_column if integer_id else None, frozenset(binary_safe))
        return Collection(check_name(name), df, form, check_indexes(indexes), limits, **more)

    @staticmethod
    def variant(name: str, df: DataFrame, indexes=(), limits: Limits = REFERENCE) -> Collection:
        return Collection(check_name(name), df, Variants(), check_indexes(indexes), limits)

    def run(self, query: Query) -> Result:
        return execute(self.df, query, self.form, self.indexes, self.limits, self.available, self.coverings)

    def explain(self, query: Query) -> dict:
        return explain(query, self.indexes, self.limits)

    def get(self, id_: str) -> Row | None:
        """The document, or None. Ids of any text, the empty one included."""
        found = self.df.where(self.form.equal("id", id_)).limit(1).collect()
        return found[0] if found else None

    def scan(self) -> DataFrame:
        """All documents; in the order of their ids where the limits bound a scan."""
        return self.run(Query()).df if self.limits.limit_default is None else replace(self, limits=replace(self.limits, limit_default=None)).run(Query()).df

    def filter(self, test: Callable[..., bool] | Column, max_scan: int | None = None) -> DataFrame:
        """Documents that a Column, or a Python function of a row, accepts: a bounded scan without index, order or limit."""
        bound = max_scan or self.limits.scan_default
        if bound is not None and self.df.limit(bound + 1).count() > bound:
            raise QueryError(f"Query scan contains more than {bound} documents, above the configured maximum of {bound}")
        if isinstance(test, Column):
            return self.df.where(test)
        schema = self.df.schema

        def keep(frames):
            for f in frames:
                yield f[[bool(test(r)) for r in f.to_dict("records")]] if len(f) else f

        return self.df.mapInPandas(keep, schema)

    def where(self, build: Callable) -> Builder:
        return Builder(self).where(build)

    def order_by(self, *keys) -> Builder:
        return Builder(self).order_by(*keys)


@dataclass(frozen=True)
class Builder:
    collection: Collection
    query: Query = Query()

    def _with(self, **changes) -> Builder:
        return replace(self, query=self.query.with_(**changes))

    @staticmethod
    def _expression(build):
        return build(Fields()) if callable(build) else build

    def where(self, build) -> Builder:
        """And with what is there."""
        e, old = self._expression(build), self.query.where
        return self._with(where=e if old is None else And((old, e)))

    def or_where(self, build) -> Builder:
        """Or with everything that is there."""
        e, old = self._expression(build), self.query.where
        return self._with(where=e if old is None else Or((old, e)))

    @staticmethod
    def _order(key, direction: str) -> Order:
        if callable(key):
            key = key(Fields())
        return key if isinstance(key, Order) else Order(getattr(key, "name", key), direction == "desc")

    def order_by(self, key, direction: str = "asc") -> Builder:
        """Replaces the order."""
        return self._with(order_by=(self._order(key, direction),))

    def then_by(self, key, direction: str = "asc") -> Builder:
        return self._with(order_by=(*self.query.order_by, self._order(key, direction)))

    def take(self, n: int) -> Builder:
        return self._with(limit=n)

    def max_scan(self, n: int) -> Builder:
        return self._with(max_scan=n)

    def select(self, *names: str) -> Builder:
        return self._with(select=tuple(names))

    def to_json(self) -> str:
        return self.query.to_json()

    def explain(self) -> dict:
        return self.collection.explain(self.query)

    def run(self) -> Result:
        return self.collection.run(self.query)

    def get(self) -> DataFrame:
        return self.run().df


def validated(df: DataFrame, schema: T.StructType, id_column: str = "id", required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows cast to the schema, rows that fail with a reason): a value that doesn't cast, a required field that is missing, or no id."""
    reason = F.when(F.col(id_column).isNull() | (F.col(id_column).cast("string") == ""), F.lit(f"{id_column}: missing"))
    columns = []
    for f in schema.fields:
        if f.name not in df.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            if f.name in required:
                reason = F.coalesce(reason, F.lit(f"{f.name}: missing"))
            continue
        value = F.col(f"`{f.name}`")
        cast = value.try_cast(f.dataType)
        columns.append(cast.alias(f.name))
        reason = F.coalesce(reason, F.when(value.isNotNull() & cast.isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}")))
        if f.name in required:
            reason = F.coalesce(reason, F.when(value.isNull(), F.lit(f"{f.name}: missing")))
    judged = df.withColumn("__reason", reason)
    return judged.where(F.col("__reason").isNull()).select(*columns), judged.where(F.col("__reason").isNotNull()).select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col("__reason").alias("reason"))


__all__ = ["RESERVED_FIELD", "Builder", "Collection", "check_name", "validated"]
