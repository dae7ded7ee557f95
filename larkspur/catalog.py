"""What is configured: collections with their indexes and layouts, and who may read and write which scope."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .collection import Collection, check_name
from .operators.algebra import scopes_of
from .plans.ast import REFERENCE, Limits, QueryError
from .plans.planner import Index, check_indexes
from .sources.storage import Store


@dataclass(frozen=True)
class Definition:
    name: str
    indexes: tuple[Index, ...] = ()
    layout: str = "snapshot"
    binary_safe: tuple[str, ...] = ()

    def __post_init__(self):
        check_name(self.name)
        check_indexes(self.indexes)
        if self.layout not in ("snapshot", "bucketed"):
            raise QueryError(f"Not a layout: {self.layout}")


@dataclass(frozen=True)
class Catalog:
    """Definitions by name; a name that is defined twice is an error."""

    spark: SparkSession
    root: str
    definitions: dict[str, Definition] = field(default_factory=dict)
    limits: Limits = REFERENCE

    @staticmethod
    def of(spark: SparkSession, root: str, *definitions: Definition, limits: Limits = REFERENCE) -> Catalog:
        names = [d.name for d in definitions]
        if len(set(names)) != len(names):
            raise QueryError("A collection is defined twice")
        return Catalog(spark, root, {d.name: d for d in definitions}, limits)

    def index_configuration(self) -> dict[str, tuple[Index, ...]]:
        return {n: d.indexes for n, d in sorted(self.definitions.items()) if d.indexes}

    def store(self, scope: str, user: str, tenant: str | None = None, roles: tuple[str, ...] = (), right: str = "read") -> Store:
        """The scope's collections, if the user holds the right on it."""
        if (scope, right) not in scopes_of(user, tenant, roles):
            raise PermissionError(f"{user} may not {right} {scope}")
        return Store(self.spark, self.root, scope)

    def collection(self, store: Store, name: str) -> Collection:
        d = self.definitions[name]
        return store.collection(name, d.indexes, self.limits, d.binary_safe)


def parse_indexes(text: str) -> dict[str, tuple[Index, ...]]:
    """Index configuration from JSON: {"collection": [{"name", "fields", "mode", "include"}]}."""
    data = json.loads(text)
    if not isinstance(data, dict):
        raise QueryError("Index configuration must be an object")
    return {check_name(c): check_indexes([Index(i["name"], tuple(i["fields"]), i.get("mode", "equality"), tuple(i.get("include", ()))) for i in entries]) for c, entries in data.items()}
