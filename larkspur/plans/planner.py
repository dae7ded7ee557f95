"""Access plans and their execution: point, the first index that fits, or scan. The predicate is always applied in full, so a plan never changes a result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ast import NAME, REFERENCE, REFUSED_NAMES, Comparison, Limits, Query, QueryError, check_fields, conjuncts, fields, validate
from .compile import Typed, Variants, order_columns, predicate

RANGES = frozenset(("eq", "lt", "lte", "gt", "gte"))
#: Candidate ids that are looked up by name; more are joined.
FEW_IDS = 1_000


@dataclass(frozen=True)
class Index:
    """mode equality: 1 to 4 key fields, each needs an eq; mode range: one field. include: fields that a covering read serves too."""

    name: str
    keys: tuple[str, ...]
    mode: str = "equality"
    include: tuple[str, ...] = ()

    def __post_init__(self):
        if not NAME.match(self.name):
            raise QueryError(f"Not an index name: {self.name!r}")
        if self.mode not in ("equality", "range"):
            raise QueryError(f"Not an index mode: {self.mode!r}")
        if not 1 <= len(self.keys) <= (4 if self.mode == "equality" else 1) or len(set(self.keys)) != len(self.keys):
            raise QueryError("An equality index has 1 to 4 different fields, a range index one")
        if any(not NAME.match(k) or k in REFUSED_NAMES for k in self.keys):
            raise QueryError("Not a field name for an index")
        if self.include:
            check_fields(self.include, 8, "covering index")
            if set(self.include) & set(self.keys):
                raise QueryError("A covering index can't include its keys")

    def serves(self, compared: list[Comparison]) -> tuple[Comparison, ...]:
        """The comparisons that a lookup in this index uses; none if it can't answer them."""
        if self.mode == "range":
            return tuple(c for c in compared if c.field == self.keys[0] and c.operator in RANGES)
        equal = {c.field: c for c in reversed(compared) if c.operator == "eq"}
        return tuple(equal[k] for k in self.keys) if equal.keys() >= set(self.keys) else ()


def check_indexes(indexes) -> tuple[Index, ...]:
    names = [i.name for i in indexes]
    if len(set(names)) != len(names):
        raise QueryError("Two indexes of a collection have one name")
    return tuple(indexes)


@dataclass(frozen=True)
class Plan:
    kind: str
    index: Index | None = None
    comparisons: tuple[Comparison, ...] = ()
    covering: bool = False

    @property
    def index_name(self) -> str | None:
        return self.index.name if self.index else None


def _primitive(value) -> bool:
    return value is None or isinstance(value, (str, bool, int, float))


def _names_one(where) -> bool:
    return isinstance(where, Comparison) and (where.field, where.operator) == ("id", "eq") and isinstance(where.value, str) and where.value != ""


def choose(query: Query, indexes=(), available=None) -> Plan:
    """By rule: a point if the whole predicate is id eq a non-empty string; else the first declared index whose keys are all compared; else a scan.

    available: names of the indexes that exist now; None: all. explain passes None, execution what the manifest holds.
    """
    if _names_one(query.where):
        return Plan("point")
    compared = [c for c in conjuncts(query.where) or () if _primitive(c.value)]
    index, used = next(((i, u) for i in indexes if (u := i.serves(compared))), (None, ()))
    if index is None or not (available is None or index.name in available):
        return Plan("scan")
    held = {"id", *index.keys, *index.include}
    return Plan("index", index, used, query.select is not None and held.issuperset(fields(query)) and held.issuperset(query.select))


@dataclass
class Result:
    """Rows, how they were reached, and how many documents were looked at (counted when asked)."""

    df: DataFrame
    plan: Plan
    _looked_at: DataFrame = field(repr=False)

    @property
    def scanned_documents(self) -> int:
        return self._looked_at.count()


def execute(source: DataFrame, query: Query, form: Typed | Variants, indexes=(), limits: Limits = REFERENCE, available=None, coverings: dict[str, DataFrame] | None = None) -> Result:
    """source: live documents. coverings: tables of postings by index (id, keys, included fields), sorted by key.

    An index that covers the query is read instead of the source. Of another one the postings in the compared range give the candidate ids, by which the
    source is read. Where no table is given the source is filtered. The predicate is applied to what was found in any case.
    A scan of more documents than maxScanDocuments, and more index candidates than that, are errors and not cut off; the
    count is one more than the bound at most. Without a bound nothing is counted. Rows are put in order if an order or a limit is asked for.
    """
    validate(query, limits)
    plan = choose(query, indexes, available)
    bound = query.max_scan or limits.scan_default
    postings = (coverings or {}).get(plan.index.name) if plan.kind == "index" else None
    covering = postings is not None and plan.covering
    keyed = form if postings is None else Typed(postings.schema, "id", None, form.binary_safe)
    base, reads = (postings, keyed) if covering else (source, form)
    looked_at = base if postings is None else postings
    if plan.kind == "index":
        for c in plan.comparisons:
            looked_at = looked_at.where(predicate(c, keyed))
    elif plan.kind == "point":
        looked_at = looked_at.where(predicate(query.where, form))
    if bound is not None and plan.kind != "point" and (n := looked_at.limit(bound + 1).count()) > bound:
        what = "Query scan contains" if plan.kind == "scan" else "Index gives"
        raise QueryError(f"{what} {'more than ' if n > bound else ''}{bound} documents, above the configured maximum of {bound}")
    if postings is not None and not covering:
        base = by_candidates(base, candidates(looked_at, form))
    out = base if query.where is None else base.where(predicate(query.where, reads))
    most = query.limit or limits.limit_default
    if query.order_by or most is not None:
        out = out.orderBy(*order_columns(query.order_by, reads))
    if most is not None:
        out = out.limit(most)
    return Result(project(out, query, reads), plan, looked_at)


def candidates(postings: DataFrame, form: Typed) -> DataFrame:
    """The ids of postings as values of the documents' id column; adaptive execution broadcasts them where they are few."""
    column = form.id_source or form.id_column
    return postings.select(F.col("id").cast(form.types[column]).alias(column))


def by_candidates(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The source's rows of the ids: up to FEW_IDS are a filter that the scan skips row groups by; more are joined."""
    column = ids.columns[0]
    few = [r[0] for r in ids.limit(FEW_IDS + 1).collect()]
    return source.where(F.col(column).isin(few)) if len(few) <= FEW_IDS else source.join(ids, column, "left_semi")


def project(df: DataFrame, query: Query, form: Typed | Variants) -> DataFrame:
    """id and the selected fields; all fields where none are selected. Fields that don't exist are left out."""
    id_ = form.column("id").alias("id")
    if isinstance(form, Variants):
        if query.select is None:
            return df
        return df.select(id_, *[form.member(n).alias(n) for n in query.select])
    names = [n for n in (query.select if query.select is not None else form.types) if n in form.types and n != form.id_column]
    return df.select(id_, *[F.col(f"`{n}`") for n in names])


def explain(query: Query, indexes=(), limits: Limits = REFERENCE) -> dict:
    """The plan by configuration alone; execution may still scan where an index doesn't exist yet."""
    validate(query, limits)
    plan = choose(query, indexes)
    return {"plan": plan.kind, "indexName": plan.index_name}
