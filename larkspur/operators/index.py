"""Secondary indexes as tables: a row for each key tuple and id (postings), so that a frequent key is no large row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import Typed
from ..plans.planner import Index

#: Rows that one task compares by id, about.
ROWS_A_TASK = 500_000


def build(docs: DataFrame, index: Index, form: Typed) -> DataFrame:
    """(id, key fields, included fields) of all documents that have all keys as plain values. For covering reads this table is enough."""
    present = docs
    for k in index.keys:
        present = present.where(F.col(k).isNotNull()) if form.kind(k) in ("string", "number", "boolean", "time") else present.where(F.lit(False))
    return present.select(form.column("id").alias("id"), *[F.col(k) for k in (*index.keys, *index.include)])


def update(postings: DataFrame, changed: DataFrame, index: Index, form: Typed) -> DataFrame:
    """postings after a write. changed: the changed ids with their new documents (all fields NULL for a deletion)."""
    ids = changed.select(form.column("id").alias("id")).distinct()
    return postings.join(ids, "id", "left_anti").unionByName(build(changed, index, form))


def entries(postings: DataFrame, index: Index) -> DataFrame:
    """(key fields, ids): how many documents each key tuple has."""
    return postings.groupBy(*index.keys).agg(F.count(F.lit(1)).alias("ids"))


def write(postings: DataFrame, index: Index, path: str) -> None:
    """Sorted by key, so that Parquet's row-group statistics serve range lookups. A frequent key is dealt over several tasks, by id."""
    postings.repartitionByRange(*index.keys, "id").sortWithinPartitions(*index.keys, "id").write.mode("overwrite").parquet(path)


def stats(postings: DataFrame, index: Index) -> DataFrame:
    """(index_name, entries, ids) as one row."""
    return entries(postings, index).agg(F.lit(index.name).alias("index_name"), F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids")).select("index_name", "entries", "ids")


def dealt(postings: DataFrame, docs: DataFrame, index: Index, form: Typed) -> DataFrame:
    """(id, key fields, have, want): a row for each posting and for each one that the documents call for, dealt by id over as many tasks as their number asks for.

    Nothing is counted before: ids hardly repeat, so a task would hold every id of its part of a file.
    """
    side = lambda df, have, want: df.select("id", *index.keys, F.lit(have).cast("long").alias("have"), F.lit(want).cast("long").alias("want"))
    return side(postings, 1, 0).unionByName(side(build(docs, index, form), 0, 1)).repartition((postings.count() + docs.count()) // ROWS_A_TASK + 1, "id")


def integrity(postings: DataFrame, docs: DataFrame, index: Index, form: Typed) -> DataFrame:
    """(index_name, postings, missing, stale, twice) as one row: postings that the documents have and the index lacks, those that it has and they lack, and ids in two postings."""
    by_key = dealt(postings, docs, index, form).groupBy("id", *index.keys).agg(F.sum("have").alias("have"), F.sum("want").alias("want"))
    by_id = by_key.groupBy("id").agg(F.sum("have").alias("have"), F.sum(F.greatest(F.col("want") - F.col("have"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("have") - F.col("want"), F.lit(0))).alias("stale"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_id.agg(F.lit(index.name).alias("index_name"), total("have").alias("postings"), total("missing").alias("missing"), total("stale").alias("stale"), F.count_if(F.col("have") > 1).alias("twice"))


def over_bound(postings: DataFrame, index: Index, bound: int) -> DataFrame:
    """(key fields, ids, refused): whether a lookup of each key gives more candidates than the bound."""
    return entries(postings, index).withColumn("refused", F.col("ids") > bound)


def health(configured: dict[str, tuple[Index, ...]], active: dict[str, dict[str, tuple[Index, int]]]) -> list[dict]:
    """The state of every index by collection: active is what manifests hold, as name to (definition, entries)."""
    out = []
    for collection in sorted(set(configured) | set(active)):
        want = {i.name: i for i in configured.get(collection, ())}
        have = active.get(collection, {})
        for name in sorted(set(want) | set(have)):
            if name not in have:
                state = "missing"
            elif name not in want:
                state = "unknown"
            elif have[name][0] != want[name]:
                state = "mismatch"
            else:
                state = "empty" if have[name][1] == 0 else "ready"
            out.append({"collection": collection, "index_name": name, "state": state})
    return out
