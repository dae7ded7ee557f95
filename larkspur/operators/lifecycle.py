"""Writes as DataFrame functions. Stored rows are documents plus deleted_at, restore_until and purge_after (all NULL for live ones)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import QueryError

MARKS = ("deleted_at", "restore_until", "purge_after")
RESTORE = timedelta(days=30)
GRACE = timedelta(days=7)
BATCH_MOST = 20
#: Marks a stored deletion; documents can't have a field of that name.
RESERVED_FIELD = "__larkspur_deleted"


def stored(docs: DataFrame) -> DataFrame:
    """Live documents as stored rows."""
    return docs.withColumns({m: F.lit(None).cast("timestamp_ntz") for m in MARKS})


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("deleted_at").isNull()).drop(*MARKS)


def latest(changes: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key. max_by keeps one row for each key and task before the shuffle."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.col(position)).alias("r")).select("r.*")


def put_many(rows: DataFrame, changes: DataFrame, key: str, position: str) -> DataFrame:
    """rows after upserts; of several changes of an id the last position counts, and an upsert revives a deleted id. The reserved field is refused."""
    refuse_reserved(changes)
    new = stored(latest(changes, key, position).drop(position))
    return rows.join(new.select(key), key, "left_anti").unionByName(new.select(*rows.columns))


def _at(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp_ntz")


def _flagged(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    chosen = ids.select(F.col(key).alias("__id")).distinct()
    return rows.join(chosen, F.col(key) == F.col("__id"), "left").withColumn("__hit", F.col("__id").isNotNull()).drop("__id")


def _mark(rows: DataFrame, test: Column, now, restore: timedelta, grace: timedelta) -> DataFrame:
    at = _at(now)
    until, purge = at + F.lit(restore), at + F.lit(restore + grace)
    values = dict(zip(MARKS, (at, until, purge), strict=True))
    return rows.withColumns({m: F.when(test, v).otherwise(F.col(m)) for m, v in values.items()})


def delete(rows: DataFrame, ids: DataFrame, key: str, now, restore: timedelta = RESTORE, grace: timedelta = GRACE) -> DataFrame:
    """Live rows of the ids become deletions that can be restored for a while; deleted ones keep their dates."""
    return _mark(_flagged(rows, ids, key), F.col("__hit") & F.col("deleted_at").isNull(), now, restore, grace).drop("__hit")


def erase_all(rows: DataFrame, now, restore: timedelta = RESTORE, grace: timedelta = GRACE) -> DataFrame:
    return _mark(rows, F.col("deleted_at").isNull(), now, restore, grace)


def restore(rows: DataFrame, ids: DataFrame, key: str, now) -> DataFrame:
    """Deleted rows of the ids that may still be restored become live."""
    back = F.col("__hit") & F.col("deleted_at").isNotNull() & (F.col("restore_until") >= _at(now))
    flagged = _flagged(rows, ids, key).withColumn("__back", F.coalesce(back, F.lit(False)))
    return flagged.withColumns({m: F.when(~F.col("__back"), F.col(m)) for m in MARKS}).drop("__hit", "__back")


def purge(rows: DataFrame, now) -> DataFrame:
    """Without deletions whose time is over."""
    return rows.where(F.col("deleted_at").isNull() | (F.col("purge_after") > _at(now)))


def deleted(rows: DataFrame, key: str, most: int | None = 1_000) -> DataFrame:
    """Deletions in the order of their ids."""
    out = rows.where(F.col("deleted_at").isNotNull()).orderBy(key)
    return out.limit(most) if most else out


def retained_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("deleted_at").isNotNull()).alias("retained"))


def replaced_ids(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Ids that a replacement by `new` removes."""
    return rows.join(new.select(key), key, "left_anti").select(key)


def replace_all(rows: DataFrame, new: DataFrame, key: str, now, restore: timedelta = RESTORE, grace: timedelta = GRACE) -> DataFrame:
    """rows after a replacement: `new` is live, live rows of other ids become deletions, and deletions of other ids keep their dates."""
    refuse_reserved(new)
    others = rows.join(new.select(key), key, "left_anti").select(*rows.columns)
    return erase_all(others, now, restore, grace).unionByName(stored(new).select(*rows.columns))


def duplicate_ids(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def refuse_reserved(docs: DataFrame) -> None:
    if RESERVED_FIELD in docs.columns:
        raise QueryError(f"{RESERVED_FIELD} is reserved")


def judge_batches(changes: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch, documents, refused): why a batch of changes isn't applied (too many, without id, one id twice), NULL if it is.

    A batch holds 1 to BATCH_MOST documents with different non-empty ids. Counted by batch and id first, so that a huge batch is no large group.
    """
    id_ = F.col(key).cast("string")
    by_id = changes.groupBy(F.col(batch).alias("batch"), F.when(id_ != "", id_).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counted = by_id.groupBy("batch").agg(F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("bare"), F.max(F.when(F.col("id").isNotNull(), F.col("n"))).alias("most"))
    refused = F.when(F.col("documents") > BATCH_MOST, "too many").when(F.col("bare") > 0, "without id").when(F.col("most") > 1, "one id twice")
    return counted.select("batch", "documents", refused.alias("refused"))


def apply_batches(rows: DataFrame, changes: DataFrame, batch: str, key: str, position: str) -> DataFrame:
    """rows after all batches that are not refused, in the order of position; a refused batch changes nothing."""
    accepted = judge_batches(changes, batch, key).where("refused IS NULL").select(F.col("batch").alias(batch))
    return put_many(rows, changes.join(accepted, batch, "left_semi").select(*[c for c in changes.columns if c != batch]), key, position)


def check_batch(documents: list[dict], reserved: str = RESERVED_FIELD) -> list[dict]:
    """The batch itself, or an error: 1 to BATCH_MOST documents with different non-empty ids and without the reserved field."""
    if not 1 <= len(documents) <= BATCH_MOST:
        raise QueryError(f"A batch holds 1 to {BATCH_MOST} documents")
    ids = [d.get("id") for d in documents]
    if any(not isinstance(i, str) or not i for i in ids):
        raise QueryError("A document needs an id")
    if len(set(ids)) != len(ids):
        raise QueryError("Two documents of a batch have one id")
    if any(reserved in d for d in documents):
        raise QueryError(f"{reserved} is reserved")
    return documents
