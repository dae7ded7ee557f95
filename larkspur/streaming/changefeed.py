"""Change logs: replay, compaction, and Structured Streaming upserts that ignore what is not newer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.storage import Store


def fold(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The latest row of each key by revision; max_by keeps a row for each key and task before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.col(revision)).alias("r")).select("r.*")


def replay(log: DataFrame, key: str, revision: str, deleted: str | None = None) -> DataFrame:
    """The state after all entries; keys whose last entry is a deletion are gone."""
    state = fold(log, key, revision)
    return state.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else state


def compact(snapshot: DataFrame | None, log: DataFrame, key: str, revision: str) -> DataFrame:
    """A snapshot and the entries after it as one snapshot at the last revision."""
    return fold(log if snapshot is None else snapshot.unionByName(log), key, revision)


def apply_newer(state: DataFrame, changes: DataFrame, key: str, revision: str) -> DataFrame:
    """state after changes; a change that is not newer than what the state holds of its key is dropped, so applying twice changes nothing."""
    return fold(state.unionByName(changes.select(*state.columns)), key, revision)


def stream_into(changes: DataFrame, store: Store, name: str, key: str, revision: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of changes into a stored collection, one commit for each batch, until all that is available is applied.

    A batch that is delivered again after a failure finds its rows in place and changes nothing.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        new = fold(batch, key, revision).withColumn("id", F.col(key).cast("string"))
        store.commit(name, lambda old: new if old is None else apply_newer(old.drop("bucket"), new, "id", revision), touched=new.select("id"))

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
