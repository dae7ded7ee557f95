"""Statistics of collections and of measured operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import id_bucket, percent_change

CELLS = 4096
#: Values of a cell that are not cut again, and cuts at most (each divides the range by CELLS, and a double has 64 bits).
FEW = 100_000
ROUNDS = 8
#: Wanted cells (a row for each group and share) that reach the driver.
MOST_HELD = 10_000


def bucket_stats(rows: DataFrame, id_: Column, size: Column, is_deleted: Column | None = None) -> DataFrame:
    """(bucket, records, tombstones, decoded_bytes) for each of the 256 buckets in use."""
    gone = F.count_if(is_deleted) if is_deleted is not None else F.lit(0).cast("long")
    return rows.groupBy(id_bucket(id_).alias("bucket")).agg(F.count(F.lit(1)).alias("records"), gone.alias("tombstones"), F.sum(size).cast("long").alias("decoded_bytes"))


def collection_stats(rows: DataFrame, size: Column, is_deleted: Column | None = None) -> DataFrame:
    gone = F.count_if(is_deleted) if is_deleted is not None else F.lit(0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("records"), gone.alias("tombstones"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("decoded_bytes"))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column for each share): the smallest value that at least that share of the group's values don't exceed. Exact.

    A group's range is cut into CELLS cells and only counted. The cell that holds a wanted rank is cut again as long as it has more than FEW
    values and they differ, so that values far from all others don't matter; then its values are counted by value. No group is gathered
    or sorted in one task, whatever its size.
    """
    given = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    span = given.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in shares.items()]))
    wanted = span.withColumn("share", asked).select(
        F.col("g").alias("wg"), F.col("share.k").alias("k"), "low", "high", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("share.p") * F.col("n")).cast("long")).alias("rank")
    )
    inside = F.col("g").eqNullSafe(F.col("wg")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    for _ in range(ROUNDS):
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * CELLS)).cast("int")
        counts = given.join(wanted, inside).groupBy("wg", "k", "rank", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        running = counts.withColumn("to", F.sum("n").over(Window.partitionBy("wg", "k").orderBy("cell")))
        hit = running.where((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("n")))
        wanted = hit.select("wg", "k", "low", "high", (F.col("rank") - F.col("to") + F.col("n")).alias("rank"), "n")
        # Cells of few groups go on as literals, so that no pass is made twice; those of many stay a table.
        held = wanted.limit(MOST_HELD + 1).collect()
        if len(held) <= MOST_HELD:
            crowded = any(r["n"] > FEW and r["low"] < r["high"] for r in held)
            wanted = F.broadcast(rows.sparkSession.createDataFrame(held, wanted.schema))
        else:
            crowded = not wanted.where((F.col("n") > FEW) & (F.col("low") < F.col("high"))).isEmpty()
        if not crowded:
            break
        wanted = wanted.drop("n")
    wanted = wanted.drop("n")
    few = given.join(wanted, inside).groupBy("wg", "k", "rank", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = few.withColumn("to", F.sum("n").over(Window.partitionBy("wg", "k").orderBy("v")))
    hit = placed.where((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("n")))
    return hit.groupBy(F.col("wg").alias(group)).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in shares])


def latency_summary(samples: DataFrame, case: str, elapsed: str, success: Column) -> DataFrame:
    """(case, operations, ok, failed, success_percent, p50, p95, mean): failed operations count, but not in times."""
    judged = samples.withColumn("__ok", F.coalesce(success, F.lit(True)))
    counts = judged.groupBy(case).agg(F.count(F.lit(1)).alias("operations"), F.count_if("__ok").alias("ok"), F.round(F.avg(F.when(F.col("__ok"), F.col(elapsed))), 3).alias("mean"))
    times = nearest_rank(judged.where("__ok"), case, elapsed, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(case, "__case")
    out = counts.join(times, F.col(case).eqNullSafe(F.col("__case")), "left")
    return out.select(case, "operations", "ok", (F.col("operations") - F.col("ok")).alias("failed"), F.round(F.col("ok") / F.col("operations") * 100, 2).alias("success_percent"), "p50", "p95", "mean")


def baseline_change(now: DataFrame, base: DataFrame, case: str, metrics: tuple[str, ...]) -> DataFrame:
    """Percent change of each metric by case."""
    renamed = base.select(F.col(case).alias("__case"), *[F.col(m).alias(f"__{m}") for m in metrics])
    return now.join(renamed, F.col(case) == F.col("__case")).select(case, *[percent_change(F.col(m), F.col(f"__{m}")).alias(f"{m}_change_percent") for m in metrics])


def unique_values(rows: DataFrame, field: str) -> DataFrame:
    """(value): the different values of a field in order, without missing and empty ones."""
    return rows.where(F.col(field).isNotNull() & (F.col(field) != "")).select(F.col(field).alias("value")).distinct().orderBy("value")


SMALL = ("few bytes", "few writes", "one writer", "many scans")
LARGE = ("many bytes", "many writes", "several writers", "many point reads")


def layout_advice(evidence: DataFrame) -> DataFrame:
    """evidence plus layout (snapshot or bucketed), confidence, estimated_bytes and reasons: which of two layouts more signals speak for, and which do."""
    size = F.col("document_count") * F.col("average_document_bytes")
    # The thresholds of the signals.
    one = [size <= 256 * 1024, F.col("writes_per_minute") <= 1, F.col("concurrent_writers") <= 1, F.col("scan_ratio") >= 0.35]
    two = [size >= 512 * 1024, F.col("writes_per_minute") >= 5, F.col("concurrent_writers") >= 2, F.col("point_read_ratio") >= 0.7]
    score = lambda tests: sum(t.cast("int") for t in tests)
    gap = F.abs(score(one) - score(two))
    return evidence.withColumns(
        {
            "layout": F.when(score(one) > score(two), "snapshot").otherwise("bucketed"),
            "confidence": F.when(gap >= 3, "high").when(gap >= 2, "medium").otherwise("low"),
            "estimated_bytes": size,
            "reasons": F.array_compact(F.array(*[F.when(t, name) for tests, names in ((one, SMALL), (two, LARGE)) for t, name in zip(tests, names, strict=True)])),
        }
    )
