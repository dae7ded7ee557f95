"""Mixing sources to target weights by Poisson replication.

A source of n documents that is to have the share w of N rows gets the mean repetition rate N * w / n. Each document's
count is the inverse of the Poisson distribution with its source's mean at a uniform number hashed from a seed and
the document's id (for a mean over WHOLE the sum of several such draws of equal smaller means, which has the same distribution);
the document is repeated so often, and all copies are shuffled by a second hash. The shares hold
in the mean, each document's count depends on nothing but its id and its source's rate, and a rerun gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, columns, partitions

#: Counts beyond STEPS have a probability under 1e-15 up to a rate of 40; rates over WHOLE are drawn as sums.
STEPS = 130
WHOLE = 32
BROADCAST_ROWS = 2_000


def uniform(seed: str, key: Column) -> Column:
    """In [0, 1): 52 bits of an MD5, exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, rows: float | None) -> DataFrame:
    """(source, draws, part, cdf): the mean is draws * part; cdf has the Poisson distribution of part.

    weights: shares by source; sources that it doesn't name get none. None: shares in proportion to n ** alpha.
    rows: rows wanted, None for as many as there are.
    """
    counts = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(share)
    shares = counts.withColumn("share", share)
    total = shares.agg(F.sum("share").alias("shares"), F.sum("n").alias("rows")).first()
    wanted = float(rows if rows is not None else total["rows"] or 0) if total["shares"] else 0.0
    mean = F.lit(wanted) * F.col("share") / F.lit(float(total["shares"] or 1.0)) / F.col("n")
    with_mean = shares.withColumn("mean", mean).withColumn("draws", F.greatest(F.ceil(F.col("mean") / WHOLE), F.lit(1)).cast("long"))
    with_mean = with_mean.withColumn("part", F.col("mean") / F.col("draws"))
    start = F.struct(F.exp(-F.col("part")).alias("p"), F.array(F.exp(-F.col("part"))).alias("cdf"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("part") / k.cast("double")).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("part") / k.cast("double"))).alias("cdf"),
    )
    return with_mean.select("source", "draws", "part", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["cdf"]).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, rows: float | None = None, seed: str = "mix", key: str = "doc_id", shuffle: bool = True) -> DataFrame:
    """docs, each row as often as drawn, plus replica long (from 0) and shuffle_key long.

    Rows are dealt to partitions by shuffle_key, and each partition is in the order of shuffle_key. Null sources are a source of their own. A null key is
    drawn as the text 'null'. Null, empty and long texts are rows as any other. Repeated rows draw the same count each, and rows that tie in shuffle_key stand in any
    order. An empty table gives no rows. Columns of docs named replica or shuffle_key are replaced; names that begin with __lk_ are reserved.
    A table of rates beyond BROADCAST_ROWS sources is joined by shuffle, where adaptive execution splits a hot source.
    """
    kept = columns(docs, {"replica", "shuffle_key"})
    table = rates(docs, weights, alpha, rows).select(F.col("source").alias("__lk_source"), F.col("draws").alias("__lk_draws"), F.col("cdf").alias("__lk_cdf"))
    few = docs.select("source").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    below = lambda u: F.size(F.filter("__lk_cdf", lambda c: c <= u)).cast("long")
    more = F.sequence(F.lit(1).cast("long"), F.col("__lk_draws") - 1)
    further = F.aggregate(more, F.lit(0).cast("long"), lambda n, k: n + below(uniform(seed, F.concat(F.lit("#"), k.cast("string"), F.lit("#"), F.col("__lk_name")))))
    drawn = (
        docs.select(*[F.col(f"`{c}`") for c in kept], name.alias("__lk_name"))
        .join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("__lk_source")))
        .withColumn("__lk_u", uniform(seed, F.col("__lk_name")))
        .withColumn("__lk_count", below(F.col("__lk_u")) + F.when(F.col("__lk_draws") > 1, further).otherwise(F.lit(0).cast("long")))
        .where(F.col("__lk_count") > 0)
    )
    copies = drawn.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(0).cast("long"), F.col("__lk_count") - 1)).alias("replica"))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name, F.lit("/"), F.col("replica").cast("string"))), 1, 15), 16, 10).cast("long")
    copies = copies.withColumn("shuffle_key", place)
    if not shuffle:
        return copies
    spark = docs.sparkSession
    return copies.repartition(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark, docs: DataFrame) -> DataFrame:
    """Whole documents, mixed and written in their new order; of what was written the columns that the SQL names."""
    return Tables(spark, "mix").cut(mix(docs)).select("doc_id", "source", "replica", "shuffle_key")


ORACLE = f"""
WITH counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS share FROM documents GROUP BY source),
means AS (SELECT source, (SELECT CAST(sum(n) AS DOUBLE) FROM counts) * share / (SELECT sum(share) FROM counts) / n AS mean FROM counts),
parts AS (SELECT source, greatest(CAST(ceil(mean / {WHOLE}) AS BIGINT), 1) AS draws, mean / greatest(ceil(mean / {WHOLE}), 1) AS part FROM means),
terms AS (SELECT source, draws, k, exp(-part + k * ln(part) - lgamma(k + 1)) AS p
    FROM parts, (SELECT unnest(range(0, {STEPS + 1})) AS k)),
cdf AS (SELECT source, draws, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
tables AS (SELECT source, any_value(draws) AS draws, list(c) AS cs FROM cdf GROUP BY source),
asked AS (SELECT r, doc_id, d.source, cs, unnest(range(0, draws)) AS draw
    FROM (SELECT doc_id, source, row_number() OVER () AS r FROM documents) d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT r, doc_id, source, len(list_filter(cs, lambda c: c <= CAST(CAST(('0x' || substr(md5('mix' || CASE draw WHEN 0 THEN '' ELSE '#' || draw || '#' END || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))
    AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS n FROM asked),
copies AS (SELECT doc_id, source, unnest(range(0, CAST(sum(n) AS BIGINT))) AS replica FROM drawn GROUP BY r, doc_id, source)
SELECT doc_id, source, replica, CAST(('0x' || substr(md5('mix/' || CAST(doc_id AS VARCHAR) || '/' || CAST(replica AS VARCHAR)), 1, 15)) AS BIGINT) AS shuffle_key FROM copies"""
