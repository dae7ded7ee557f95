"""Connected components by alternating large and small stars: every round is a few joins, and the edges only get fewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: So many edges (16 bytes each) fit one partition; a smaller graph needs no shuffle.
ONE_PARTITION = 200_000


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """edges: u, v long -> (node, label): the smallest node reachable, for every node that is not the smallest of its component.

    Edges may be repeated, in either direction, or lead to their own start; edges with a null end link nothing. No edges, no rows. Other columns are not read.
    """
    table = tables.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = _mark(table)
    while mark[0]:
        together = (lambda df: df.coalesce(1)) if mark[0] <= ONE_PARTITION else (lambda df: df)
        now = together(table)
        both = together(now.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(now.select(F.col("b").alias("x"), F.col("a").alias("y"))))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.withColumnRenamed("m", "b")).distinct()
        after = tables.cut(together(small))
        tables.drop(table)
        table, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return table.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
