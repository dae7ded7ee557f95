"""Whole collections against each other: equality, import modes, catalogs and grants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import QueryError


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_left, only_right) with numbers of rows; both 0 if the collections are equal.

    Both sides are counted together by one aggregation, where equal rows meet.
    """
    columns = a.columns
    both = a.withColumn("__side", F.lit(1)).unionByName(b.select(*columns).withColumn("__side", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("__side").alias("net"))
    return net.agg(F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("only_right"))


def import_into(target: DataFrame, source: DataFrame, key: str, mode: str) -> DataFrame:
    """create: the target must be empty; replace: the source alone; merge: by id, the source wins."""
    if mode == "create":
        if not target.isEmpty():
            raise QueryError("The target is not empty")
        return source
    if mode == "replace":
        return source
    if mode == "merge":
        return target.join(source.select(key), key, "left_anti").unionByName(source)
    raise QueryError(f"Not an import mode: {mode}")


def catalog_page(names: DataFrame, offset: int = 0, size: int = 20) -> DataFrame:
    """(name, next_offset): a page of different names in order; next_offset is NULL on the last page."""
    if not 1 <= size <= 20:
        raise QueryError("A page holds 1 to 20 names")
    distinct = names.select("name").distinct()
    more = distinct.count() > offset + size
    return distinct.orderBy("name").offset(offset).limit(size).select("name", F.lit(offset + size if more else None).cast("int").alias("next_offset"))


def numbered(rows: DataFrame, order: list, folder: str, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in a total order: ranges of the order are sorted apart and written, and each range adds the rows of those before it."""
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()  # range in the upper bits, place in the range in the lower 33
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__number", number)
    ordered.write.parquet(folder)
    ordered = spark.read.parquet(folder).withColumns({"__range": F.shiftright("__number", 33), "__within": F.col("__number").bitwiseAND((1 << 33) - 1)})
    sizes = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__range") < F.col("a.__range"), "left").groupBy(F.col("a.__range").alias("__of")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__before"))
    return ordered.join(F.broadcast(before), F.col("__range") == F.col("__of")).select(*rows.columns, (F.col("__before") + F.col("__within") + 1).cast("long").alias(name))


def readable(rows: DataFrame, scope: str, grants: DataFrame, right: str = "read") -> DataFrame:
    """rows with their scope granted; grants: scope, right."""
    allowed = grants.where(F.col("right") == right).select(F.col("scope").alias("__scope")).distinct()
    return rows.join(allowed, F.col(scope) == F.col("__scope"), "left_semi")


def scopes_of(user: str, tenant: str | None = None, roles: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(scope, right) pairs: the public scope is read; a user reads and writes their own; a tenant is read, and written or administered by role; a role is read."""
    out = [("public", "read"), (f"user:{user}", "read"), (f"user:{user}", "write")]
    if tenant:
        out.append((f"tenant:{tenant}", "read"))
        if "writer" in roles or "admin" in roles:
            out.append((f"tenant:{tenant}", "write"))
        if "admin" in roles:
            out.append((f"tenant:{tenant}", "admin"))
    return out + [(f"role:{r}", "read") for r in roles]


def grants_of(users: DataFrame) -> DataFrame:
    """(scope, right) of all users (user, tenant, roles array) by the same rule."""
    pair = lambda scope, right: F.struct(scope.alias("scope"), F.lit(right).alias("right"))
    tenant = F.concat(F.lit("tenant:"), "tenant")
    has = lambda *roles: F.col("tenant").isNotNull() & F.arrays_overlap("roles", F.array(*[F.lit(r) for r in roles]))
    own = F.array(
        pair(F.lit("public"), "read"), pair(F.concat(F.lit("user:"), "user"), "read"), pair(F.concat(F.lit("user:"), "user"), "write"), F.when(F.col("tenant").isNotNull(), pair(tenant, "read")),
        F.when(has("writer", "admin"), pair(tenant, "write")), F.when(has("admin"), pair(tenant, "admin")),
    )
    given = F.concat(own, F.transform("roles", lambda r: pair(F.concat(F.lit("role:"), r), "read")))
    return users.select(F.explode(F.filter(given, lambda g: g.isNotNull())).alias("g")).select("g.*").distinct()
