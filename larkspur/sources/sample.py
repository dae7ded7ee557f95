"""A sample store, made by rule from a seed on the executors: products, customers, and orders whose items are priced by their products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of products, customers and orders.
SIZES = {"tiny": (128, 32, 96), "small": (512, 128, 512)}
CATEGORIES = ("audio", "books", "garden", "kitchen", "office", "outdoor")
STATES = ("pending", "paid", "shipped", "cancelled")


def _pick(seed: int, what: str, key: Column, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key), F.lit(n) if isinstance(n, int) else n)


def _one_of(seed: int, what: str, key: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (_pick(seed, what, key, len(names)) + 1).cast("int"))


def _date(seed: int, what: str, key: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + _pick(seed, what, key, 31_536_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select(
        F.format_string("product-%05d", k).alias("id"), F.format_string("SKU-%05d", k).alias("sku"), F.concat(F.lit("Product "), k.cast("string")).alias("name"), _one_of(seed, "category", k, CATEGORIES).alias("category"),
        (_pick(seed, "price", k, 20_000) + 100).alias("priceCents"), _pick(seed, "stock", k, 500).alias("stock"), (_pick(seed, "active", k, 10) > 0).alias("active"),
        F.array_distinct(F.array(*[_one_of(seed, f"tag{j}", k, ("new", "sale", "eco", "gift")) for j in range(2)])).alias("tags"), F.lit("A sample product.").alias("description"), _date(seed, "product", k).alias("createdAt"),
    )


def customers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    k = F.col("id")
    address = F.struct(F.concat((_pick(seed, "house", k, 99) + 1).cast("string"), F.lit(" Main Street")).alias("line1"), _one_of(seed, "city", k, ("Oslo", "Lyon", "Graz", "Cork")).alias("city"), F.format_string("%05d", _pick(seed, "post", k, 99_999)).alias("postalCode"), _one_of(seed, "country", k, ("NO", "FR", "AT", "IE")).alias("country"))
    return spark.range(n).select(
        F.format_string("customer-%05d", k).alias("id"), F.format_string("customer%d@example.com", k).alias("email"), F.concat(F.lit("Customer "), k.cast("string")).alias("name"),
        (_pick(seed, "opt", k, 2) == 0).alias("marketingOptIn"), _date(seed, "customer", k).alias("createdAt"), address.alias("address"),
    )


def orders(spark: SparkSession, n: int, n_products: int, n_customers: int, seed: int = 42) -> DataFrame:
    """Each order has 1 to 4 items; its total is the sum of quantity and price, the price by the product's own rule."""
    k = F.col("id")

    def item(j: Column) -> Column:
        key = F.concat_ws("/", k.cast("string"), j.cast("string"))
        product = _pick(seed, "item", key, n_products)
        return F.struct(F.format_string("product-%05d", product).alias("productId"), (_pick(seed, "quantity", key, 3) + 1).alias("quantity"), (_pick(seed, "price", product, 20_000) + 100).alias("priceCents"))

    items = F.transform(F.sequence(F.lit(1), (_pick(seed, "items", k, 4) + 1).cast("int")), item)
    total = F.aggregate("items", F.lit(0).cast("long"), lambda t, i: t + i["quantity"] * i["priceCents"])
    return spark.range(n).select(
        F.format_string("order-%06d", k).alias("id"), F.format_string("customer-%05d", _pick(seed, "buyer", k, n_customers)).alias("customerId"), _one_of(seed, "state", k, STATES).alias("status"), items.alias("items"), _date(seed, "order", k).alias("createdAt"),
    ).withColumn("totalCents", total)


def store(spark: SparkSession, size: str = "tiny", seed: int = 42) -> dict[str, DataFrame]:
    p, c, o = SIZES[size]
    return {"products": products(spark, p, seed), "customers": customers(spark, c, seed), "orders": orders(spark, o, p, c, seed)}
