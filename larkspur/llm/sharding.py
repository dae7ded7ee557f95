"""Sharding by extendible hashing: a directory indexed by hash-prefix bits.

A shard is a prefix of the 60-bit row hash. It starts as the empty prefix; only a shard whose bytes exceed the limit is
split on one more bit. The shard of a row is therefore its shortest prefix whose rows fit the limit. Sizes are summed
once at a depth a little beyond what even hashing needs; all shorter prefixes are sums of those. Prefixes that still
exceed the limit there are summed again, deeper, alone.

Everything here is DataFrame work. To find the shards only sums by prefix are shuffled; laying rows out shuffles them whole, once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, columns, partitions

BITS = 60
#: Bits summed at once beyond the depth that even hashing needs.
MARGIN = 4
#: A directory of at most so many rows (under 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
SALTS = 64


def row_hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def prefix(hash_: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", hash_, (F.lit(BITS) - depth).cast("int"))


def directory(sized: DataFrame, limit: int, tables: Tables) -> DataFrame:
    """(fine_depth, fine_prefix, depth, shard_prefix, shard_bytes, overflow) for all prefixes in use; sized: hash, n_bytes.

    overflow: at the last bit the rows still exceed the limit (their hashes are equal).
    """
    whole = sized.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    low, fine = -1, min(BITS, max(1, math.ceil(math.log2(max(1, whole / limit)))) + MARGIN)
    found, rest = None, sized
    while True:
        sums = rest.groupBy(prefix(F.col("hash"), fine).alias("fine_prefix")).agg(F.sum("n_bytes").alias("fine_bytes"))
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(low + 1), F.lit(fine)))).withColumn(
            "shard_prefix", F.call_function("shiftright", F.col("fine_prefix"), (F.lit(fine) - F.col("depth")).cast("int"))
        )
        fits = levels.groupBy("depth", "shard_prefix").agg(F.sum("fine_bytes").alias("shard_bytes")).where((F.col("shard_bytes") <= limit) | (F.col("depth") == fine))
        first = (
            levels.join(fits, ["depth", "shard_prefix"])
            .groupBy("fine_prefix")
            .agg(F.min(F.struct("depth", "shard_prefix", "shard_bytes")).alias("s"))
            .select(F.lit(fine).alias("fine_depth"), "fine_prefix", "s.*", (F.col("s.shard_bytes") > limit).alias("overflow"))
        )
        first = tables.cut(first)
        over = first.where("overflow")
        if fine == BITS or over.isEmpty():
            return first if found is None else found.unionByName(first)
        settled = first.where("not overflow")
        found = settled if found is None else found.unionByName(settled)
        rest = rest.join(over.select(F.col("fine_prefix").alias("p")), prefix(F.col("hash"), fine) == F.col("p"), "left_semi")
        low, fine = fine, min(BITS, fine + 8)


def shard(docs: DataFrame, limit: int, tables: Tables, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus shard_depth int, shard_prefix long, shard_page long, n_bytes long.

    The hash is of the key, or of the text where the key is null. n_bytes is the UTF-8 length of the text (null: 0).
    Three columns name a shard. shard_page is 0 but for rows that no bit can part: a row longer than the limit has a shard
    of its own (depth -1, page a number of the row), and rows of equal hash fill overflow pages, each within the limit; these numbers
    follow the partitioning of docs, since a stable count would need a group in one task. Repeated rows are kept, each in the shard of its hash, and ties stand in any order. Null and empty texts have no bytes.
    An empty table gives an empty result. Columns of docs named like an added one are replaced; names that begin with __lk_ are reserved.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    plain = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("t"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))))
    sized = docs.select(row_hash(plain).alias("hash"), size.alias("n_bytes")).where(F.col("n_bytes") <= limit)
    dirs = directory(sized, limit, tables)
    depths = [r[0] for r in dirs.select("fine_depth").distinct().collect()]  # one row for each round
    n = dirs.count()
    kept = columns(docs, {"shard_depth", "shard_prefix", "shard_page", "n_bytes"})
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size.alias("__lk_bytes"), row_hash(plain).alias("__lk_hash"))
    fits = rows.where(F.col("__lk_bytes") <= limit)
    side = dirs.select("fine_depth", *(F.col(c).alias(f"__lk_{c}") for c in ("fine_prefix", "depth", "shard_prefix", "overflow")))
    parts = []
    for depth in depths:
        here = side.where(F.col("fine_depth") == depth).drop("fine_depth")
        joined = fits.join(F.broadcast(here) if n <= BROADCAST_ROWS else here, prefix(F.col("__lk_hash"), depth) == F.col("__lk_fine_prefix")).drop("__lk_fine_prefix")
        parts.append(joined.where("not __lk_overflow").withColumn("__lk_page", F.lit(0).cast("long")))
        if depth == BITS:
            # Rows of one hash are dealt by text and turn, so that no task has all of them.
            salted = joined.where("__lk_overflow").withColumn("__lk_salt", F.pmod(F.xxhash64(F.col(f"`{text}`")) + F.monotonically_increasing_id(), F.lit(SALTS)))
            place = Window.partitionBy("__lk_hash", "__lk_salt").orderBy("__lk_bytes")
            # Pages hold as many rows of the largest size of their salt as fit, so a running count is enough.
            per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.max("__lk_bytes").over(Window.partitionBy("__lk_hash", "__lk_salt")))))
            parts.append(salted.withColumn("__lk_page", (F.floor((F.row_number().over(place) - 1) / per) * SALTS + F.col("__lk_salt")).cast("long")).drop("__lk_salt"))
    giants = rows.where(F.col("__lk_bytes") > limit).withColumns({"__lk_depth": F.lit(-1), "__lk_shard_prefix": F.col("__lk_hash"), "__lk_overflow": F.lit(True), "__lk_page": F.monotonically_increasing_id()})
    out = giants
    for p in parts:
        out = out.unionByName(p)
    made = {"shard_depth": F.col("__lk_depth").cast("int"), "shard_prefix": F.col("__lk_shard_prefix"), "shard_page": F.col("__lk_page").cast("long"), "n_bytes": F.col("__lk_bytes")}
    return out.select(*[F.col(f"`{c}`") for c in kept], *(v.alias(c) for c, v in made.items()))


SHARD = ("shard_depth", "shard_prefix", "shard_page")


def lay_out(sharded: DataFrame, path: str) -> DataFrame:
    """Whole rows of `shard` written as a folder for each shard with one file in it; what was written, with the columns of sharded."""
    spark = sharded.sparkSession
    schema = sharded.schema
    sharded.repartition(partitions(spark), *SHARD).sortWithinPartitions(*SHARD).write.partitionBy(*SHARD).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{c}`") for c in sharded.columns])


def query(spark, docs: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """Whole documents laid out in shards; of what was written the id, the shard and the size, with the shard's rows and bytes left to a group-by of the reader."""
    tables = Tables(spark, "shards")
    laid = lay_out(shard(docs, limit, tables), f"{tables.root}/rows")
    return laid.select("doc_id", *SHARD, "n_bytes")


#: The same by comparing all depths from 0 in turn (equal keys in numbers that overflow a shard don't occur in these tables).
def oracle(limit: int = 4 << 20, deepest: int = 20) -> str:
    return f"""
WITH rows_ AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
levels AS (SELECT r.*, CAST(d.depth AS INTEGER) AS depth, h >> CAST(60 - d.depth AS INTEGER) AS p
    FROM rows_ r, (SELECT unnest(range(0, {deepest})) AS depth) d WHERE n_bytes <= {limit}),
fits AS (SELECT depth, p FROM levels GROUP BY depth, p HAVING sum(n_bytes) <= {limit}),
best AS (SELECT doc_id, min(depth) AS depth FROM levels JOIN fits USING (depth, p) GROUP BY doc_id)
SELECT r.doc_id, b.depth AS shard_depth, r.h >> CAST(60 - b.depth AS INTEGER) AS shard_prefix, CAST(0 AS BIGINT) AS shard_page, r.n_bytes
FROM rows_ r JOIN best b USING (doc_id)"""
