"""Documents from and to JSON, CSV and JDBC, and checksummed NDJSON archives."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import QueryError


def to_documents(rows: DataFrame, id_field: str) -> DataFrame:
    """rows with a string id from id_field (strings or finite numbers). A present id that differs, and a missing one, raise when the rows are read."""
    value = F.col(f"`{id_field}`")
    text = value.cast("string")
    if isinstance(rows.schema[id_field].dataType, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.raise_error(F.lit(f"{id_field} is not finite"))).when(value == F.floor(value), F.floor(value).cast("string")).otherwise(text)
    checked = F.when(value.isNull() | (text == ""), F.raise_error(F.lit(f"{id_field} is missing"))).otherwise(text)
    if id_field != "id" and "id" in rows.columns:
        checked = F.when(F.col("id").isNotNull() & (F.col("id").cast("string") != text), F.raise_error(F.lit("id conflicts with the id field"))).otherwise(checked)
    return rows.select(checked.alias("id"), *[F.col(f"`{c}`") for c in rows.columns if c not in ("id", id_field)])


def read_json(spark: SparkSession, path: str, at: str = "", id_field: str = "id", schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """Documents of a JSON file: an array, or an array at a dotted path of an object. lines: each line is such a file, so that large ones are split between tasks."""
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    data = (reader.schema(schema) if schema else reader).json(path)
    if at:
        data = data.select(F.explode(F.col(".".join(f"`{p}`" for p in at.split(".")))).alias("d")).select("d.*")
    return to_documents(data, id_field)


def read_csv(spark: SparkSession, path: str, id_field: str = "id", multi_line: bool = True) -> DataFrame:
    """Documents of CSV files with one header of different, non-empty names. All values are strings; rows that are too short are filled with "", too long ones raise.

    A file of a folder whose header differs raises. multi_line False: no value holds a line break, so that large files are split between tasks.
    """
    header = spark.read.option("multiLine", multi_line).option("escape", '"').csv(path).limit(1).collect()
    names = [c for c in header[0]] if header else []
    if not names or any(not n for n in names) or len(set(names)) != len(names):
        raise QueryError("A CSV file needs a header of different, non-empty names")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("__bad", T.StringType())])
    rows = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").schema(schema).csv(path)
    cells = F.from_csv(F.col("__bad"), ", ".join(f"c{k} STRING" for k in range(len(names) + 1)), {"escape": '"'})
    extra = F.col("__bad").isNotNull() & cells[f"c{len(names)}"].isNotNull()
    first = F.when(extra, F.raise_error(F.lit("A CSV row is longer than the header"))).otherwise(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")))
    filled = rows.select(first.alias(names[0]), *[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names[1:]])
    return to_documents(filled, id_field)


def json_lines(docs: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, line): each document as canonical JSON with its id, missing fields left out."""
    line = F.to_json(F.parse_json(F.to_json(F.struct(F.col(id_column).alias("id"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("id", id_column)]))))
    return docs.select(F.col(id_column).alias("id"), line.alias("line"))


def write_json(docs: DataFrame, path: str, at: str = "") -> None:
    """A folder of JSON lines; with a dotted path each line is an object that holds its document in an array at that path, as read_json(lines=True) reads it."""
    line = F.col("line")
    if at:
        names = at.split(".")
        line = F.concat(F.lit("".join(f"{{{json.dumps(n)}:" for n in names) + "["), line, F.lit("]" + "}" * len(names)))
    json_lines(docs).select(line.alias("value")).write.mode("overwrite").text(path)


def header_fields(docs: DataFrame) -> DataFrame:
    """(field, place): the fields that any document has, by the place of the first document (in order of id) that has them, then by name."""
    keys = docs.select("id", F.explode(F.map_keys(F.from_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "id"])), "map<string,string>"))).alias("field"))
    return keys.groupBy("field").agg(F.min("id").alias("place"))


def csv_rows(docs: DataFrame) -> DataFrame:
    """All columns as text: NULL is empty, nested values are JSON."""
    plain = (T.StringType, T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
    return docs.select(*[F.coalesce(F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, plain) else F.to_json(f"`{f.name}`"), F.lit("")).alias(f.name) for f in docs.schema.fields])


def write_csv(docs: DataFrame, path: str) -> None:
    """A folder of CSV files: id, then the fields in the order of `header_fields`. Field names reach the driver, rows don't."""
    order = [r["field"] for r in header_fields(docs).orderBy("place", "field").collect()]
    csv_rows(docs.select("id", *[F.col(f"`{c}`") for c in order])).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, id_field: str, split_by: str | None = None, splits: int = 8, **options: str) -> DataFrame:
    """Documents of a query's rows. split_by: a number column by whose range the rows are read over `splits` connections; without it, over one."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if split_by is None:
        return to_documents(reader.option("query", query).load(), id_field)
    low, high = reader.option("query", f'SELECT min("{split_by}") AS low, max("{split_by}") AS high FROM ({query}) q').load().first()
    if low is None:
        return to_documents(spark.read.format("jdbc").option("url", url).options(**options).option("query", query).load(), id_field)
    split = {"dbtable": f"({query}) q", "partitionColumn": split_by, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(splits)}
    return to_documents(spark.read.format("jdbc").option("url", url).options(**options, **split).load(), id_field)


def write_jdbc(docs: DataFrame, url: str, table: str, scope: str, collection: str, mode: str = "create", **options: str) -> None:
    """Rows (scope, collection, id, document) in a table. create refuses a collection with rows; replace and merge (by id, the documents win) write over it.

    All tasks write to a table beside it; then one transaction of the database deletes what is replaced of this scope and collection and inserts the new
    rows. No other collection is read or written, and a failure leaves the table as it was. scope, collection and id are columns that the database can compare (VARCHAR).
    """
    if mode not in ("create", "replace", "merge"):
        raise QueryError(f"Not an import mode: {mode}")
    spark = docs.sparkSession
    staged = f"{table}_{uuid.uuid4().hex[:12]}"
    new = json_lines(docs).select(F.lit(scope).alias("scope"), F.lit(collection).alias("collection"), "id", F.col("line").alias("document"))
    new.write.format("jdbc").option("url", url).option("dbtable", staged).option("createTableColumnTypes", "scope VARCHAR(256), collection VARCHAR(256), id VARCHAR(1024)").options(**options).save()
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, str(v))
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    columns = ", ".join(json.dumps(c) for c in ("scope", "collection", "id", "document"))
    own = '"scope" = ? AND "collection" = ?'
    try:
        connection.setAutoCommit(False)

        def run(sql: str, *values: str):
            statement = connection.prepareStatement(sql)
            for k, v in enumerate(values, 1):
                statement.setString(k, v)
            return statement

        if mode == "create":
            found = run(f"SELECT count(*) FROM {table} WHERE {own}", scope, collection).executeQuery()
            found.next()
            if found.getLong(1):
                raise QueryError("The target is not empty")
        elif mode == "replace":
            run(f"DELETE FROM {table} WHERE {own}", scope, collection).executeUpdate()
        else:
            run(f'DELETE FROM {table} WHERE {own} AND "id" IN (SELECT "id" FROM {staged})', scope, collection).executeUpdate()
        run(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staged}").executeUpdate()
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.setAutoCommit(True)
        run(f"DROP TABLE {staged}").executeUpdate()
        connection.close()


def line_digest(lines: DataFrame) -> DataFrame:
    """(records, sha256) of an archive: SHA-256 over the digests of its 256 buckets, each over the digests of its lines in the order of ids.

    A tree of digests, so that no task hashes the whole archive and a bucket can be checked alone.
    """
    hashed = lines.select(F.substring(F.sha2("id", 256), 1, 2).alias("bucket"), F.substring(F.sha2("id", 256), 1, 5).alias("leaf"), "id", F.sha2("line", 256).alias("digest"))
    fold = lambda df, by, order: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda r: r["digest"]), ""), 256).alias("digest"))
    leaves = fold(hashed.withColumn("n", F.lit(1)), ("bucket", "leaf"), "id")
    buckets = fold(leaves, ("bucket",), "leaf")
    return fold(buckets, (), "bucket").select(F.coalesce("n", F.lit(0)).alias("records"), F.col("digest").alias("sha256"))


def export_archive(docs: DataFrame, path: str, name: str, includes_deleted: bool = False) -> dict:
    """NDJSON sorted by id in path/name, and its manifest entry."""
    if "/" in name or name.startswith("."):
        raise QueryError(f"Not a safe archive name: {name}")
    lines = json_lines(docs)
    lines.repartitionByRange("id").sortWithinPartitions("id").select(F.col("line").alias("value")).write.mode("overwrite").text(f"{path}/{name}")
    r = line_digest(lines).first()
    entry = {"name": name, "records": r["records"], "sha256": r["sha256"], "includesDeleted": includes_deleted}
    docs.sparkSession.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.manifest")
    return entry


def validate_archive(spark: SparkSession, path: str, name: str) -> dict:
    """The manifest entry of an archive whose lines agree with it; an error if not."""
    entry = json.loads(spark.read.text(f"{path}/{name}.manifest").first()[0])
    lines = spark.read.text(f"{path}/{name}").select(F.try_parse_json("value").alias("v"), F.col("value").alias("line"))
    if not lines.where(F.col("v").isNull()).isEmpty():
        raise QueryError(f"{name}: a line is not JSON")
    ids = lines.select(F.try_variant_get("v", "$.id", "string").alias("id"), "line")
    r = line_digest(ids).first()
    if r["records"] != entry["records"] or r["sha256"] != entry["sha256"]:
        raise QueryError(f"{name}: the lines don't agree with the manifest")
    if not ids.groupBy("id").count().where("count > 1").isEmpty():
        raise QueryError(f"{name}: an id occurs twice")
    return entry
