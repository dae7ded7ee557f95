"""The queries of the document engine over the test tables, each with the SQL that gives the same rows in DuckDB.

Tables are typed collections whose integer keys, as text, are the ids. Whole tables are queried with the ANALYTIC limits; the queries that show limits use
the default ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .collection import Collection, validated
from .functions.values import canonical_json, content_key, id_bucket, percent_change, seal, unseal, url_component
from .operators import algebra, index, lifecycle, stats
from .plans.ast import ANALYTIC, REFERENCE, Limits, Query, QueryError, from_json
from .plans.planner import Index
from .sources import files
from .sources.storage import Conflict, Store
from .streaming import changefeed

NOW = "2024-06-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


ORDER_INDEXES = (Index("by-status", ("o_orderstatus",)), Index("by-status-priority", ("o_orderstatus", "o_orderpriority")), Index("by-price", ("o_totalprice",), "range", ("o_orderstatus",)), Index("by-customer", ("o_custkey",), "equality", ("o_totalprice",)))
SAFE = ("o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name", "p_name", "p_brand", "p_type", "event_type", "source", "lang", "s_name", "n_name", "r_name")


def orders(s, d, limits: Limits = ANALYTIC, indexes=ORDER_INDEXES) -> Collection:
    return Collection.typed("orders", table(s, d, "orders"), "o_orderkey", indexes, limits, SAFE, integer_id=True)


def parts(s, d, limits: Limits = ANALYTIC) -> Collection:
    df = table(s, d, "part").withColumn("tags", F.split("p_name", " "))
    return Collection.typed("parts", df, "p_partkey", (), limits, SAFE, integer_id=True)


def customers(s, d, limits: Limits = ANALYTIC) -> Collection:
    return Collection.typed("customers", table(s, d, "customer"), "c_custkey", (), limits, SAFE, integer_id=True)


ORDER_COLUMNS = "CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def work_folder(s: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    base = s.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: dict[tuple, dict[str, DataFrame]] = {}


def order_postings(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The postings of the orders' indexes as stored tables, written once for each application and folder, as an index is built once and asked often."""
    key = (s.sparkContext.applicationId, d)
    if key not in _stored:
        base, folder, made = orders(s, d), work_folder(s, "indexes"), {}
        for i in ORDER_INDEXES:
            index.write(index.build(base.df, i, base.form), i, f"{folder}/{i.name}")
            made[i.name] = s.read.parquet(f"{folder}/{i.name}")
        _stored[key] = made
    return _stored[key]


def indexed_orders(s: SparkSession, d: str, limits: Limits = ANALYTIC, indexes=ORDER_INDEXES) -> Collection:
    base = orders(s, d, limits, indexes)
    return Collection("orders", base.df, base.form, base.indexes, limits, order_postings(s, d))


# Scans and point reads


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000 AND o_totalprice < 200000 ORDER BY o_totalprice DESC NULLS FIRST, id LIMIT 25")
def flagship(s, d):
    """Filter, order, limit and projection over a collection."""
    q = orders(s, d).where(lambda o: o.o_orderstatus.eq("P")).where(lambda o: o.o_totalprice.gte(100000)).where(lambda o: o.o_totalprice.lt(200000))
    return q.order_by("o_totalprice", "desc").take(25).select("o_orderstatus", "o_totalprice").get()


@query(f"SELECT {ORDER_COLUMNS} FROM orders WHERE o_orderkey = 77")
def point_get(s, d):
    return orders(s, d, REFERENCE).where(lambda o: o.id.eq("77")).get()


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_all(s, d):
    return Collection.typed("suppliers", table(s, d, "supplier"), "s_suppkey", (), ANALYTIC, SAFE, integer_id=True).scan()


@query("SELECT s_nationkey, count(*) AS documents, count(*) > 30 AS refused FROM supplier GROUP BY s_nationkey")
def scan_bounded(s, d):
    """A scan of each nation's suppliers under a bound of 30 documents: refused where there are more."""
    limits = Limits(scan_default=30)
    suppliers = table(s, d, "supplier")
    found = []
    for r in suppliers.select("s_nationkey").distinct().collect():  # 25 nations
        c = Collection.typed("suppliers", suppliers.where(F.col("s_nationkey") == r[0]), "s_suppkey", (), limits, SAFE, integer_id=True)
        try:
            c.where(lambda x: x.s_suppkey.gte(0)).get()
            found.append((r[0], False))
        except QueryError:
            found.append((r[0], True))
    refused = s.createDataFrame(found, "s_nationkey long, refused boolean")
    return suppliers.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(refused), "s_nationkey")


def stored_orders(s, d) -> DataFrame:
    """Orders as stored rows; those of an id that ends in 3 are deleted, at the date of the order."""
    rows = table(s, d, "orders").withColumn("deleted_at", F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderdate")))
    return rows.withColumns({"restore_until": F.col("deleted_at") + F.expr("INTERVAL 30 DAYS"), "purge_after": F.col("deleted_at") + F.expr("INTERVAL 37 DAYS")})


STORED = "(SELECT *, CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate END AS deleted_at, CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate + INTERVAL 30 DAY END AS restore_until, CASE WHEN o_orderkey % 10 = 3 THEN o_orderdate + INTERVAL 37 DAY END AS purge_after FROM orders)"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, deleted_at, purge_after FROM {STORED}")
def stored_export(s, d):
    """Stored rows, deletions too, as the store holds them."""
    store = Store(s, work_folder(s, "export"))
    rows = stored_orders(s, d).select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice", "deleted_at", "restore_until", "purge_after")
    store.commit("orders", lambda old: rows)
    return store.read("orders").select("id", "o_totalprice", "deleted_at", "purge_after")


@query(f"SELECT count(*) AS records, count(deleted_at) AS tombstones, true AS refused FROM {STORED}")
def stored_bounded(s, d):
    """The manifest's counts refuse a read of more records or deletions than allowed before anything is read."""
    store = Store(s, work_folder(s, "bounded"))
    rows = stored_orders(s, d).select(F.col("o_orderkey").cast("string").alias("id"), "deleted_at", "restore_until", "purge_after")
    head = store.commit("orders", lambda old: rows, layout="bucketed")
    refused = 0
    for most, gone in ((head.records - 1, head.tombstones), (head.records, head.tombstones - 1)):
        try:
            store.bounded("orders", most, gone)
        except QueryError:
            refused += 1
    back = store.bounded("orders", head.records, head.tombstones)
    return back.agg(F.count(F.lit(1)).alias("records"), F.count("deleted_at").alias("tombstones"), F.lit(refused == 2).alias("refused"))


@query(f"SELECT o_orderkey, o_totalprice FROM {STORED} WHERE deleted_at IS NULL")
def visible_rows(s, d):
    return lifecycle.live(stored_orders(s, d)).select("o_orderkey", "o_totalprice")


# Predicates


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_eq(s, d):
    return orders(s, d).where(lambda o: o.o_orderpriority.eq("1-URGENT")).select("o_orderpriority").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, seen FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS seen FROM orders) WHERE seen IS DISTINCT FROM '1-URGENT'")
def filter_ne(s, d):
    """True where the field is missing."""
    df = table(s, d, "orders").withColumn("seen", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")))
    return Collection.typed("orders", df, "o_orderkey", (), ANALYTIC, SAFE, integer_id=True).where(lambda o: o.seen.ne("1-URGENT")).select("o_orderstatus", "seen").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_totalprice > 5000.5 AND o_totalprice <= 90000")
def filter_range_num(s, d):
    return orders(s, d).where(lambda o: o.o_totalprice.gt(5000.5)).where(lambda o: o.o_totalprice.lte(90000)).select("o_totalprice").get()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'")
def filter_range_str(s, d):
    """In collation order, without the declaration that the field is binary-safe."""
    c = Collection.typed("customers", table(s, d, "customer"), "c_custkey", (), ANALYTIC, (), integer_id=True)
    return c.where(lambda c: c.c_mktsegment.gte("BUILDING")).where(lambda c: c.c_mktsegment.lt("HOUSEHOLD")).select("c_mktsegment").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (1, 2, 3, 5, 8, 13)")
def filter_in(s, d):
    return orders(s, d).where(lambda o: o.o_orderstatus.in_(["F", "P"])).where(lambda o: o.o_custkey.in_([1, 2, 3, 5, 8, 13])).select("o_orderstatus", "o_custkey").get()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name FROM part WHERE contains(p_name, 'red w')")
def contains_string(s, d):
    return parts(s, d).where(lambda p: p.p_name.contains("red w")).select("p_name").get()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def contains_array(s, d):
    return parts(s, d).where(lambda p: p.tags.contains("ring")).select("p_name").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE (o_orderstatus = 'O' OR NOT (o_totalprice < 400000)) AND NOT (o_orderpriority = '5-LOW' AND o_orderstatus <> 'P')")
def bool_nested(s, d):
    return Collection.run(orders(s, d), from_json({"version": 1, "where": {"and": [
        {"or": [{"field": "o_orderstatus", "operator": "eq", "value": "O"}, {"not": {"field": "o_totalprice", "operator": "lt", "value": 400000}}]},
        {"not": {"and": [{"field": "o_orderpriority", "operator": "eq", "value": "5-LOW"}, {"field": "o_orderstatus", "operator": "ne", "value": "P"}]}}]}}, ANALYTIC).with_(select=("o_orderstatus", "o_totalprice", "o_orderpriority"))).df


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_totalprice FROM orders WHERE (o_orderstatus = 'P' AND o_totalprice > 300000) OR o_custkey = 7 ORDER BY o_orderstatus, o_totalprice DESC NULLS FIRST, id LIMIT 40")
def fluent_query(s, d):
    q = orders(s, d).where(lambda o: o.o_orderstatus.eq("P")).where(lambda o: o.o_totalprice.gt(300000)).or_where(lambda o: o.o_custkey.eq(7))
    return q.order_by("o_orderstatus").then_by("o_totalprice", "desc").take(40).select("o_orderstatus", "o_totalprice").get()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_acctbal FROM customer")
def projection(s, d):
    """Fields that don't exist are left out."""
    return customers(s, d).order_by("c_name").select("c_name", "c_acctbal", "nothing").get()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE length(c_name) + c_nationkey > 30 AND c_acctbal < 0")
def local_filter(s, d):
    return customers(s, d).filter((F.length("c_name") + F.col("c_nationkey") > 30) & (F.col("c_acctbal") < 0)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT CAST(event_id AS VARCHAR) AS id, 'k: not int' AS reason FROM events WHERE event_id % 4 = 1 UNION ALL SELECT CAST(event_id AS VARCHAR), 'k: missing' FROM events WHERE event_id % 4 = 2")
def schema_validate(s, d):
    """The rows that a declared schema refuses, with reasons."""
    from pyspark.sql import types as T

    raw = table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 4 == 1, "x").when(F.col("event_id") % 4 != 2, F.get_json_object("props", "$.k")).alias("k"))
    return validated(raw, T.StructType([T.StructField("id", T.StringType()), T.StructField("k", T.IntegerType())]), required=("k",))[1]


def props(s, d) -> Collection:
    """Events as VARIANT documents with a field that is a number, a string, true, null or missing."""
    text = F.when(F.col("event_id") % 5 == 0, F.format_string('{"v":%s,"n":%s}', F.col("value").cast("string"), F.col("event_id").cast("string")))
    text = text.when(F.col("event_id") % 5 == 1, F.format_string('{"v":"%s"}', "event_type")).when(F.col("event_id") % 5 == 2, F.lit('{"v":true}')).when(F.col("event_id") % 5 == 3, F.lit('{"v":null}')).otherwise(F.lit("{}"))
    return Collection.variant("props", table(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.parse_json(text).alias("doc")), (), ANALYTIC)


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 5 = 3")
def variant_null(s, d):
    """eq null finds explicit nulls and no missing fields."""
    return props(s, d).where(lambda e: e.v.eq(None)).get().select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE NOT (event_id % 5 = 0 AND value >= 10) AND NOT (event_id % 5 = 1 AND event_type = 'click')")
def variant_mixed(s, d):
    """Ranges hold within one type only; not and ne are true for missing fields."""
    from .plans.ast import Comparison, Not

    return props(s, d).where(Not(Comparison("v", "gte", 10))).where(lambda e: e.v.ne("click")).get().select("id")


@query("SELECT id, row_number() OVER (ORDER BY r, n, t, id) AS place FROM (SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE 9 END AS r, CASE WHEN event_id % 5 = 0 THEN value END AS n, CASE WHEN event_id % 5 = 1 THEN event_type END AS t FROM events)")
def variant_order(s, d):
    """The place of every document: strings before numbers before null before true before missing."""
    from .plans.ast import Order
    from .plans.compile import Variants, order_columns

    named = [F.col("id")]
    keys = order_columns((Order("v"),), Variants())
    rows = props(s, d).df.select("id", "doc")
    return algebra.numbered(rows, keys or named, work_folder(s, "order")).select("id", "place")


# Order and limits


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, o_totalprice, id LIMIT 200")
def order_multi(s, d):
    return orders(s, d).order_by("o_orderstatus").then_by("o_orderpriority", "desc").then_by("o_totalprice").take(200).select("o_orderstatus", "o_orderpriority", "o_totalprice").get()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, rating FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS rating FROM customer) ORDER BY rating DESC NULLS FIRST, id LIMIT 300")
def order_desc(s, d):
    """Missing first where descending."""
    df = table(s, d, "customer").withColumn("rating", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return Collection.typed("customers", df, "c_custkey", (), ANALYTIC, SAFE, integer_id=True).order_by("rating", "desc").take(300).select("rating").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, id LIMIT 500")
def order_ties(s, d):
    """Ties in ascending order of ids, also where the key descends."""
    return orders(s, d).order_by("o_orderstatus", "desc").take(500).select("o_orderstatus").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY id LIMIT 100")
def limit_default(s, d):
    """Without an order and a limit: the first 100 by id."""
    limits = Limits(scan_default=None, scan_most=None)
    return orders(s, d, limits).where(lambda o: o.o_totalprice.gt(1000)).select("o_totalprice").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderdate, id LIMIT 10")
def top_k(s, d):
    return orders(s, d).order_by("o_totalprice", "desc").then_by("o_orderdate").take(10).select("o_totalprice", "o_orderdate").get()


@query("SELECT name, CASE WHEN total > 25 THEN 25 END AS next_offset FROM (SELECT name, count(*) OVER () AS total FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT s_name FROM supplier)) ORDER BY name LIMIT 20 OFFSET 5")
def catalog_page(s, d):
    names = table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name"))).unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name")))
    return algebra.catalog_page(names, 5, 20)


# Indexes


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_orderdate FROM orders WHERE o_custkey = 11")
def index_equality(s, d):
    """The postings of the key give the ids, and the orders are joined with them."""
    r = indexed_orders(s, d).where(lambda o: o.o_custkey.eq(11)).select("o_custkey", "o_orderdate").run()
    assert r.plan.kind == "index" and not r.plan.covering
    return r.df


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")
def index_composite(s, d):
    q = indexed_orders(s, d, indexes=(ORDER_INDEXES[1],)).where(lambda o: o.o_orderstatus.eq("P")).where(lambda o: o.o_orderpriority.eq("2-HIGH")).select("o_orderstatus", "o_totalprice")
    assert q.explain() == {"plan": "index", "indexName": "by-status-priority"}
    return q.get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, o_custkey FROM orders WHERE o_totalprice >= 250000 AND o_totalprice < 250500")
def index_range(s, d):
    """The sorted postings of the range give the ids."""
    return indexed_orders(s, d).where(lambda o: o.o_totalprice.gte(250000)).where(lambda o: o.o_totalprice.lt(250500)).select("o_totalprice", "o_custkey").get()


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice >= 250000 AND o_totalprice < 260000 AND o_orderstatus = 'F'")
def index_covering(s, d):
    """Served by the index's table alone."""
    q = indexed_orders(s, d, indexes=(ORDER_INDEXES[2],)).where(lambda o: o.o_totalprice.gte(250000)).where(lambda o: o.o_totalprice.lt(260000)).where(lambda o: o.o_orderstatus.eq("F"))
    r = q.select("o_totalprice", "o_orderstatus").run()
    assert r.plan.covering
    return r.df


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, o_orderdate FROM orders WHERE o_totalprice >= 250000 AND o_totalprice < 260000")
def index_uncovered(s, d):
    """A field that the index lacks: whole documents are joined with the candidates."""
    r = indexed_orders(s, d, indexes=(ORDER_INDEXES[2],)).where(lambda o: o.o_totalprice.gte(250000)).where(lambda o: o.o_totalprice.lt(260000)).select("o_totalprice", "o_orderdate").run()
    assert r.plan.kind == "index" and not r.plan.covering
    return r.df


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS ids, count(*) > 500 AS refused FROM orders GROUP BY ALL")
def index_candidate_cap(s, d):
    """Keys whose postings are more than a bound of 500 candidates; a lookup of the most frequent one is an error."""
    i = ORDER_INDEXES[1]
    keys = index.over_bound(order_postings(s, d)[i.name], i, 500)
    top = keys.orderBy(F.desc("ids")).first()
    q = indexed_orders(s, d, Limits(scan_default=500), (i,)).where(lambda o: o.o_orderstatus.eq(top["o_orderstatus"])).where(lambda o: o.o_orderpriority.eq(top["o_orderpriority"]))
    try:
        q.get()
        assert not top["refused"]
    except QueryError:
        assert top["refused"]
    return keys


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def index_fallback(s, d):
    """explain names an index that the manifest lacks; execution scans."""
    base = orders(s, d)
    c = Collection("orders", base.df, base.form, base.indexes, ANALYTIC, {}, frozenset())
    q = c.where(lambda o: o.o_orderstatus.eq("P")).select("o_orderstatus")
    assert q.explain()["plan"] == "index" and q.run().plan.kind == "scan"
    return q.get()


@query("""SELECT 'and of eq and range' AS case_name, 'index' AS plan, 'by-status' AS index_name, count(*) AS found FROM orders WHERE o_totalprice > 5000 AND o_orderstatus = 'P'
UNION ALL SELECT 'eq on id', 'point', NULL, count(*) FROM orders WHERE o_orderkey = 5 UNION ALL SELECT 'empty id', 'scan', NULL, 0
UNION ALL SELECT 'or', 'scan', NULL, count(*) FROM orders WHERE o_orderstatus = 'P' OR o_custkey = 1 UNION ALL SELECT 'range', 'index', 'by-price', count(*) FROM orders WHERE o_totalprice > 5000
UNION ALL SELECT 'order only', 'scan', NULL, count(*) FROM orders""")
def explain_plans(s, d):
    """How each query is answered, and how many orders it finds."""
    c = indexed_orders(s, d)
    cases = {
        "eq on id": c.where(lambda o: o.id.eq("5")), "empty id": c.where(lambda o: o.id.eq("")), "or": c.where(lambda o: o.o_orderstatus.eq("P")).or_where(lambda o: o.o_custkey.eq(1)),
        "and of eq and range": c.where(lambda o: o.o_totalprice.gt(5000)).where(lambda o: o.o_orderstatus.eq("P")), "range": c.where(lambda o: o.o_totalprice.gt(5000)), "order only": c.order_by("o_totalprice"),
    }
    out = None
    for name, q in cases.items():
        told = q.explain()
        row = q.select("o_custkey").get().agg(F.lit(name).alias("case_name"), F.lit(told["plan"]).alias("plan"), F.lit(told["indexName"]).cast("string").alias("index_name"), F.count(F.lit(1)).alias("found"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_custkey IS NOT NULL")
def index_build(s, d):
    c = orders(s, d)
    return index.build(c.df, ORDER_INDEXES[3], c.form)


@query("SELECT CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE o_custkey END AS o_custkey, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice FROM orders WHERE o_orderkey % 100 <> 50")
def index_update(s, d):
    """Some documents move to another key, some go."""
    c = orders(s, d)
    hit = c.df.where(F.col("o_orderkey") % 50 == 0)
    changed = hit.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 0, F.lit(1).cast("long")))
    return index.update(index.build(c.df, ORDER_INDEXES[3], c.form), changed, ORDER_INDEXES[3], c.form)


@query("SELECT 'by-status-priority' AS index_name, count(*) AS entries, CAST(sum(n) AS BIGINT) AS ids FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def index_stats(s, d):
    c = orders(s, d)
    return index.stats(index.build(c.df, ORDER_INDEXES[1], c.form), ORDER_INDEXES[1])


@query("SELECT o_orderstatus, count(*) AS ids FROM orders GROUP BY o_orderstatus")
def index_entries(s, d):
    c = orders(s, d)
    return index.entries(index.build(c.df, ORDER_INDEXES[0], c.form), ORDER_INDEXES[0])


@query("SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def index_rebuild(s, d):
    """An index kept up by updates equals one built anew."""
    c = orders(s, d)
    hit = c.df.where(F.col("o_orderkey") % 7 == 0).withColumn("o_custkey", F.col("o_custkey") + 1)
    after = c.df.where(F.col("o_orderkey") % 7 != 0).unionByName(hit)
    return algebra.difference(index.update(index.build(c.df, ORDER_INDEXES[3], c.form), hit, ORDER_INDEXES[3], c.form), index.build(after, ORDER_INDEXES[3], c.form))


@query("""SELECT 'by-customer' AS index_name, count(*) AS postings, count(*) FILTER (o_orderkey % 7 = 0 AND o_custkey <> 1) AS missing, count(*) FILTER (o_orderkey % 7 = 0 AND o_custkey <> 1) AS stale, CAST(0 AS BIGINT) AS twice FROM orders
UNION ALL SELECT 'by-price', count(*) FILTER (o_orderkey % 5 > 0), count(*) FILTER (o_orderkey % 5 = 0), 0, 0 FROM orders
UNION ALL SELECT 'by-status', count(*) + count(*) FILTER (o_orderkey % 9 = 0), 0, count(*) FILTER (o_orderkey % 9 = 0), count(*) FILTER (o_orderkey % 9 = 0) FROM orders UNION ALL SELECT 'by-status-priority', count(*), 0, 0, 0 FROM orders""")
def index_health(s, d):
    """Indexes against their documents: one is right, one has an older key for some ids, one lacks ids, one holds ids twice."""
    c, held = orders(s, d), order_postings(s, d)
    customers_, prices, statuses, right = held["by-customer"], held["by-price"], held["by-status"], held["by-status-priority"]
    number = F.col("id").cast("long")
    checked = (
        (customers_.withColumn("o_custkey", F.when(number % 7 == 0, F.lit(1).cast("long")).otherwise(F.col("o_custkey"))), 3), (prices.where(number % 5 > 0), 2),
        (statuses.unionByName(statuses.where(number % 9 == 0)), 0), (right, 1),
    )
    out = None
    for postings, k in checked:
        row = index.integrity(postings, c.df, ORDER_INDEXES[k], c.form)
        out = row if out is None else out.unionByName(row)
    return out


# Aggregates


@query("SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS bucket, count(*) AS records, count(deleted_at) AS tombstones, CAST(sum(length(o_orderpriority)) AS BIGINT) AS decoded_bytes FROM " + STORED + " GROUP BY 1")
def bucket_stats(s, d):
    return stats.bucket_stats(stored_orders(s, d), F.col("o_orderkey").cast("string"), F.octet_length("o_orderpriority"), F.col("deleted_at").isNotNull())


@query("SELECT count(*) AS records, count(deleted_at) AS tombstones, CAST(sum(length(o_orderpriority)) AS BIGINT) AS decoded_bytes FROM " + STORED)
def collection_stats(s, d):
    return stats.collection_stats(stored_orders(s, d), F.octet_length("o_orderpriority"), F.col("deleted_at").isNotNull())


@query(f"SELECT count(deleted_at) AS retained FROM {STORED}")
def retained_count(s, d):
    return lifecycle.retained_count(stored_orders(s, d))


LATENCY = """SELECT {case}, count(*) AS operations, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*) * 100, 2) AS success_percent,
    quantile_disc(value, 0.5) FILTER (ok) AS p50, quantile_disc(value, 0.95) FILTER (ok) AS p95, round(avg(value) FILTER (ok), 3) AS mean FROM (SELECT *, user_id % 9 <> 0 AS ok FROM events {where}) GROUP BY 1"""


@query(LATENCY.format(case="event_type", where=""))
def latency_summary(s, d):
    """Events as measured operations: value is the time, every ninth user's fail."""
    return stats.latency_summary(table(s, d, "events"), "event_type", "value", F.col("user_id") % 9 != 0)


@query(f"""WITH a AS ({LATENCY.format(case='event_type', where='WHERE event_id % 2 = 0')}), b AS ({LATENCY.format(case='event_type', where='WHERE event_id % 2 = 1')})
SELECT event_type, CASE WHEN b.p50 = 0 THEN CASE WHEN a.p50 = 0 THEN 0.0 END ELSE round((a.p50 - b.p50) / b.p50 * 100, 2) END AS p50_change_percent,
CASE WHEN b.p95 = 0 THEN CASE WHEN a.p95 = 0 THEN 0.0 END ELSE round((a.p95 - b.p95) / b.p95 * 100, 2) END AS p95_change_percent FROM a JOIN b USING (event_type)""")
def baseline_change(s, d):
    half = lambda k: stats.latency_summary(table(s, d, "events").where(F.col("event_id") % 2 == k), "event_type", "value", F.col("user_id") % 9 != 0)
    return stats.baseline_change(half(0), half(1), "event_type", ("p50", "p95"))


@query("SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL AND source <> ''")
def unique_sorted(s, d):
    return stats.unique_values(table(s, d, "documents"), "source")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(s, d):
    return lifecycle.duplicate_ids(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT sha256(text) AS address, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedupe(s, d):
    """Contents that several documents share."""
    return table(s, d, "documents").groupBy(content_key(F.col("text")).alias("address")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""WITH e AS (SELECT event_type AS collection, count(*) AS document_count, 2048 AS average_document_bytes, max(value) / 50 AS writes_per_minute, 1 + min(event_id) % 3 AS concurrent_writers, (max(value) % 10) / 10 AS scan_ratio, 1 - (max(value) % 10) / 10 AS point_read_ratio FROM events GROUP BY 1),
f AS (SELECT *, document_count * average_document_bytes AS size FROM e), g AS (SELECT *, (size <= 262144)::INT + (writes_per_minute <= 1)::INT + (concurrent_writers <= 1)::INT + (scan_ratio >= 0.35)::INT AS one, (size >= 524288)::INT + (writes_per_minute >= 5)::INT + (concurrent_writers >= 2)::INT + (point_read_ratio >= 0.7)::INT AS two FROM f)
SELECT collection, CASE WHEN one > two THEN 'snapshot' ELSE 'bucketed' END AS layout, CASE WHEN abs(one - two) >= 3 THEN 'high' WHEN abs(one - two) >= 2 THEN 'medium' ELSE 'low' END AS confidence, size AS estimated_bytes FROM g""")
def layout_advice(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("collection")).agg(
        F.count(F.lit(1)).alias("document_count"), F.lit(2048).alias("average_document_bytes"), (F.max("value") / 50).alias("writes_per_minute"), (1 + F.min("event_id") % 3).alias("concurrent_writers"),
        ((F.max("value") % 10) / 10).alias("scan_ratio"), (1 - (F.max("value") % 10) / 10).alias("point_read_ratio"),
    )
    return stats.layout_advice(e).select("collection", "layout", "confidence", "estimated_bytes")


# Algebra and imports


@query("SELECT CAST(0 AS BIGINT) AS only_left, CAST(count(*) AS BIGINT) AS only_right FROM customer WHERE c_custkey % 10 = 0")
def verify_equal(s, d):
    c = table(s, d, "customer")
    return algebra.difference(c.where(F.col("c_custkey") % 10 != 0), c)


@query("SELECT * FROM customer WHERE c_nationkey < 5")
def import_create(s, d):
    c = table(s, d, "customer")
    return algebra.import_into(c.limit(0), c.where("c_nationkey < 5"), "c_custkey", "create")


@query("SELECT * FROM customer WHERE c_nationkey >= 5")
def import_replace(s, d):
    c = table(s, d, "customer")
    return algebra.import_into(c.where("c_nationkey < 5"), c.where("c_nationkey >= 5"), "c_custkey", "replace")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def import_merge(s, d):
    c = table(s, d, "customer")
    return algebra.import_into(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(c.where("c_custkey % 3 = 0 AND c_custkey % 4 <> 0")), "c_custkey", "merge")


# Writes


@query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, CAST(NULL AS TIMESTAMP) AS deleted_at FROM events GROUP BY user_id")
def put_many(s, d):
    """Events as upserts by user over an empty and then a filled collection: the last one counts, and deleted ids come back."""
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_type", "value", F.col("event_id").alias("position"))
    early = lifecycle.stored(lifecycle.latest(e.where("position % 2 = 0"), "id", "position").drop("position"))
    return lifecycle.put_many(lifecycle.erase_all(early, NOW), e, "id", "position").select("id", "event_type", "value", "deleted_at")


#: Events in batches: most of 18 events, every twentieth of up to 20 more; every 97th event has no id.
BATCHES = "(SELECT event_id, CASE WHEN event_id % 360 < 22 THEN -1 - event_id // 360 ELSE event_id // 9 END AS batch, CASE WHEN event_id % 97 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS id, event_type, value FROM events)"
JUDGED = f"(SELECT batch, count(*) AS documents, CASE WHEN count(*) > 20 THEN 'too many' WHEN count(*) FILTER (id = '') > 0 THEN 'without id' WHEN count(DISTINCT id) < count(*) THEN 'one id twice' END AS refused FROM {BATCHES} GROUP BY batch)"


def event_batches(s, d) -> DataFrame:
    e = table(s, d, "events")
    batch = F.when(F.col("event_id") % 360 < 22, -1 - F.floor(F.col("event_id") / 360)).otherwise(F.floor(F.col("event_id") / 9))
    return e.select("event_id", batch.cast("long").alias("batch"), F.when(F.col("event_id") % 97 == 0, "").otherwise(F.col("user_id").cast("string")).alias("id"), "event_type", "value")


@query(f"SELECT * FROM {JUDGED}")
def batch_validate(s, d):
    """Which batches of events are refused, and why."""
    return lifecycle.judge_batches(event_batches(s, d), "batch", "id")


@query(f"SELECT id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM {BATCHES} JOIN {JUDGED} USING (batch) WHERE refused IS NULL GROUP BY id")
def batch_apply(s, d):
    """The state after all batches; a refused one changes nothing."""
    changes = event_batches(s, d)
    empty = lifecycle.stored(changes.select("id", "event_type", "value").limit(0))
    return lifecycle.live(lifecycle.apply_batches(empty, changes, "batch", "id", "event_id"))


@query(f"SELECT o_orderkey, CASE WHEN deleted_at IS NULL AND o_custkey % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at, CASE WHEN deleted_at IS NULL AND o_custkey % 5 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 30 DAY ELSE restore_until END AS restore_until, CASE WHEN deleted_at IS NULL AND o_custkey % 5 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 37 DAY ELSE purge_after END AS purge_after FROM {STORED}")
def soft_delete(s, d):
    rows = stored_orders(s, d)
    return lifecycle.delete(rows, rows.where("o_custkey % 5 = 0").select("o_orderkey"), "o_orderkey", NOW).select("o_orderkey", *lifecycle.MARKS)


@query(f"SELECT o_orderkey, CASE WHEN restore_until >= TIMESTAMP '1996-06-01' THEN NULL ELSE deleted_at END AS deleted_at FROM {STORED}")
def restore(s, d):
    """Only what may still be restored comes back."""
    rows = stored_orders(s, d)
    return lifecycle.restore(rows, rows.select("o_orderkey"), "o_orderkey", "1996-06-01 00:00:00").select("o_orderkey", "deleted_at")


@query(f"SELECT o_orderkey, coalesce(deleted_at, TIMESTAMP '{NOW}') AS deleted_at FROM {STORED}")
def erase_all(s, d):
    return lifecycle.erase_all(stored_orders(s, d), NOW).select("o_orderkey", "deleted_at")


@query(f"SELECT o_orderkey, purge_after FROM {STORED} WHERE deleted_at IS NULL OR purge_after > TIMESTAMP '1996-06-01'")
def purge_deleted(s, d):
    return lifecycle.purge(stored_orders(s, d), "1996-06-01 00:00:00").select("o_orderkey", "purge_after")


@query(f"SELECT o_orderkey, deleted_at FROM {STORED} WHERE deleted_at IS NOT NULL ORDER BY o_orderkey LIMIT 1000")
def deleted_list(s, d):
    return lifecycle.deleted(stored_orders(s, d), "o_orderkey").select("o_orderkey", "deleted_at")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0")
def replace_stored(s, d):
    """The ids that a replacement removes."""
    rows = stored_orders(s, d)
    return lifecycle.replaced_ids(rows, rows.where("o_orderkey % 6 <> 0"), "o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 6 = 0 THEN coalesce(deleted_at, TIMESTAMP '{NOW}') END AS deleted_at FROM {STORED}")
def replace_write(s, d):
    """A replacement: its documents are live, live rows of other ids become deletions."""
    rows = stored_orders(s, d)
    new = table(s, d, "orders").where("o_orderkey % 6 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return lifecycle.replace_all(rows, new, "o_orderkey", NOW).select("o_orderkey", "o_totalprice", "deleted_at")


SCOPES = "(SELECT o_orderkey, o_totalprice, CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'user:' || o_custkey WHEN 2 THEN 'tenant:' || c_nationkey ELSE 'role:' || lower(o_orderstatus) END AS scope FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"SELECT scope, count(*) AS orders FROM {SCOPES} WHERE scope IN ('public', 'role:f', 'tenant:7') OR scope IN (SELECT 'user:' || c_custkey FROM customer WHERE c_nationkey = 7) GROUP BY scope")
def scope_grants(s, d):
    """Orders that the customers of one nation may read together: public ones, their own, their tenant's and their role's."""
    c = table(s, d, "customer")
    k = F.col("o_orderkey") % 4
    scope = F.when(k == 0, "public").when(k == 1, F.concat(F.lit("user:"), "o_custkey")).when(k == 2, F.concat(F.lit("tenant:"), "c_nationkey")).otherwise(F.concat(F.lit("role:"), F.lower("o_orderstatus")))
    rows = table(s, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", scope.alias("scope"))
    grants = algebra.grants_of(c.where("c_nationkey = 7").select(F.col("c_custkey").cast("string").alias("user"), F.col("c_nationkey").cast("string").alias("tenant"), F.array(F.lit("f")).alias("roles")))
    return algebra.readable(rows, "scope", grants).groupBy("scope").agg(F.count(F.lit(1)).alias("orders"))



@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name, s_acctbal + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS s_acctbal FROM supplier")
def layout_migrate(s, d):
    """A snapshot becomes bucketed, a write touches some buckets, and the rows stay."""
    store = Store(s, work_folder(s, "store"))
    rows = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", "s_acctbal")
    store.commit("suppliers", lambda old: rows)
    store.commit("suppliers", lambda old: old, layout="bucketed")
    hit = rows.where("CAST(id AS INT) % 5 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    store.commit("suppliers", lambda old: old.drop("bucket").join(hit.select("id"), "id", "left_anti").unionByName(hit), touched=hit.select("id"))
    return store.read("suppliers").select("id", "s_name", "s_acctbal")


def kept_customers(s, d, name: str, **more) -> tuple[Store, DataFrame]:
    """A store with the customers as live rows."""
    store = Store(s, work_folder(s, name))
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_nationkey", "c_acctbal")
    store.commit("customers", lambda old: lifecycle.stored(rows), **more)
    return store, rows


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, deleted_at FROM {STORED} WHERE deleted_at IS NULL OR purge_after > TIMESTAMP '1996-06-01'")
def retention_maintain(s, d):
    """Maintenance purges the deletions of a stored collection whose time is over."""
    store = Store(s, work_folder(s, "maintain"))
    rows = stored_orders(s, d).select(F.col("o_orderkey").cast("string").alias("id"), "deleted_at", "restore_until", "purge_after")
    store.commit("orders", lambda old: rows)
    jobs.maintain(store, ["orders"], "1996-06-01 00:00:00")
    return store.read("orders").select("id", "deleted_at")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, TIMESTAMP '{NOW}' AS deleted_at FROM customer")
def scope_erase(s, d):
    """All documents of a stored collection become deletions."""
    store, _ = kept_customers(s, d, "erase")
    jobs.erase(store, ["customers"], NOW)
    return store.read("customers").select("id", "c_name", "deleted_at")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) AS c_name, c_nationkey FROM customer")
def rewrite_verified(s, d):
    """Every stored document rewritten, and compared after."""
    store, _ = kept_customers(s, d, "rewrite")
    jobs.rewrite(store, "customers", lambda rows: rows.withColumn("c_name", F.upper("c_name")))
    return jobs.live_rows(store, "customers").select("id", "c_name", "c_nationkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, CASE WHEN c_nationkey < 5 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer")
def archive_import(s, d):
    """An archive of some customers, with another nation, merged into a stored collection of all."""
    store, rows = kept_customers(s, d, "import")
    folder = work_folder(s, "archive")
    files.export_archive(rows.where("c_nationkey < 5").select("id", "c_name", F.lit(0).cast("long").alias("c_nationkey"), "c_acctbal"), folder, "customers.ndjson")
    jobs.import_archive(store, "customers", folder, "id string, c_name string, c_nationkey long, c_acctbal double", "merge")
    return jobs.live_rows(store, "customers").select("id", "c_name", "c_nationkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal + 1 AS c_acctbal, true AS second_refused FROM customer")
def conditional_rewrite(s, d):
    """A write for a revision that is no longer the last is refused, and so the change is made once."""
    store, _ = kept_customers(s, d, "conditional")
    seen = store.head("customers").revision
    change = lambda rows: rows.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    store.commit("customers", change, expected_revision=seen)
    refused = False
    try:
        store.commit("customers", change, expected_revision=seen)
    except Conflict:
        refused = True
    return store.read("customers").select("id", "c_acctbal", F.lit(refused).alias("second_refused"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_nationkey, true AS refused FROM customer WHERE c_nationkey = 9")
def index_configured(s, d):
    """A writer whose indexes differ from the collection's is refused, so the index finds what is stored."""
    i = Index("by-nation", ("c_nationkey",))
    store, _ = kept_customers(s, d, "configured", indexes=(i,))
    refused = False
    try:
        store.commit("customers", lambda old: old.limit(0))
    except QueryError:
        refused = True
    return store.collection("customers", (i,), ANALYTIC).where(lambda c: c.c_nationkey.eq(9)).select("c_nationkey").get().withColumn("refused", F.lit(refused))


@query("SELECT id, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, id) AS place FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, o_orderpriority FROM orders)")
def tuple_order(s, d):
    """The place of every posting of a composite index: by its keys one after another, then by id."""
    keys = ORDER_INDEXES[1].keys
    return algebra.numbered(order_postings(s, d)["by-status-priority"].select("id", *keys), [F.col(k) for k in (*keys, "id")], work_folder(s, "tuples"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def deep_equality(s, d):
    """An object equals another with the same members in any order."""
    df = table(s, d, "customer").withColumn("place", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    return Collection.typed("customers", df, "c_custkey", (), ANALYTIC, SAFE, integer_id=True).where(lambda c: c.place.eq({"segment": "BUILDING", "nation": 3})).select("c_name").get()


# Logs and streams

LATEST = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


def event_log(s, d) -> DataFrame:
    return table(s, d, "events").select("user_id", "event_id", "event_type", "value")


@query(f"SELECT * FROM ({LATEST}) WHERE event_type <> 'error'")
def log_replay(s, d):
    """An error event deletes its user's entry."""
    log = event_log(s, d).withColumn("gone", F.col("event_type") == "error")
    return changefeed.replay(log, "user_id", "event_id", "gone").drop("gone")


@query(LATEST)
def log_compact(s, d):
    log = event_log(s, d)
    return changefeed.compact(changefeed.compact(None, log.where("event_id % 1000 < 500"), "user_id", "event_id"), log.where("event_id % 1000 >= 500"), "user_id", "event_id")


@query(LATEST)
def changefeed_monotonic(s, d):
    """Newer changes first, then older ones, then all again: only the newest count."""
    log = event_log(s, d)
    state = changefeed.fold(log.where("event_id % 2 = 1"), "user_id", "event_id")
    return changefeed.apply_newer(changefeed.apply_newer(state, log.where("event_id % 2 = 0"), "user_id", "event_id"), log, "user_id", "event_id")


@query(LATEST)
def changefeed_apply(s, d):
    """Structured Streaming into a stored collection."""
    log = event_log(s, d)
    folder = work_folder(s, "feed")
    log.repartition(4, "event_id").write.parquet(f"{folder}/changes")
    store = Store(s, f"{folder}/store")
    changefeed.stream_into(changefeed.read_changes(s, f"{folder}/changes", log.schema, 2), store, "users", "user_id", "event_id", f"{folder}/progress").awaitTermination()
    return store.read("users").select("user_id", "event_id", "event_type", "value")


# Sources, sinks, archives


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, c_acctbal FROM customer")
def ingest_json(s, d):
    """Written as JSON objects and read as arrays at a dotted path; numeric ids become strings."""
    from pyspark.sql import types as T

    folder = work_folder(s, "json")
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_acctbal")
    nested = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(64))).groupBy("slice").agg(F.collect_list(F.struct("key", "c_name", "c_acctbal")).alias("list"))
    nested.select(F.to_json(F.struct(F.struct(F.col("list")).alias("data"))).alias("value")).write.text(folder)
    item = T.StructType([T.StructField("key", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_acctbal", T.DoubleType())])
    schema = T.StructType([T.StructField("data", T.StructType([T.StructField("list", T.ArrayType(item))]))])
    return files.read_json(s, folder, "data.list", "key", schema, lines=True)


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def nested_json(s, d):
    """Documents written below a nested path and read from it."""
    folder = work_folder(s, "nested")
    files.write_json(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_size"), folder, "store.parts")
    return files.read_json(s, folder, "store.parts", lines=True).select("id", "p_name", F.col("p_size").cast("long").alias("p_size"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def ingest_csv(s, d):
    """All values are strings."""
    folder = work_folder(s, "csv")
    table(s, d, "nation").coalesce(1).write.option("header", True).csv(folder)
    return files.read_csv(s, folder, "n_nationkey")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_size FROM part")
def record_to_document(s, d):
    return files.to_documents(table(s, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, '{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"id":"' || c_custkey || '"}' AS line FROM customer""")
def emit_json(s, d):
    return files.json_lines(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_name", "c_nationkey"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a \"b\", c' ELSE '' END AS nick FROM nation")
def emit_csv(s, d):
    """Written as CSV and read again: the fields that any document has, as text; one that none has is no column."""
    docs = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, 'a "b", c').alias("nick"), F.lit(None).cast("string").alias("never"))
    folder = work_folder(s, "emit")
    files.write_csv(docs, folder)
    return files.read_csv(s, folder)


@query("SELECT * FROM (VALUES ('n_name'), ('n_regionkey'), ('nick')) t(field) WHERE EXISTS (SELECT * FROM nation WHERE n_nationkey % 2 = 0)")
def csv_fields(s, d):
    """The header of a CSV file: the fields that any document has."""
    return files.header_fields(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "x").alias("nick"), F.lit(None).cast("string").alias("never"))).select("field")


def digest_sql(lines: str) -> str:
    """The digest tree of an archive over a query of (id, line)."""
    return f"""(WITH lines AS ({lines}), hashed AS (SELECT substr(sha256(id), 1, 2) AS bucket, substr(sha256(id), 1, 5) AS leaf, id, sha256(line) AS digest FROM lines),
leaves AS (SELECT bucket, leaf, count(*) AS n, sha256(string_agg(digest, '' ORDER BY id)) AS digest FROM hashed GROUP BY ALL),
buckets AS (SELECT bucket, sum(n) AS n, sha256(string_agg(digest, '' ORDER BY leaf)) AS digest FROM leaves GROUP BY bucket)
SELECT CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(digest, '' ORDER BY bucket)) AS sha256 FROM buckets)"""


SUPPLIER_LINES = """SELECT CAST(s_suppkey AS VARCHAR) AS id, '{"id":"' || s_suppkey || '","s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS line FROM supplier"""


@query(f"SELECT * FROM {digest_sql(SUPPLIER_LINES)}")
def archive_export(s, d):
    """The manifest of an archive: how many lines and the digest over all of them."""
    docs = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", "s_nationkey")
    entry = files.export_archive(docs, work_folder(s, "archive"), "suppliers.ndjson")
    return s.createDataFrame([(entry["records"], entry["sha256"])], "records long, sha256 string")


@query(SUPPLIER_LINES)
def archive_lines(s, d):
    """The lines of an archive as they were written."""
    folder = work_folder(s, "archive")
    files.export_archive(table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", "s_nationkey"), folder, "suppliers.ndjson")
    lines = s.read.text(f"{folder}/suppliers.ndjson")
    return lines.select(F.get_json_object("value", "$.id").alias("id"), F.col("value").alias("line"))


NATION_LINES = """SELECT CAST(n_nationkey AS VARCHAR) AS id, '{"id":"' || n_nationkey || '","n_name":"' || n_name || '"}' AS line FROM nation"""


@query(f"SELECT records, sha256, 'refused' AS altered FROM {digest_sql(NATION_LINES)}")
def archive_validate(s, d):
    """An archive agrees with its manifest; with one line altered it doesn't."""
    folder = work_folder(s, "archive")
    docs = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name")
    files.export_archive(docs, folder, "nations.ndjson")
    entry = files.validate_archive(s, folder, "nations.ndjson")
    files.json_lines(docs.withColumn("n_name", F.when(F.col("id") == "3", "X").otherwise(F.col("n_name")))).select(F.col("line").alias("value")).write.mode("overwrite").text(f"{folder}/nations.ndjson")
    try:
        files.validate_archive(s, folder, "nations.ndjson")
    except QueryError:
        return s.createDataFrame([(entry["records"], entry["sha256"], "refused")], "records long, sha256 string, altered string")
    raise AssertionError("an altered archive was accepted")


@query("SELECT event_id, props AS opened, true AS sealed_differs FROM events")
def envelope_roundtrip(s, d):
    """Sealed text opens with the key and the place it is bound to."""
    key, place = F.lit("0123456789abcdef").cast("binary"), F.concat(F.lit("events/"), F.col("event_id").cast("string"))
    sealed = table(s, d, "events").select("event_id", "props", seal(F.col("props"), key, place).alias("sealed"))
    return sealed.select("event_id", unseal(F.col("sealed"), key, place).alias("opened"), (F.col("sealed") != F.col("props")).alias("sealed_differs"))


@query("SELECT o_orderkey, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS bucket FROM orders")
def id_bucket_of(s, d):
    return table(s, d, "orders").select("o_orderkey", id_bucket(F.col("o_orderkey").cast("string")).alias("bucket"))


@query("""SELECT event_id, '{"a":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}' AS canonical, 'a%20b%2F' || event_type AS component FROM events""")
def scalar_functions(s, d):
    """Canonical JSON sorts keys; names are percent-encoded."""
    e = table(s, d, "events")
    text = F.format_string('{ "k": %s, "a": %s.0 }', F.get_json_object("props", "$.k"), F.col("event_id").cast("string"))
    return e.select("event_id", canonical_json(text).alias("canonical"), url_component(F.concat(F.lit("a b/"), "event_type")).alias("component"))


@query("SELECT event_type, CASE WHEN sum(value) = 0 THEN NULL ELSE round((count(*) - sum(value)) / sum(value) * 100, 2) END AS change FROM events GROUP BY event_type")
def percent_changes(s, d):
    t = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return t.select("event_type", percent_change(F.col("n"), F.col("v")).alias("change"))


def entry(s: SparkSession, d: str) -> DataFrame:
    return flagship(s, d)


__all__ = ["QUERIES", "SQL", "Query", "entry"]
