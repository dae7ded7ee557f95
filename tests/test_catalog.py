import pytest
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Definition, parse_indexes
from larkspur.operators import lifecycle
from larkspur.plans.ast import QueryError
from larkspur.plans.planner import Index
from larkspur.sources.storage import Conflict

TITLE, CHANGED = Index("by-title", ("title",)), Index("by-changed", ("changed",), "range", ("title",))


def test_indexed_collection(spark, tmp_path):
    catalog = Catalog.of(spark, str(tmp_path), Definition("notes", (TITLE, CHANGED)))
    store = catalog.store("user:ada", "ada", right="write")
    with pytest.raises(PermissionError):
        catalog.store("user:bob", "ada")
    with pytest.raises(PermissionError):
        catalog.store("tenant:acme", "ada", "acme", right="write")
    docs = spark.range(10_000).select(F.format_string("%05d", "id").alias("id"), F.concat(F.lit("t"), (F.col("id") % 25).cast("string")).alias("title"), F.col("id").cast("double").alias("changed"))
    head = store.commit("notes", lambda old: lifecycle.stored(docs), indexes=(TITLE, CHANGED))
    assert head.indexes["by-title"]["entries"] == 25
    notes = catalog.collection(store, "notes")
    r = notes.where(lambda n: n.changed.gte(2_500)).where(lambda n: n.changed.lt(2_525)).select("title").run()
    assert r.plan.index_name == "by-changed" and r.plan.covering and r.scanned_documents == 25 and r.df.count() == 25
    assert "title" in r.df.columns and r.df.first()["id"] == "02500"
    r = notes.where(lambda n: n.title.eq("t3")).run()
    assert r.plan.index_name == "by-title" and r.df.count() == 100
    with pytest.raises(QueryError):
        notes.where(lambda n: n.title.ne("t3")).get()
    for wrong in (None, (TITLE,), (TITLE, Index("by-changed", ("changed",), "range"))):
        with pytest.raises(QueryError):
            store.commit("notes", lambda old: old, indexes=wrong)
    with pytest.raises(Conflict):
        store.commit("notes", lambda old: old, indexes=(TITLE, CHANGED), expected_revision=7)
    store.configure("notes", (TITLE,))
    assert catalog.collection(store, "notes").where(lambda n: n.changed.lt(3)).max_scan(100_000).run().plan.kind == "scan"
    assert catalog.collection(store, "notes").where(lambda n: n.changed.lt(3)).explain() == {"plan": "index", "indexName": "by-changed"}
    assert store.compact("notes") >= 1 and catalog.collection(store, "notes").where(lambda n: n.title.eq("t3")).get().count() == 100


def test_configuration():
    got = parse_indexes('{"notes": [{"name": "by-title", "fields": ["title"]}, {"name": "by-changed", "fields": ["changed"], "mode": "range", "include": ["title"]}]}')
    assert got == {"notes": (TITLE, CHANGED)}
    for bad in ('{"notes": [{"name": "a", "fields": ["t"]}, {"name": "a", "fields": ["u"]}]}', '{"a/b": []}', "[]"):
        with pytest.raises(QueryError):
            parse_indexes(bad)
    with pytest.raises(QueryError):
        Catalog.of(None, "", Definition("a"), Definition("a"))
    assert Catalog.of(None, "", Definition("a", (TITLE,))).index_configuration() == {"a": (TITLE,)}
