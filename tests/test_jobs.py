import pytest
from pyspark.sql import functions as F

from larkspur import jobs
from larkspur.plans.ast import QueryError
from larkspur.plans.planner import Index
from larkspur.sources.storage import Store


def test_archive_round_trip_and_maintenance(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    docs = spark.createDataFrame([("2", "b", 1), ("1", "a", None), ("3", "c", 5)], "id string, name string, n int")
    assert jobs.ingest(store, "docs", docs)["records"] == 3
    with pytest.raises(QueryError):
        jobs.ingest(store, "docs", docs)
    with pytest.raises(QueryError):
        jobs.ingest(store, "more", docs.unionByName(docs))
    entry = jobs.export(store, "docs", str(tmp_path / "x"))
    assert entry["records"] == 3
    other = Store(spark, str(tmp_path / "b"))
    schema = "id string, name string, n int"
    assert jobs.import_archive(other, "docs", str(tmp_path / "x"), schema, dry_run=True)["total"] == 3 and other.read("docs") is None
    jobs.import_archive(other, "docs", str(tmp_path / "x"), schema)
    assert {tuple(r) for r in jobs.live_rows(other, "docs").select("id", "name", "n").collect()} == {("1", "a", None), ("2", "b", 1), ("3", "c", 5)}
    assert jobs.import_archive(other, "docs", str(tmp_path / "x"), schema, "merge")["total"] == 3
    assert jobs.migrate_layout(other, "docs", "bucketed")["layout"] == "bucketed"
    assert jobs.inspect(other, "docs")["parts"] == 3
    built = jobs.rebuild_index(other, "docs", Index("n", ("n",)), str(tmp_path / "i"))
    assert built["entries"] == 2 and built["ids"] == 2
    assert jobs.erase(other, ["docs"], "2024-01-01 00:00:00") == [{"collection": "docs", "erased": 3}]
    with pytest.raises(QueryError):
        jobs.migrate_layout(other, "docs", "snapshot")
    assert jobs.maintain(other, ["docs"], "2024-01-20 00:00:00")[0]["purged"] == 0
    assert jobs.maintain(other, ["docs"], "2024-03-01 00:00:00")[0]["purged"] == 3
    assert jobs.emit(store, "docs", str(tmp_path / "csv"), "csv")["records"] == 3
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == ["id", "n", "name"]
    with pytest.raises(QueryError):
        jobs.purge_scope(store, ["docs"], "2024-01-01 00:00:00")
    upper = lambda rows: rows.withColumn("name", F.upper("name"))
    assert jobs.rewrite(store, "docs", upper)["records"] == 3 and {r["name"] for r in jobs.live_rows(store, "docs").collect()} == {"A", "B", "C"}
    with pytest.raises(QueryError):
        jobs.rewrite(store, "docs", lambda rows: rows.withColumn("id", F.lit("1")))
    assert jobs.purge_scope(other, ["docs"], "2024-03-01 00:00:00") == [{"collection": "docs", "purged": 0}] and other.read("docs") is None
