"""Indexes of frequent keys and large tables: no task holds a key, or a file's ids."""

import glob

import pyarrow.parquet as pq

from larkspur.operators import index
from larkspur.plans.compile import Typed
from larkspur.plans.planner import Index

BY_STATUS = Index("by-status", ("status",))


def docs(spark, n):
    return spark.range(n).selectExpr("cast(id as string) as id", "if(id % 50 = 0, 'rare', 'often') as status")


def test_a_frequent_key_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.write(docs(spark, 4000), BY_STATUS, str(tmp_path / "postings"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [[tuple(r.values()) for r in pq.read_table(f).to_pylist()] for f in sorted(glob.glob(f"{tmp_path}/postings/*.parquet"))]
    assert max(map(len, files)) < 2000
    everything = [(status, id_) for rows in files for id_, status in rows]
    assert everything == sorted(everything) and len(everything) == 4000


def test_integrity_deals_ids_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(index, "ROWS_A_TASK", 400)
    live = docs(spark, 4000)
    form = Typed(live.schema)
    # ids 0-9 twice, 10-19 under another key, 20-29 missing, one posting without a document
    held = live.where("id >= 30").unionByName(live.where("id < 10")).unionByName(live.where("id < 10")).unionByName(live.where("id >= 10 and id < 20").selectExpr("id", "'other' as status"))
    held = held.unionByName(spark.createDataFrame([("none", "often")], held.schema))
    assert index.dealt(held, live, BY_STATUS, form).rdd.getNumPartitions() == 21
    assert index.integrity(held, live, BY_STATUS, form).first().asDict() == {"index_name": "by-status", "postings": 4001, "missing": 20, "stale": 21, "twice": 10}
    assert index.integrity(held.limit(0), live.limit(0), BY_STATUS, form).first().asDict() == {"index_name": "by-status", "postings": 0, "missing": 0, "stale": 0, "twice": 0}
