import pytest
from pyspark.sql import functions as F

from larkspur.collection import check_name
from larkspur.operators import index, lifecycle, stats
from larkspur.plans import planner
from larkspur.plans.ast import QueryError
from larkspur.plans.compile import Typed
from larkspur.plans.planner import Index
from larkspur.sources import files
from larkspur.sources.storage import Store
from larkspur.streaming import changefeed


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v int")


def test_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("c") is None and store.head("c").revision == 0
    store.commit("c", lambda old: rows(spark, [("a", 1), ("b", 2)]))
    head = store.commit("c", lambda old: old, layout="bucketed")
    assert head.revision == 2 and len(head.parts) == 2 and head.records == 2
    new = rows(spark, [("a", 5), ("z", 9)])
    after = store.commit("c", lambda old: new if old is None else old.drop("bucket").join(new, "id", "left_anti").unionByName(new), touched=new)
    assert {(r.id, r.v) for r in store.read("c").select("id", "v").collect()} == {("a", 5), ("b", 2), ("z", 9)}
    untouched = set(head.parts.values()) & set(after.parts.values())
    assert len(untouched) == 1
    assert store.read("c", "z").count() == 1 and store.read("c", "nothing").count() == 0
    with pytest.raises(QueryError):
        store.bounded("c", 2)
    assert store.compact("c") >= 1 and store.read("c").count() == 3
    store.drop("c")
    assert store.read("c") is None


def test_a_second_writer_computes_anew(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.commit("c", lambda old: rows(spark, [("a", 1)]))
    raced = []

    def change(old):
        if not raced:
            raced.append(other.commit("c", lambda o: o.unionByName(rows(spark, [("b", 2)]))))
        return old.unionByName(rows(spark, [("c", 3)]))

    assert store.commit("c", change).revision == 3
    assert {r.id for r in store.read("c").collect()} == {"a", "b", "c"}


def test_indexes_and_counts_follow_a_write(spark, tmp_path, monkeypatch):
    """A write that touches few ids reads postings and changed rows only, and gives what an index built anew gives."""
    i = Index("by-v", ("v",))
    store = Store(spark, str(tmp_path))
    many = spark.range(400).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("int").alias("v"))
    store.commit("c", lambda old: lifecycle.stored(many), layout="bucketed", indexes=(i,))
    hit = rows(spark, [("3", 100), ("9999", 5)])
    gone = rows(spark, [("8", 0)])
    change = lambda old: lifecycle.delete(old.join(hit.select("id"), "id", "left_anti").unionByName(lifecycle.stored(hit).select(*old.columns)), gone, "id", "2024-01-01 00:00:00")
    head = store.commit("c", change, touched=hit.select("id").unionByName(gone.select("id")), indexes=(i,))
    assert (head.records, head.tombstones) == (401, 1) and len(head.written) == 2 and sum(n for n, _ in head.counts.values()) == 401
    postings = {(r.id, r.v) for r in spark.read.parquet(head.indexes["by-v"]["path"]).collect()}
    live = lifecycle.live(store.read("c"))
    assert postings == {(r.id, r.v) for r in live.collect()} and ("3", 100) in postings and not any(k == "8" for k, _ in postings)
    assert index.integrity(spark.read.parquet(head.indexes["by-v"]["path"]), live, i, Typed(live.schema)).first().asDict() == {"index_name": "by-v", "postings": 400, "missing": 0, "stale": 0, "twice": 0}
    for few, sign in ((1_000, "EqualTo(id,3)"), (0, "by-v")):  # a filter of the scan, or a join with the postings
        monkeypatch.setattr(planner, "FEW_IDS", few)
        found = store.collection("c", (i,)).where(lambda c: c.v.eq(100)).get()
        assert [r.id for r in found.collect()] == ["3"] and sign in found._jdf.queryExecution().executedPlan().toString() + str(found.inputFiles())


def test_names():
    for bad in ("", ".", "..", "a/b", "x" * 129):
        with pytest.raises(QueryError):
            check_name(bad)


def test_lifecycle(spark):
    stored = lifecycle.stored(rows(spark, [("a", 1), ("b", 2)]))
    gone = lifecycle.delete(stored, rows(spark, [("a", 0)]), "id", "2024-01-01 00:00:00")
    assert [r.id for r in lifecycle.live(gone).collect()] == ["b"] and lifecycle.retained_count(gone).first()["retained"] == 1
    again = lifecycle.delete(gone, rows(spark, [("a", 0)]), "id", "2024-01-09 00:00:00")
    assert again.where("id = 'a'").first()["deleted_at"].day == 1
    assert lifecycle.live(lifecycle.restore(gone, rows(spark, [("a", 0)]), "id", "2024-01-31 00:00:00")).count() == 2
    assert lifecycle.live(lifecycle.restore(gone, rows(spark, [("a", 0)]), "id", "2024-01-31 00:00:01")).count() == 1
    assert lifecycle.purge(gone, "2024-02-07 00:00:00").count() == 1 and lifecycle.purge(gone, "2024-02-06 00:00:00").count() == 2
    back = lifecycle.put_many(gone, spark.createDataFrame([("a", 7, 1), ("a", 8, 2)], "id string, v int, p int"), "id", "p")
    assert {(r.id, r.v) for r in lifecycle.live(back).collect()} == {("a", 8), ("b", 2)}


def test_nearest_rank_of_ties(spark):
    data = [("x", float(v)) for v in (5, 1, 1, 1, 9, 2)] + [("y", 3.0)] * 4 + [("z", None)]
    got = {r.g: (r.p50, r.p95) for r in stats.nearest_rank(spark.createDataFrame(data, "g string, v double"), "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"x": (1.0, 9.0), "y": (3.0, 3.0)}


def test_nearest_rank_far_from_all_others(spark, monkeypatch):
    """One value far away puts all others in one cell, which is cut again."""
    monkeypatch.setattr(stats, "FEW", 5)
    df = spark.range(3_000).select(F.lit("a").alias("g"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") / 1000).alias("v"))
    values = sorted(r.v for r in df.collect())
    got = stats.nearest_rank(df, "g", "v", {"p1": 0.01, "p50": 0.5, "p95": 0.95, "all": 1.0}).first()
    assert (got.p1, got.p50, got.p95, got["all"]) == (values[29], values[1499], values[2849], 1e12)


def test_batches_replacements_and_reserved_fields(spark):
    changes = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (2, "c", 3, 3), (2, "c", 4, 4), (3, "", 5, 5), (4, "a", 6, 6)] + [(5, f"x{k}", 0, 10 + k) for k in range(21)], "batch int, id string, v int, p int")
    judged = {r.batch: r.refused for r in lifecycle.judge_batches(changes, "batch", "id").collect()}
    assert judged == {1: None, 2: "one id twice", 3: "without id", 4: None, 5: "too many"}
    state = lifecycle.apply_batches(lifecycle.stored(rows(spark, [("c", 0)])), changes, "batch", "id", "p")
    assert {(r.id, r.v) for r in state.collect()} == {("a", 6), ("b", 2), ("c", 0)}
    replaced = lifecycle.replace_all(lifecycle.stored(rows(spark, [("a", 1), ("b", 2)])), rows(spark, [("b", 7), ("d", 8)]), "id", "2024-01-01 00:00:00")
    assert {(r.id, r.v, r.deleted_at is None) for r in replaced.collect()} == {("a", 1, False), ("b", 7, True), ("d", 8, True)}
    with pytest.raises(QueryError):
        lifecycle.put_many(state, changes.withColumn(lifecycle.RESERVED_FIELD, F.lit(1)), "id", "p")


def test_files(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    open(path, "w").write('key,name,note\n1,"a, b",x\n2,c\n')
    assert [tuple(r) for r in files.read_csv(spark, path, "key").orderBy("id").collect()] == [("1", "a, b", "x"), ("2", "c", "")]
    open(path, "w").write("key,name\n1,a,b\n")
    with pytest.raises(Exception, match="longer"):
        files.read_csv(spark, path, "key").collect()
    open(path, "w").write("key,key\n1,a\n")
    with pytest.raises(QueryError):
        files.read_csv(spark, path, "key")
    path = str(tmp_path / "t.json")
    open(path, "w").write('{"data": {"list": [{"key": 1, "v": true}, {"key": 2.0, "v": null}]}}')
    assert [tuple(r) for r in files.read_json(spark, path, "data.list", "key").orderBy("id").collect()] == [("1", True), ("2", None)]
    bad = spark.createDataFrame([("1", "2")], "id string, key string")
    with pytest.raises(Exception, match="conflicts"):
        files.to_documents(bad, "key").collect()
    empty = rows(spark, [])
    assert files.export_archive(empty, str(tmp_path / "a"), "none")["records"] == 0
    assert files.validate_archive(spark, str(tmp_path / "a"), "none")["records"] == 0


def test_stream_is_idempotent(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")], "user int, rev int, v string")
    log.write.parquet(str(tmp_path / "log"))
    store = Store(spark, str(tmp_path / "s"))
    for k in range(2):
        changefeed.stream_into(changefeed.read_changes(spark, str(tmp_path / "log"), log.schema, 1), store, "users", "user", "rev", str(tmp_path / f"p{k}")).awaitTermination()
    assert {(r.user, r.v) for r in store.read("users").collect()} == {(1, "c"), (2, "b")}
    assert changefeed.replay(log.withColumn("gone", F.col("rev") == 3), "user", "rev", "gone").count() == 1
