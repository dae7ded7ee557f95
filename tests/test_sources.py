import pytest
from pyspark.sql import functions as F

from larkspur.collection import Collection
from larkspur.plans.ast import QueryError
from larkspur.sources import files, sample


def test_sample_store(spark):
    made = sample.store(spark)
    assert {k: v.count() for k, v in made.items()} == {"products": 128, "customers": 32, "orders": 96}
    items = made["orders"].select("id", "totalCents", F.explode("items").alias("i")).select("id", "totalCents", "i.*")
    priced = items.join(made["products"].select(F.col("id").alias("productId"), F.col("priceCents").alias("listed")), "productId")
    assert priced.where("priceCents <> listed").count() == 0
    assert priced.groupBy("id").agg(F.sum(F.col("quantity") * F.col("priceCents")).alias("t"), F.first("totalCents").alias("w")).where("t <> w").count() == 0
    c = Collection.typed("products", made["products"])
    assert c.where(lambda p: p.tags.contains("sale")).take(1000).get().count() == made["products"].where(F.array_contains("tags", "sale")).count() > 0
    assert made["customers"].collect() == sample.store(spark)["customers"].collect()


def test_nested_equality(spark):
    c = Collection.typed("customers", sample.customers(spark, 32))
    row = c.get("customer-00007")
    address = row["address"].asDict()
    assert "customer-00007" in {r["id"] for r in c.where(lambda x: x.address.eq(dict(reversed(address.items())))).get().collect()}
    assert c.where(lambda x: x.address.eq({"city": address["city"]})).get().count() == 0


def test_jdbc(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "pushDownPredicate": "false"}
    try:
        spark.createDataFrame([("s", "other", "1", "x")], "scope string, collection string, id string, document string").write.format("jdbc").option("url", url).option("dbtable", "docs").option("createTableColumnTypes", "scope VARCHAR(50), collection VARCHAR(50), id VARCHAR(50)").options(**options).save()
    except Exception as e:
        pytest.skip(f"no embedded database: {str(e)[:80]}")
    docs = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    files.write_jdbc(docs, url, "docs", "s", "mine", "create", **options)
    with pytest.raises(QueryError):
        files.write_jdbc(docs, url, "docs", "s", "mine", "create", **options)
    files.write_jdbc(docs.where("id = '2'").withColumn("name", F.lit("c")), url, "docs", "s", "mine", "merge", **options)
    with pytest.raises(Exception, match="wrong"):
        files.write_jdbc(docs.withColumn("name", F.when(F.col("id") == "2", F.raise_error(F.lit("wrong"))).otherwise("z")), url, "docs", "s", "mine", "replace", **options)
    rows = files.read_jdbc(spark, url, "SELECT * FROM docs", "id", **options)
    assert {(r["collection"], r["id"], r["document"]) for r in rows.collect()} == {("other", "1", "x"), ("mine", "1", '{"id":"1","name":"a"}'), ("mine", "2", '{"id":"2","name":"c"}')}
    files.write_jdbc(docs.where("id = '1'"), url, "docs", "s", "mine", "replace", **options)
    assert {(r["collection"], r["id"]) for r in files.read_jdbc(spark, url, "SELECT * FROM docs", "id", **options).collect()} == {("other", "1"), ("mine", "1")}


def test_jdbc_over_several_connections(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver", "pushDownPredicate": "false"}
    try:
        spark.range(100).select("id", (F.col("id") * 2).alias("v")).coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "numbers").options(**options).save()
    except Exception as e:
        pytest.skip(f"no embedded database: {str(e)[:80]}")
    rows = files.read_jdbc(spark, url, 'SELECT "id", "v" FROM numbers', "id", split_by="v", splits=4, **options)
    assert rows.rdd.getNumPartitions() == 4 and {(r.id, r.v) for r in rows.collect()} == {(str(k), 2 * k) for k in range(100)}
    assert files.read_jdbc(spark, url, 'SELECT "id", "v" FROM numbers WHERE "v" < 0', "id", split_by="v", **options).count() == 0


def test_csv_files_of_one_header(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("id,name\n1,a\n")
    (tmp_path / "c" / "b.csv").write_text("id,name\n2,b\n")
    for lines in (True, False):
        assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), multi_line=lines).collect()} == {("1", "a"), ("2", "b")}
    (tmp_path / "c" / "b.csv").write_text("id,other\n2,b\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path / "c")).collect()


def test_ids_that_are_no_finite_numbers(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            files.to_documents(spark.createDataFrame([(bad,)], "key double"), "key").collect()
    assert [r.id for r in files.to_documents(spark.createDataFrame([(2.0,)], "key double"), "key").collect()] == ["2"]
