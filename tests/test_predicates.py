"""Random documents and predicates, against an evaluator in plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.collection import Collection
from larkspur.plans.ast import ANALYTIC, And, Comparison, Fields, Limits, Not, Or, Query, QueryError, from_json, validate
from larkspur.plans.planner import Index, choose

MISSING = object()


def truth(e, doc):
    match e:
        case And(parts):
            return all(truth(p, doc) for p in parts)
        case Or(parts):
            return any(truth(p, doc) for p in parts)
        case Not(part):
            return not truth(part, doc)
    v, x = doc.get(e.field, MISSING), e.value
    same = lambda a, b: a is not MISSING and type(a) in ((int, float) if isinstance(b, (int, float)) and not isinstance(b, bool) else (type(b),)) and a == b
    number = lambda a: isinstance(a, (int, float)) and not isinstance(a, bool)
    if e.operator == "eq":
        return same(v, x)
    if e.operator == "ne":
        return not same(v, x)
    if e.operator == "in":
        return any(same(v, c) for c in x)
    if e.operator == "contains":
        return x in v if isinstance(v, str) and isinstance(x, str) else isinstance(v, list) and any(same(i, x) for i in v)
    if not ((number(v) and number(x)) or (isinstance(v, str) and isinstance(x, str))):
        return False
    return {"lt": v < x, "lte": v <= x, "gt": v > x, "gte": v >= x}[e.operator]


VALUES = {"n": [0, 1, 2.5, -3], "s": ["a", "b", "ab"], "b": [True, False], "l": [["a"], ["a", "b"], []]}


def random_doc(rng, k, mixed):
    doc = {"id": f"{k:03d}"}
    for f, values in VALUES.items():
        if rng.random() < 0.7:
            doc[f] = rng.choice(values)
            if mixed and rng.random() < 0.4:
                doc[f] = rng.choice([None, 1, "a", True, ["a", 1], {"k": 1}])
    return doc


def random_expression(rng, depth=0):
    if depth < 3 and rng.random() < 0.5:
        kind = rng.choice([And, Or, Not])
        return Not(random_expression(rng, depth + 1)) if kind is Not else kind(tuple(random_expression(rng, depth + 1) for _ in range(rng.randint(1, 3))))
    f = rng.choice([*VALUES, "none"])
    pool = rng.choice(list(VALUES.values())[:3])
    operator = rng.choice(["eq", "ne", "lt", "lte", "gt", "gte", "in", "contains"])
    if operator == "in":
        return Comparison(f, "in", tuple(rng.sample(pool, 2)))
    if operator in ("lt", "lte", "gt", "gte"):
        pool = VALUES[rng.choice(["n", "s"])]
    return Comparison(f, operator, rng.choice(pool))


@pytest.mark.parametrize("form", ["typed", "variant"])
def test_random_predicates(spark, form):
    rng = random.Random(5)
    docs = [random_doc(rng, k, form == "variant") for k in range(60)]
    if form == "typed":
        df = spark.createDataFrame([(d["id"], float(d["n"]) if "n" in d else None, d.get("s"), d.get("b"), d.get("l")) for d in docs], "id string, n double, s string, b boolean, l array<string>")
        c = Collection.typed("docs", df.cache(), limits=ANALYTIC)
    else:
        df = spark.createDataFrame([(d["id"], json.dumps(d)) for d in docs], "id string, text string").select("id", F.parse_json("text").alias("doc"))
        c = Collection.variant("docs", df.cache(), limits=ANALYTIC)
    for _ in range(25):
        e = random_expression(rng)
        assert [r["id"] for r in c.run(Query(e)).df.collect()] == [d["id"] for d in docs if truth(e, d)], e


def test_validation():
    f = Fields()
    for bad in (Query(f.a.eq(1), limit=0), Query(f.a.eq(1), limit=1001), Query(And(())), Query(f.a.in_([])), Query(f.a.lt(True)), Query(f.a.eq(float("nan"))), Query(f.a.eq(1), select=("id",)), Query(Comparison("a", "like", "x"))):
        with pytest.raises(QueryError):
            validate(bad)
    for bad in ("[]", '{"version": 2}', '{"version": 1, "where": {"field": "a", "not": {}}}', '{"version": 1, "surprise": 1}'):
        with pytest.raises(QueryError):
            from_json(bad)
    q = Query(Or((f.a.eq(1), Not(f.b.in_(["x"])))), (f.a.desc(),), 5)
    assert from_json(q.to_json()).to_json() == q.to_json()
    deep = f.a.eq(1)
    for _ in range(12):
        deep = Not(deep)
    with pytest.raises(QueryError):
        validate(Query(deep))


def test_plans():
    f, indexes = Fields(), (Index("two", ("a", "b")), Index("one", ("a",)), Index("range", ("c",), "range", ("d",)))
    assert choose(Query(f.id.eq("x")), indexes).kind == "point"
    assert choose(Query(f.id.eq("")), indexes).kind == "scan"
    assert choose(Query(And((f.id.eq("x"), f.a.eq(1)))), indexes).index_name == "one"
    assert choose(Query(And((f.b.eq(1), f.a.eq(1)))), indexes).index_name == "two"
    assert choose(Query(Or((f.a.eq(1), f.b.eq(1)))), indexes).kind == "scan"
    assert choose(Query(f.a.eq([1])), indexes).kind == "scan"
    assert choose(Query(f.c.gt(1), select=("d",)), indexes).covering and not choose(Query(f.c.gt(1)), indexes).covering
    assert choose(Query(f.c.gt(1)), indexes, available=frozenset(("one",))).kind == "scan"
    with pytest.raises(QueryError):
        Index("x", ("a", "b"), "range")


def test_bounds_and_pushdown(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
    c = Collection.typed("docs", df, limits=Limits(scan_default=20), indexes=(Index("n", ("n",)),))
    with pytest.raises(QueryError):
        c.where(lambda d: d.n.gt(1)).get()
    r = c.where(lambda d: d.n.eq(7)).run()
    assert r.plan.kind == "index" and r.scanned_documents == 1 and r.df.count() == 1
    assert c.get("7")["n"] == 7 and c.get("x") is None and c.get("") is None
    df.write.parquet(str(tmp_path / "t"))
    stored = Collection.typed("docs", spark.read.parquet(str(tmp_path / "t")), "n", limits=ANALYTIC, integer_id=True)
    plan = stored.where(lambda d: d.id.eq("7")).get()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n,7)" in plan
    assert stored.where(lambda d: d.id.eq("07")).get().count() == 0


def test_missing_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", None), ("c", 1), ("d", 0)], "id string, n int")
    c = Collection.typed("docs", df, limits=ANALYTIC)
    assert [r["id"] for r in c.order_by("n").get().collect()] == ["d", "b", "c", "a"]
    assert [r["id"] for r in c.order_by("n", "desc").get().collect()] == ["a", "b", "c", "d"]
    assert {r["id"] for r in c.filter(lambda r: r["n"] == 1).collect()} == {"b", "c"}
