import pytest

from weftwork.operators.shapes import Closed, Count, Has, Shape, Targets, Unique, violations

NODE = "source string, kind string, iri string, class_iri string, name string, _in string, _s0 string"
EDGE = "source string, src_kind string, src_iri string, label string, dst_iri string, _what int"


def found(spark, nodes, edges, shapes, under=()):
    n = spark.createDataFrame([("s", *r, "x", "y") for r in nodes], NODE)
    e = spark.createDataFrame([("s", *r, 1) for r in edges], EDGE)
    u = spark.createDataFrame(list(under), "src_iri string, dst_iri string")
    return sorted((r["shape"], r.kind, r.iri, r.rule, r.found) for r in violations(n, e, shapes, u).collect())


def test_each_constraint(spark):
    nodes = [
        ("entity", "a", "dog", "A"), ("entity", "b", "cat", None), ("entity", "c", None, "A"), ("class", "a", None, "A"),
        ("entity", "d", "animal", "A"), ("entity", "d", None, None), ("entity", "e", "dog", "E"), ("entity", "e", "dog", "E"),
    ]
    edges = [
        ("entity", "a", "likes", "b"), ("entity", "a", "likes", "b"), ("entity", "a", "likes", "gone"), ("entity", "b", None, "a"), ("entity", "b", "likes", None),
        ("class", "a", "likes", "b"), ("entity", "nowhere", "likes", "b"), ("entity", "d", "eats", "c"), ("entity", "e", "likes", "a"),
    ]
    pets = Shape("pet", (Count("likes", 1, 2), Targets("likes", ("animal",)), Closed(("likes",)), Has("name"), Unique("name")), "entity", ("animal",))
    assert found(spark, nodes, edges, [pets], [("dog", "animal"), ("cat", "animal")]) == [
        ("pet", "entity", "a", "likes 1..2", 3), ("pet", "entity", "a", "likes to animal", 1), ("pet", "entity", "a", "name unique", 2),
        ("pet", "entity", "b", "likes to animal", 1), ("pet", "entity", "b", "name required", 0), ("pet", "entity", "b", "only likes", 1),
        ("pet", "entity", "d", "likes 1..2", 0), ("pet", "entity", "d", "name unique", 2), ("pet", "entity", "d", "only likes", 1),
    ]


def test_several_shapes_and_none(spark):
    shapes = [Shape("all", (Count("x", 1),)), Shape("classes", (Has("_in"), Unique("_in")), "class")]
    assert found(spark, [("entity", "a", None, None), ("class", "a", None, None)], [("entity", "a", "x", "a")], shapes) == [("all", "class", "a", "x 1..*", 0)]
    assert found(spark, [], [("entity", "a", "x", "a")], shapes) == []
    assert found(spark, [("entity", "a", None, None)], [], [Shape("bare", ())]) == []
    with pytest.raises(ValueError):
        found(spark, [], [], [Shape("a", ()), Shape("a", ())])


def test_hot_node_is_combined_before_its_shuffle(spark):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([("s", "entity", "hub", "k", "h", "", "")], NODE)
    edges = spark.range(20000).select(F.lit("s").alias("source"), F.lit("entity").alias("src_kind"), F.lit("hub").alias("src_iri"), F.lit("x").alias("label"), F.col("id").cast("string").alias("dst_iri"))
    got = violations(nodes, edges, [Shape("s", (Count("x", 0, 5), Targets("x", ("k",))))])
    assert {(r.rule, r.found) for r in got.collect()} == {("x 0..5", 20000), ("x to k", 20000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_count_if" in plan or "partial_count" in plan
