import pytest
from pyspark.sql import functions as F

from scholion.functions import spans as S
from scholion.functions.types import FieldType
from scholion.operators import graph, layers


def people(spark):
    rows = spark.createDataFrame([(0, 0, "Ann", 0, 3), (0, 2, "Bo", 8, 10), (1, 0, None, None, None)], "doc_id long, node_id int, name string, a int, b int")
    span = F.when(F.col("a").isNotNull(), S.span(F.col("a"), F.col("b")))
    return rows.select("doc_id", "node_id", FieldType("str").column(F.col("name"), "name"), FieldType("span", "main").column(span, "place"))


def test_export_and_pandas(spark):
    main = spark.createDataFrame([(0, "main", "Ann and Bo")], "doc_id long, context string, text string")
    rows = layers.export(people(spark), main, ("place",), ref=True).orderBy("doc_id", "__ref").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "Ann"), (0, 2, "Bo"), (1, 0, None)]
    frame = layers.to_pandas(people(spark), main)
    assert list(frame.columns) == ["doc_id", "name", "place"] and list(frame["place"][:2]) == ["Ann", "Bo"]
    raw = layers.to_pandas(people(spark), fields=("place",), ref=True)
    assert list(raw["__ref"]) == [0, 2, 0] and tuple(raw["place"][1]) == (8, 10)


def test_contains_and_add_layer(spark):
    wanted = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 0)], "doc_id long, node_id int")
    found = layers.contains(people(spark), wanted).orderBy("doc_id", "node_id").collect()
    assert [r.present for r in found] == [True, False, True, False]
    both = layers.add_layer({"a": people(spark)}, "b", people(spark))
    assert sorted(both) == ["a", "b"] and sorted(layers.add_layer(both, "b", people(spark), replace=True)) == ["a", "b"]
    with pytest.raises(ValueError):
        layers.add_layer(both, "a", people(spark))


def test_add_text_once(spark):
    kind = "doc_id long, context string, text string"
    old = spark.createDataFrame([(0, "main", "x")], kind)
    new = spark.createDataFrame([(0, "main", "y"), (0, "title", "b"), (0, "title", "a"), (1, "main", None)], kind)
    rows = {tuple(r) for r in layers.add_text(old, new).collect()}
    assert rows == {(0, "main", "x"), (0, "title", "a"), (1, "main", None)}
    assert layers.add_text(old, new).count() == 3


def test_added_nodes_have_a_fixed_order(spark):
    new = spark.createDataFrame([(0, "Cy"), (0, "Abe"), (1, None), (1, "Dee")], "doc_id long, name string")
    ids = [{(r.doc_id, r.name): r.node_id for r in layers.add_nodes(people(spark).drop("place"), new.repartition(n)).where("name in ('Cy', 'Abe', 'Dee')").collect()} for n in (1, 3)]
    assert ids[0] == ids[1] and {ids[0][0, "Cy"], ids[0][0, "Abe"]} == {3, 4}


def test_dfs_results(spark):
    edge = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 0, 0, 1, 2), (0, 1, 0, 0, 0), (0, 1, 0, 1, 3)], "doc_id long, src int, ord int, pos int, dst int")
    start = spark.createDataFrame([(0, 0)], "doc_id long, node_id int")
    assert [r.node_id for r in graph.dfs(edge, start, F.col("node_id") % 2 == 1).orderBy("place").collect()] == [1, 3]


def test_deep_forest_is_an_error(spark):
    spark.createDataFrame([(k, k + 1, 0) for k in range(4)], "src int, dst int, pos int").createOrReplaceTempView("deep_")
    spark.createDataFrame([(0,)], "node_id int").createOrReplaceTempView("deep_roots_")
    assert graph.forest_paths(spark, "deep_", "deep_roots_", depth=4).count() == 5
    with pytest.raises(Exception, match="more than 3 levels"):
        graph.forest_paths(spark, "deep_", "deep_roots_", depth=3).collect()


def test_span_equals_text(spark):
    row = spark.createDataFrame([("the cat",), (None,)], "t string")
    out = row.select(S.text_equals(F.col("t"), S.span(F.lit(4), F.lit(7)), F.lit("cat")).alias("x")).collect()
    assert [r.x for r in out] == [True, False]
