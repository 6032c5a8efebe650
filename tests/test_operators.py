"""Operators against fixed vectors, brute force and seeded faults."""

import random

import pytest
from pyspark.sql import functions as F

from scholion.functions import predicates as P
from scholion.functions import spans as S
from scholion.functions.types import FieldType, type_of, wider, with_default
from scholion.operators import graph, index, joins, layers, sequence, validate

SPAN = FieldType("span", "main")


def layer(spark, rows, field="text", dtype=SPAN):
    df = spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], "doc_id long, node_id int, start int, stop int")
    return df.select("doc_id", "node_id", dtype.column(F.struct("start", "stop"), field))


TOKENS = [(0, 2), (3, 5), (4, 6), (8, 11), (11, 12), (14, 15), (17, 17)]
GROUPS = [(0, 6), (1, 6), (2, 6), (4, 10), (4, 12), (8, 11), (16, 18), (20, 20)]
INTERSECT = [[1, 2, 3], [1, 2, 3], [2, 3], [2, 3, 4], [2, 3, 4, 5], [4], [7], []]
COVER = [[1, 2, 3], [2, 3], [2, 3], [3], [3, 4, 5], [4], [7], []]


@pytest.mark.parametrize("cover", [False, True])
def test_group_by_span(spark, cover):
    got = joins.group_by_span(layer(spark, GROUPS), "text", {"t": (layer(spark, TOKENS), "text")}, cover=cover)
    found = {r.node_id: [x + 1 for x in r.t] for r in got.collect()}
    assert found == dict(enumerate(COVER if cover else INTERSECT))
    some = joins.group_by_span(layer(spark, GROUPS), "text", {"t": (layer(spark, TOKENS), "text")}, cover=cover, include_empty=False)
    assert {r.node_id for r in some.collect()} == {k for k, v in enumerate(COVER if cover else INTERSECT) if v}


def test_overlap_random(spark):
    rng = random.Random(1)
    a, b = ([(s := rng.randrange(60), s + rng.randrange(12)) for _ in range(80)] for _ in range(2))
    got = {(r.group_id, r.member_id) for r in joins.overlapping(layer(spark, a), "text", layer(spark, b), "text", width=8).collect()}
    want = {(i, j) for i, (x, y) in enumerate(a) for j, (u, v) in enumerate(b) if u < max(y, x + 1) and x < max(v, u + 1)}
    assert got == want


def test_dominant_right(spark):
    rows = [(0, 3), (1, 4), (0, 1), (0, 6), (4, 5), (8, 10), (11, 15), (14, 16), (20, 25), (19, 21)]
    df = spark.createDataFrame([(0, a, b, k) for k, (a, b) in enumerate(rows)], "doc_id long, start int, stop int, ordinal int")
    assert [r.ordinal for r in sequence.dominant_right(df, "doc_id").orderBy("place").collect()] == [3, 5, 6, 8]


def test_dominant_right_forms_agree(spark, monkeypatch):
    rng = random.Random(2)
    data = [(g, s := rng.randrange(40), s + rng.randrange(9), k) for g in range(40) for k in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(data, "doc_id long, start int, stop int, ordinal int")
    folded = sorted(map(tuple, sequence.dominant_right(df, "doc_id").collect()))
    monkeypatch.setattr(sequence, "FOLDED", 0)
    assert folded == sorted(map(tuple, sequence.dominant_right(df, "doc_id").collect()))


def test_translate(spark):
    mapping = spark.createDataFrame([(0, 10, 15, 0, 5), (0, 20, 22, 5, 7), (0, 25, 27, 7, 9)], "doc_id long, a int, b int, c int, d int")
    mapping = mapping.select("doc_id", S.span(F.col("a"), F.col("b")).alias("raw"), S.span(F.col("c"), F.col("d")).alias("clean"))
    rows = joins.translate_spans(layer(spark, [(0, 3), (5, 9), (4, 7), (5, 9), (8, 12), (3, 3)], "clean"), "clean", mapping, "clean", "raw").orderBy("node_id").collect()
    assert [tuple(r.translated) if r.translated else r.violation for r in rows] == [(10, 13), (20, 27), (14, 22), (20, 27), "outside", "empty"]


@pytest.mark.parametrize("tokens, text, window, want", [
    ("A B C D E", "AB CD. E", (0, None), [(0, 1), (1, 2), (3, 4), (4, 5), (7, 8)]),
    ("A . B C D E", "AB CD E", (0, None), [(0, 1), (1, 1), (1, 2), (3, 4), (4, 5), (6, 7)]),
    ("A . B C D E", "AB C.D. E", (0, None), [(0, 1), (1, 1), (1, 2), (3, 4), (5, 6), (8, 9)]),
    ("B C D", "ABCDEF", (1, 3), [(1, 2), (2, 3), (3, 3)]),
])
def test_align(tokens, text, window, want):
    assert sequence.align(tokens.split(), text, *window, look_ahead=1) == want


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "f int")
    checks = {"eq": (P.eq("f", 1), [1, 0, 0]), "ne": (P.ne("f", 1), [0, 1, 1]), "lt": (P.lt("f", 2), [1, 0, 0]), "le": (P.le("f", 2), [1, 1, 0]), "gt": (P.gt("f", 1), [0, 1, 0]),
              "ge": (P.ge("f", 1), [1, 1, 0]), "any": (P.is_any("f", 1, None), [1, 0, 1]), "none": (P.is_none("f"), [0, 0, 1]), "has": (P.has_value("f"), [1, 1, 0])}
    row = df.select(*(c.alias(n) for n, (c, _) in checks.items()), *((~c).alias("not_" + n) for n, (c, _) in checks.items())).collect()
    for n, (_, want) in checks.items():
        assert [r[n] for r in row] == [bool(x) for x in want] and [r["not_" + n] for r in row] == [not x for x in want], n


def test_text_slices(spark):
    df = spark.createDataFrame([("This code was written in Lund, Sweden",)], "t string")
    t = F.col("t")
    cut = lambda a, b: S.covered_text(t, S.slice_text(t, None if a is None else F.lit(a), None if b is None else F.lit(b)))
    s = S.span(F.lit(14), F.lit(21))
    sub = lambda a, b, **k: S.covered_text(t, S.sub_span(s, None if a is None else F.lit(a), None if b is None else F.lit(b), **k))
    got = df.select(cut(None, 4), cut(31, None), cut(14, 21), cut(-4, -2), S.char_at(t, None, 0), S.char_at(t, None, -1), sub(0, 2), sub(2, 5), sub(2, 5, clamp=False), sub(None, -2), sub(-2, None), S.char_at(t, s, 0), S.char_at(t, s, -1)).first()
    assert list(got) == ["This", "Sweden", "written", "ed", "T", "n", "wr", "itt", "itt", "writt", "en", "w", "n"]


def test_trim(spark):
    df = spark.createDataFrame([("  a b \x1c",), ("   ",), ("ab",), ("a ",)], "t string")
    rows = df.select(*(S.trim(F.col("t"), S.span(F.lit(0), F.char_length("t")), m).alias(m) for m in ("both", "left", "right", "either"))).collect()
    assert [tuple(r.both) for r in rows] == [(2, 5), (3, 3), (0, 2), (0, 1)]
    assert tuple(rows[0].either) == (2, 7) and tuple(rows[3].either) == (0, 1) and tuple(rows[0].right) == (0, 5)


def test_code_points(spark):
    df = spark.createDataFrame([("a😀b",)], "t string")
    assert df.select(S.covered_text(F.col("t"), S.span(F.lit(1), F.lit(2)))).first()[0] == "😀"
    segments = df.select(S.text_segments(F.col("t"), F.array(F.lit(2))).alias("s")).select("s", S.segment_offsets(F.col("s")).alias("o")).first()
    assert segments.s == ["a😀", "b"] and segments.o == [0, 2, 3]


def test_references_follow_renumbering(spark):
    ref, many, run = FieldType("noderef", "token"), FieldType("noderef_array", "token"), FieldType("nodespan", "token")
    token = spark.createDataFrame([(0, k, f"t{k}") for k in range(6)], "doc_id long, node_id int, word string")
    other = spark.createDataFrame([(0, 0, 2, [5, 1, 0], 0, 3), (0, 1, 1, None, 1, 1)], "doc_id long, node_id int, r int, m array<int>, a int, b int")
    other = other.select("doc_id", "node_id", ref.column(F.col("r"), "r"), many.column(F.col("m"), "m"), run.column(F.struct(F.col("a").alias("left"), F.col("b").alias("right")), "s"))
    token = layers.remove_nodes(token, token.where("node_id = 1"))
    out = layers.renumber({"token": token, "other": other}, "token")
    assert [r.word for r in out["token"].orderBy("node_id").collect()] == ["t0", "t2", "t3", "t4", "t5"]
    rows = out["other"].orderBy("node_id").collect()
    assert (rows[0].r, rows[0].m, tuple(rows[0].s)) == (1, [4, 0], (0, 2)) and (rows[1].r, rows[1].m, rows[1].s) == (None, None, None)
    assert FieldType.of(out["other"].schema["s"]) == run
    assert layers.referring_fields(out, "layer", "token") == [("other", "r"), ("other", "m"), ("other", "s")]
    with pytest.raises(ValueError):
        layers.remove_layer(out, "token")
    assert layers.remove_layer(out, "token", cascade=True)["other"].columns == ["doc_id", "node_id"]


def test_validation(spark):
    texts = spark.createDataFrame([(0, "main", "abcdef")], "doc_id long, context string, text string")
    good = layer(spark, [(0, 2), (2, 6)])
    assert validate.violations({"token": good}, texts).count() == 0
    bad = layer(spark, [(0, 2), (3, 9), (4, 2)])
    assert sorted((r.node_id, r.rule) for r in validate.violations({"token": bad}, texts).collect()) == [(1, "beyond_text"), (2, "span_order")]
    assert validate.missing_targets({"a": layers.add_field(good, "r", FieldType("noderef", "b"))}) == [("a", "r", "b")]
    assert validate.undeclared_fields(good.withColumn("extra", F.lit(1)), ["text"]) == ["extra"]
    with pytest.raises(ValueError):
        validate.compiled({"token": bad}, texts)
    with pytest.raises(ValueError):
        validate.compiled({"token": good}, texts, declared={"token": []})


def test_walks(spark):
    # a diamond and a cycle: 0 -> 1, 2; 1 -> 3; 2 -> 3; 3 -> 0, 4
    data = [(0, 0, 0, 0, 1), (0, 0, 0, 1, 2), (0, 1, 0, 0, 3), (0, 2, 0, 0, 3), (0, 3, 0, 0, 0), (0, 3, 0, 1, 4)]
    edge = spark.createDataFrame(data, "doc_id long, src int, ord int, pos int, dst int")
    start = spark.createDataFrame([(0, 0)], "doc_id long, node_id int")
    assert dict((r.node_id, r.depth) for r in graph.bfs(edge, start).collect()) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    rows = graph.dfs(edge, start).orderBy("place").collect()
    assert [r.node_id for r in rows] == [0, 1, 3, 4, 2] and [r.node_id for r in rows if r.leaf] == [4, 2]
    with pytest.raises(ValueError):
        graph.edges(start)


def test_forest_paths(spark):
    spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 3, 0)], "src int, dst int, pos int").createOrReplaceTempView("tree_")
    spark.createDataFrame([(0,)], "node_id int").createOrReplaceTempView("roots_")
    assert [r.node_id for r in graph.forest_paths(spark, "tree_", "roots_").orderBy("path").collect()] == [0, 1, 3, 2]


def test_types():
    assert type_of(True).kind == "i1" and type_of(3).kind == "i32" and type_of(2**40).kind == "i64" and type_of(1.5).kind == "f64"
    assert wider(FieldType("i1"), FieldType("f64")).kind == "f64" and wider(FieldType("str"), FieldType("i32")) is None
    assert with_default("str").default == "" and with_default("bin").default is None
    with pytest.raises(ValueError):
        FieldType("span")


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", "x"), (1, "a", None), (2, "b", "x")], "doc_id long, p string, q string")
    postings = index.property_postings(docs, "p", "q")
    assert postings.count() == 5 and [r.doc_id for r in index.search(postings, p="a", q="x").collect()] == [0]
    assert index.search(postings).count() == 0
    index.save_index(postings, str(tmp_path / "i"))
    assert [r.doc_id for r in index.search(index.load_index(spark, str(tmp_path / "i")), q="x").orderBy("doc_id").collect()] == [0, 2]
