"""Joins along references and spans: dereferencing, node runs, neighbours, overlap grouping, span translation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.functions.spans import overlap, span
from scholion.operators.layers import by_node

#: Code points of a bin of the overlap join. A span is copied to each bin it touches.
BIN = 256


def _prefixed(layer: DataFrame, prefix: str) -> DataFrame:
    return layer.select("doc_id", *(F.col(c).alias(prefix + c) for c in layer.columns if c != "doc_id"))


def deref(layer: DataFrame, ref: str, target: DataFrame, prefix: str = "ref_") -> DataFrame:
    """Each node with the fields of the node that ``ref`` names; null fields if it names none."""
    t = _prefixed(target, prefix)
    return layer.join(t, (layer["doc_id"] == t["doc_id"]) & (layer[ref] == t[prefix + "node_id"]), "left").drop(t["doc_id"])


def deref_many(layer: DataFrame, refs: str, target: DataFrame, value: str) -> DataFrame:
    """(doc_id, node_id, values): the target's values in the order of the reference list."""
    each = layer.select("doc_id", "node_id", F.posexplode(refs).alias("at_", "to_"))
    t = target.select("doc_id", F.col("node_id").alias("to_"), F.col(value).alias("v_"))
    lists = each.join(t, ["doc_id", "to_"]).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("at_", "v_"))).alias("l_"))
    return lists.select("doc_id", "node_id", F.transform("l_", lambda x: x["v_"]).alias("values"))


def expand_node_span(layer: DataFrame, field: str, target: DataFrame, prefix: str = "in_") -> DataFrame:
    """A row for each node of the run that ``field`` names, ends included; gaps are skipped, the ends may be swapped."""
    left, right = F.least(f"{field}.left", f"{field}.right"), F.greatest(f"{field}.left", f"{field}.right")
    each = layer.where(F.col(field).isNotNull()).withColumn(prefix + "node_id", F.explode(F.sequence(left, right)))
    return each.join(_prefixed(target, prefix), ["doc_id", prefix + "node_id"])


def node_span_extent(layer: DataFrame, field: str, target: DataFrame, span_field: str) -> DataFrame:
    """Each node with ``extent``: the text span from the run's left node to its right node."""
    left = target.select("doc_id", F.col("node_id").alias("l_"), F.col(f"{span_field}.start").alias("start_"))
    right = target.select("doc_id", F.col("node_id").alias("r_"), F.col(f"{span_field}.stop").alias("stop_"))
    rows = layer.withColumn("l_", F.col(f"{field}.left")).withColumn("r_", F.col(f"{field}.right"))
    rows = rows.join(left, ["doc_id", "l_"], "left").join(right, ["doc_id", "r_"], "left")
    return rows.select(*layer.columns, F.when(F.col("start_").isNotNull() & F.col("stop_").isNotNull(), span(F.col("start_"), F.col("stop_"))).alias("extent"))


def neighbours(layer: DataFrame) -> DataFrame:
    """Each node with the ids of its nearest left and right nodes, null at the edges."""
    return layer.withColumn("left_id", F.lag("node_id").over(by_node())).withColumn("right_id", F.lead("node_id").over(by_node()))


def overlapping(groups: DataFrame, group_span: str, members: DataFrame, member_span: str, cover: bool = False, width: int = BIN) -> DataFrame:
    """(doc_id, group_id, member_id, member_start, member_stop) of all overlaps; with ``cover`` of members inside the group.

    Spans meet in bins of ``width`` code points, an equi join on (doc_id, bin) that costs about the size of its result
    for spans of any document length; a pair is reported in the bin where the later of its starts lies. An empty span
    counts as one of length one at its place, cover compares true stops.
    """

    def binned(layer: DataFrame, field: str, names: list[str]) -> DataFrame:
        s = F.col(field)
        last = F.greatest(s["stop"], s["start"] + 1) - 1
        bins = F.sequence(F.floor(s["start"] / width).cast("int"), F.floor(last / width).cast("int"))
        return layer.where(s.isNotNull()).select("doc_id", F.col("node_id").alias(names[0]), s["start"].alias(names[1]), s["stop"].alias(names[2]), F.explode(bins).alias("bin"))

    g = binned(groups, group_span, ["group_id", "g_start", "g_stop"])
    m = binned(members, member_span, ["member_id", "member_start", "member_stop"])
    hit = overlap(F.col("member_start"), F.col("member_stop"), F.col("g_start"), F.col("g_stop"))
    hit = hit & (F.floor(F.greatest("g_start", "member_start") / width) == F.col("bin"))
    if cover:
        hit = hit & (F.col("member_start") >= F.col("g_start")) & (F.col("member_stop") <= F.col("g_stop"))
    return g.join(m, ["doc_id", "bin"]).where(hit).select("doc_id", "group_id", "member_id", "member_start", "member_stop")


def group_by_span(groups: DataFrame, group_span: str, members: dict[str, tuple[DataFrame, str]], cover: bool = False, include_empty: bool = True) -> DataFrame:
    """Groups with an array of member ids for each layer, members in order of (start, stop, id).

    members: layer and span field by name. Groups with no member in any layer stay only with ``include_empty``.
    """
    out = groups.where(F.col(group_span).isNotNull())
    for name, (layer, field) in members.items():
        pairs = overlapping(groups, group_span, layer, field, cover)
        lists = pairs.groupBy("doc_id", F.col("group_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("member_start", "member_stop", "member_id"))).alias("l_"))
        lists = lists.select("doc_id", "node_id", F.transform("l_", lambda x: x["member_id"]).alias(name))
        out = out.join(lists, ["doc_id", "node_id"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    if not include_empty:
        out = out.where(reduce(Column.__or__, (F.size(n) > 0 for n in members)))
    return out


def group_counts(groups: DataFrame, group_span: str, members: DataFrame, member_span: str, cover: bool = False, include_empty: bool = True) -> DataFrame:
    """(doc_id, node_id, n, first, last): number of members of each group and its smallest and largest member ids.

    Partial aggregates instead of lists, for groups of any size.
    """
    pairs = overlapping(groups, group_span, members, member_span, cover)
    counts = pairs.groupBy("doc_id", F.col("group_id").alias("node_id")).agg(F.count("*").alias("n"), F.min("member_id").alias("first"), F.max("member_id").alias("last"))
    if not include_empty:
        return counts
    every = groups.where(F.col(group_span).isNotNull()).select("doc_id", "node_id")
    return every.join(counts, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("n", F.lit(0)).alias("n"), "first", "last")


def translate_spans(spans: DataFrame, field: str, mapping: DataFrame, source: str, target: str, out: str = "translated", done: str | None = None) -> DataFrame:
    """Map spans of an extracted text back to the original through ``mapping(doc_id, source span, target span)``.

    A start maps as target.start + (start - source.start) in the mapping interval that holds it, a stop as the image
    of its last character plus one. ``violation`` names rows that cannot be mapped (a place outside all intervals, an
    empty span); rows whose field ``done`` is set keep it. One sorted pass for each document: the last interval that
    begins at or before a place is the only one that can hold it.
    """
    s = F.col(field)
    rows = spans.withColumn("row_", F.monotonically_increasing_id()) if "node_id" not in spans.columns else spans.withColumn("row_", F.col("node_id"))
    m, t = F.col(source), F.col(target)
    starts = mapping.where(m["stop"] > m["start"]).select("doc_id", m["start"].alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.struct(m["start"].alias("a"), m["stop"].alias("b"), t["start"].alias("to")).alias("m_"))
    points = rows.where(s.isNotNull()).select("doc_id", F.col("row_").cast("long").alias("row"), F.explode(F.array(F.struct(F.lit(1).alias("kind"), s["start"].alias("at")), F.struct(F.lit(2).alias("kind"), (s["stop"] - 1).alias("at")))).alias("p"))
    points = points.select("doc_id", "p.at", "p.kind", "row", F.lit(None).cast(starts.schema["m_"].dataType).alias("m_"))
    order = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(points).withColumn("in_", F.last("m_", ignorenulls=True).over(order)).where("kind > 0")
    image = F.when(F.col("at") < F.col("in_.b"), F.col("in_.to") + F.col("at") - F.col("in_.a"))
    ends = placed.groupBy("doc_id", "row").agg(F.max(F.when(F.col("kind") == 1, image)).alias("start_"), F.max(F.when(F.col("kind") == 2, image + 1)).alias("stop_"))
    joined = rows.join(ends.withColumnRenamed("row", "row_"), ["doc_id", "row_"], "left")
    bad = F.when(s["stop"] <= s["start"], "empty").when(F.col("start_").isNull() | F.col("stop_").isNull(), "outside")
    value, fault = F.when(bad.isNull(), span(F.col("start_"), F.col("stop_"))), F.when(s.isNotNull(), bad)
    if done is not None:
        value, fault = F.coalesce(F.col(done), value), F.when(F.col(done).isNull(), fault)
    return joined.select(*spans.columns, value.alias(out), fault.alias("violation"))
