"""Sequential algorithms within a document: overlap resolution and alignment of tokens to text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments of one group that are folded inside the JVM, where each result copies the list so far; larger groups go to Arrow.
FOLDED = 2_000


def _fold(segments: Column) -> Column:
    """Greedy sweep over an array of (start, stop, ordinal): the ordinals that win, in order of closing."""
    none = F.lit(None)
    event = lambda s, at, mark: F.struct(at.alias("at"), F.lit(mark).alias("mark"), s["ordinal"].alias("ordinal"), (s["stop"] - s["start"]).alias("size"))
    both = F.transform(segments, lambda s: F.array(event(s, s["start"], 0), event(s, F.greatest(s["stop"] - 1, s["start"]), 1)))
    events = F.array_sort(F.flatten(both))
    start = F.struct(none.cast("bigint").alias("open"), none.cast("bigint").alias("size"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        opens = (e["mark"] == 0) & (acc["open"].isNull() | (e["size"] >= acc["size"]))
        closes = (e["mark"] == 1) & acc["open"].eqNullSafe(e["ordinal"])
        return F.struct(
            F.when(opens, e["ordinal"]).when(closes, none).otherwise(acc["open"]).alias("open"),
            F.when(opens, e["size"]).when(closes, none).otherwise(acc["size"]).alias("size"),
            F.when(closes, F.concat(acc["out"], F.array(e["ordinal"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(events, start, step, lambda acc: acc["out"])


def sweep(segments: list[tuple[int, int, int]]) -> list[int]:
    """The same sweep over Python values."""
    events = []
    for start, stop, ordinal in segments:
        events += [(start, 0, ordinal, stop - start), (max(stop - 1, start), 1, ordinal, stop - start)]
    held, size, out = None, 0, []
    for _, mark, ordinal, n in sorted(events):
        if mark == 0:
            if held is None or n >= size:
                held, size = ordinal, n
        elif held == ordinal:
            out.append(ordinal)
            held = None
    return out


def dominant_right(segments: DataFrame, *keys: str, start: str = "start", stop: str = "stop", ordinal: str = "ordinal") -> DataFrame:
    """Resolve overlaps in each group of ``keys``: (keys, ordinal, place) of the segments that stay, in order of closing.

    Longer segments win, of equal ones the one further right. A segment that opens while a shorter or equal one is open
    replaces it, and the replaced one is lost even if its successor is replaced later. Segments without a start or stop are
    skipped; ``ordinal`` (unique in its group) breaks ties.
    """
    rows = segments.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    rows = rows.select(*keys, F.col(start).cast("bigint").alias("start"), F.col(stop).cast("bigint").alias("stop"), F.col(ordinal).cast("bigint").alias("ordinal"))
    grouped = rows.groupBy(*keys).agg(F.collect_list(F.struct("start", "stop", "ordinal")).alias("segments"))
    small = grouped.where(F.size("segments") <= FOLDED).select(*keys, F.posexplode(_fold(F.col("segments"))).alias("place", "ordinal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                won = sweep([(s["start"], s["stop"], s["ordinal"]) for s in batch.column(len(keys))[k].as_py()])
                at = pa.array([k] * len(won), pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keys)]), pa.array(range(len(won)), pa.int32()), pa.array(won, pa.int64())], [*keys, "place", "ordinal"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields)
    large = grouped.where(F.size("segments") > FOLDED).mapInArrow(run, ddl)
    return small.union(large)


def dominant_spans(layer: DataFrame, field: str) -> DataFrame:
    """The nodes of a layer that stay when overlaps of their span field are resolved; nodes without it are skipped."""
    rows = layer.select("doc_id", F.col(f"{field}.start").alias("start"), F.col(f"{field}.stop").alias("stop"), F.col("node_id").alias("ordinal"))
    kept = dominant_right(rows, "doc_id").select("doc_id", F.col("ordinal").cast("int").alias("node_id"), "place")
    return layer.join(kept, ["doc_id", "node_id"])


def dominant_node_spans(layer: DataFrame, field: str) -> DataFrame:
    """The same over node runs, which hold the nodes from left to right, both included."""
    rows = layer.select("doc_id", F.col(f"{field}.left").alias("start"), (F.col(f"{field}.right") + 1).alias("stop"), F.col("node_id").alias("ordinal"))
    kept = dominant_right(rows, "doc_id").select("doc_id", F.col("ordinal").cast("int").alias("node_id"), "place")
    return layer.join(kept, ["doc_id", "node_id"])


def align(tokens: list[str], text: str, start: int = 0, stop: int | None = None, look_ahead: int = 0) -> list[tuple[int, int]]:
    """Spans of a token sequence in a text.

    A token is sought from the end of the last match on; one that is absent is empty there. If one of the next
    ``look_ahead`` tokens stands strictly before it, the tokens up to that one are empty and that one is matched.
    """
    stop = len(text) if stop is None else stop
    out: list[tuple[int, int]] = []
    at, i = start, 0
    while i < len(tokens):
        found = text.find(tokens[i], at, stop)
        if found < 0:
            out.append((at, at))
            i += 1
            continue
        for j in range(1, min(look_ahead, len(tokens) - i - 1) + 1):
            other = text.find(tokens[i + j], at, found + len(tokens[i + j])) if found else -1
            if 0 <= other < found and other + len(tokens[i + j]) <= stop:
                out += [(at, at)] * j
                i, found = i + j, other
                break
        at = found + len(tokens[i])
        out.append((found, at))
        i += 1
    return out


def align_tokens(docs: DataFrame, tokens: str = "tokens", text: str = "text", look_ahead: int = 0, start: str | None = None, stop: str | None = None) -> DataFrame:
    """(doc_id, node_id, start, stop) of each document's tokens, an array of strings, in its text.

    The scan depends on the last match, so it runs as a loop over Arrow batches: linear in the text, where a fold in the
    JVM would search each token from the text's start. Documents with a null text or no tokens give no rows.
    """
    rows = docs.select("doc_id", tokens, text, F.col(start).cast("int").alias("a_") if start else F.lit(0).alias("a_"), F.col(stop).cast("int").alias("b_") if stop else F.lit(None).cast("int").alias("b_"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                doc, words, body, a, b = (batch.column(c)[k].as_py() for c in range(5))
                if not words or body is None:
                    continue
                spans = align(words, body, a or 0, b, look_ahead)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"doc_id": doc, "node_id": range(len(spans)), "start": [s for s, _ in spans], "stop": [e for _, e in spans]}), schema=schema, preserve_index=False)

    schema = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("node_id", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
    return rows.mapInArrow(run, f"doc_id {kind}, node_id int, start int, stop int")
