"""Layers of whole documents in one Arrow batch: spans as arrays over all its texts, worked on without an exchange.

A document lies in one row, so what joins its own layers with one another needs no other row. All steps are linear in the
texts, or a binary search for each node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scholion.functions.types import FieldType

#: Bytes of texts that are worked on at once; a longer text is a batch of its own.
PIECE = 1 << 20


class Texts:
    """The texts of a batch as one run of bytes. Null texts are empty; ``known`` tells them apart."""

    def __init__(self, texts: pa.Array):
        self.known = texts.is_valid().to_numpy(zero_copy_only=False)
        whole = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = whole.buffers()
        ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        #: The first byte of each text, and the end.
        self.offsets = ends - ends[0]
        #: Code points before each byte, and all of them.
        self.points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.base = self.points[self.offsets]

    def row(self, at: np.ndarray) -> np.ndarray:
        """The text that a byte belongs to."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def place(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Code points of the text before a byte."""
        return (self.points[at] - self.base[row]).astype(np.int32)

    def byte(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The byte where a code point of a text starts."""
        return np.searchsorted(self.points, self.base[row] + place, "right") - 1

    def cut(self, edges: np.ndarray) -> pa.Array:
        """The strings between each two neighbouring edges, which are sorted bytes."""
        if len(edges) < 2:
            return pa.array([], pa.string())
        ends = pa.py_buffer((edges - edges[0]).astype(np.int64).tobytes())
        return pa.LargeStringArray.from_buffers(len(edges) - 1, ends, pa.py_buffer(self.data[edges[0] : edges[-1]].tobytes())).cast(pa.string())

    def between(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The strings of byte ranges that are sorted and do not overlap."""
        if not len(start):
            return pa.array([], pa.string())
        return self.cut(np.append(np.stack([start, stop], 1).ravel(), stop[-1])).take(pa.array(np.arange(len(start)) * 2))


@dataclass
class Nodes:
    """A layer: the text's row, node ids, and spans in code points, sorted by row and id."""

    row: np.ndarray
    node: np.ndarray
    start: np.ndarray
    stop: np.ndarray


@dataclass
class TextLayer:
    """A layer computed from texts: ``span`` is the field that holds its nodes' spans, ``strings`` are its other fields."""

    nodes: Nodes
    span: str
    strings: dict[str, pa.Array]

    def fields(self, context: str) -> dict[str, FieldType]:
        return {self.span: FieldType("span", context)} | {f: FieldType("str") for f in self.strings}


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``PIECE`` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        part = size // PIECE
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def counted(row: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal rows."""
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    begin = np.flatnonzero(new)
    return (np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))).astype(np.int32)


def runs(groups: Nodes, members: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """For each group the places of the first and the last member that overlaps it; last < first if there is none.

    Members do not overlap one another, and lie in order. An empty span counts as one of length one at its place.
    """
    # a text's places end before the next one's begin, with room for an empty span at its end
    size = int(max(groups.stop.max(initial=0), members.stop.max(initial=0))) + 2
    at = lambda nodes, x: nodes.row.astype(np.int64) * size + x
    first = np.searchsorted(at(members, np.maximum(members.stop, members.start + 1)), at(groups, groups.start), "right")
    last = np.searchsorted(at(members, members.start), at(groups, np.maximum(groups.stop, groups.start + 1)), "left") - 1
    return first, last


def inside(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of all places of the runs, ends included."""
    many = np.maximum(last - first + 1, 0)
    run = np.repeat(np.arange(len(many)), many)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + first[run]


def segments(texts: Texts, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, start, segment): the texts cut where their spans start and stop."""
    at = np.concatenate([texts.byte(nodes.row, nodes.start), texts.byte(nodes.row, nodes.stop), texts.offsets])
    edges = np.unique(at)
    row = texts.row(edges[:-1])
    return row, texts.place(edges[:-1], row), texts.cut(edges)


def checked(texts: Texts, nodes: Nodes) -> Nodes:
    """The nodes, if all their spans lie in their texts."""
    size = texts.base[nodes.row + 1] - texts.base[nodes.row]
    bad = np.flatnonzero((nodes.start < 0) | (nodes.start > nodes.stop) | (nodes.stop > size))
    if len(bad):
        raise ValueError(f"invalid spans, such as {[(int(nodes.node[k]), int(nodes.start[k]), int(nodes.stop[k])) for k in bad[:5]]}")
    return nodes


def by_document(docs: DataFrame, f: Callable[[Texts], tuple[np.ndarray, list[pa.Array]]], ddl: str) -> DataFrame:
    """Rows made of documents (doc_id, text): ``f`` gives for a batch's texts the row of each result and its other columns."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in ddl.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, columns = f(Texts(batch.column(1)))
            for lo in range(0, len(row), 1 << 17):
                part = [c.slice(lo, 1 << 17) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[lo : lo + (1 << 17)])), *part], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {ddl}")
