"""Exact removal of repeated passages over a corpus, by longest previous factors in suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from scholion.llm.bytesets import CHUNK, chunks, mix, prefix_sums, span_hashes
from scholion.llm.workers import lean
from scholion.session import materialize, null_safe

#: Bytes of segments whose suffixes are sorted at once; a group of segments beyond it is sorted in parts of that size.
SORTED = 1 << 20
#: Anchors that a task holds to settle equal segments among them before the exchange.
HELD = 1 << 19
#: Different segments of one anchor that are compared by their contexts; where there are more, all of them are cut out.
COMPARED = 1 << 17
LEAST_ID = -(2**63)


def previous_factors(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each position in ``at`` (ascending) the length, up to ``length``, of the longest factor that also starts at an
    earlier one of them.

    The suffixes are ranked by doubling, down to ``length`` bytes. The earlier match with the longest common prefix
    stands, in suffix order, at the previous or at the next smaller position.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    length = max(length, 8)
    n = len(data) + 2 * length + 8
    padded = np.zeros(n + 8, np.uint64)
    padded[: len(data)] = data
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | padded[k : k + n]
    levels, depth = [(8, np.unique(head, return_inverse=True)[1])], 8
    while 2 * depth <= length:
        rank = levels[-1][1]
        after = np.zeros(n, np.int64)
        after[: n - depth] = rank[depth:]
        depth *= 2
        levels.append((depth, np.unique(rank * n + after, return_inverse=True)[1]))
    rank = levels[-1][1]
    order = np.lexsort((rank[at + length - depth], rank[at]))  # stable: equal suffixes stand in order of position

    def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        size = np.zeros(len(p), np.int64)
        for step, ranks in reversed(levels):
            size += step * (ranks[p + size] == ranks[q + size])
        differ = head[np.minimum(p + size, n - 1)] ^ head[np.minimum(q + size, n - 1)]
        size += sum((differ < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 9))
        return np.minimum(size, length)

    m, out = len(at), np.zeros(len(at), np.int64)
    for ahead in (False, True):
        # the nearest smaller position in suffix order, before and after: pointers jump over larger ones, all at once
        line = order[::-1] if ahead else order
        near = np.arange(-1, m - 1)
        while True:
            wrong = np.flatnonzero((near >= 0) & (line[near] > line))
            if not len(wrong):
                break
            near[wrong] = near[near[wrong]]
        has = np.flatnonzero(near >= 0)
        p, q = line[has], line[near[has]]
        out[p] = np.maximum(out[p], common(at[p], at[q]))
    return np.minimum(out, len(data) - at)


def longest_previous_factors(data: bytes) -> list[int]:
    """For each position of the data the length of the longest factor that also starts earlier."""
    return previous_factors(np.frombuffer(data, np.uint8), np.arange(len(data)), len(data)).tolist()


def _half(length: int, k: int) -> int:
    """Bytes beside the anchor: a window holds so many on its left, or so many on its right."""
    return (length - k + 1) // 2


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes with the same anchor: row, first window, windows, anchor's offset in the first
    window, key, segment.

    The anchor of a window is its leftmost k-gram of smallest hash, so windows of equal bytes have equal anchors. The
    key holds 48 bits of the anchor and 8 of each context of ``_half`` bytes beside it (0: the run does not hold that
    many); segment is a hash of all bytes of the run.
    """
    w, n = length - k + 1, len(data) - k + 1
    sizes = np.diff(offsets)
    many = np.maximum(0, sizes - length + 1)
    if not many.sum():
        return tuple(np.zeros(0, t) for t in (np.int64,) * 6)
    sums, at = prefix_sums(data), np.arange(n)
    h = span_hashes(sums, at, at + k)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (h & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), many)
    start = np.arange(len(row)) + (offsets[:-1] - np.cumsum(many) + many)[row]
    anchor = low[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(start)))
    row, start, anchor = row[begin], start[begin], anchor[begin]
    stop, half = start + windows + length - 1, _half(length, k)
    left = span_hashes(sums, np.maximum(anchor - half, start), anchor) % np.uint64(255) + np.uint64(1)
    right = span_hashes(sums, anchor + k, np.minimum(anchor + k + half, stop)) % np.uint64(255) + np.uint64(1)
    left[anchor - start < half] = 0
    right[stop - anchor - k < half] = 0
    key = (mix(h[anchor]) & np.uint64(0xFFFFFFFFFFFF0000)) | (left << np.uint64(8)) | right
    return row, start, windows, anchor - start, key.view(np.int64), span_hashes(sums, start, stop).view(np.int64)


def _joined(d: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by document, runs that follow one another as one."""
    order = np.lexsort((first, d))
    d, first, windows = d[order], first[order], windows[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (first[1:] != first[:-1] + windows[:-1])
    begin = np.flatnonzero(new)
    return d[begin], first[begin], np.add.reduceat(windows, begin) if len(begin) else windows


ANCHORS = ["key", "segment", "d", "at"]


def _anchors(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(key, segment, d, at) of texts(d, text); ``at`` packs first window (31 bits), windows (7) and the anchor's offset (7).

    Runs whose segment came before among those that the task holds are repeats at once: they come out with ``at``
    -1 - first window, the number of windows in place of the segment, and a key that only spreads them.
    """

    def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        for lo, hi, data, offsets in chunks(column):
            if hi == lo + 1 and len(data) > 2 * CHUNK:  # a long text, piece by piece
                for a in range(0, len(data) - length + 1, CHUNK):
                    part = data[a : a + CHUNK + length - 1]
                    yield lo, part, np.array([0, len(part)]), a
            else:
                yield lo, data, offsets, 0

    def settled(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, segment, d, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, d, key, segment))
        key, segment, d, at = key[order], segment[order], d[order], at[order]
        same, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
        same[1:] = (segment[1:] == segment[:-1]) & (key[1:] == key[:-1])
        twice[1:] = same[1:] & (d[1:] == d[:-1]) & (at[1:] == at[:-1])  # a repeated row of the input
        again = same & ~twice
        d2, first, windows = _joined(d[again], at[again] >> 14, (at[again] >> 7) & 127)
        spread = mix((d2 + (first << 20)).view(np.uint64)).view(np.int64)
        cols = [(key[~same], spread), (segment[~same], windows), (d[~same], d2), (at[~same], -1 - first)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            d = batch.column(0).to_numpy()
            for lo, data, offsets, shift in pieces(batch.column(1)):
                row, start, windows, inside, key, segment = _runs(data, offsets, length, k)
                held.append([key, segment, d[lo + row], ((start - offsets[row] + shift) << 14) | (windows << 7) | inside])
                n += len(row)
                if n > HELD:
                    yield settled(held)
                    held, n = [], 0
        if n:
            yield settled(held)

    return texts.select("d", "text").mapInArrow(lean(run), "key long, segment long, d long, at long")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_anchors``, sorted by anchor, segment, d and at, become (d, first, windows, open).

    Of equal segments all but the first are repeats (open -1). Of different segments of an anchor those remain open
    that share a context with another one: open packs the anchor's offset, 128 if the left one is shared, 256 if the
    right one is.
    """

    def out(d: np.ndarray, first: np.ndarray, windows: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (d, first, windows, state)], ["d", "first", "windows", "open"])

    def settled(key: np.ndarray, d: np.ndarray, at: np.ndarray, every: bool) -> pa.RecordBatch:
        anchor, state = key >> 16, at & 127
        for shift, flag in ((8, 128), (0, 256)):
            context = (key >> shift) & 255
            order = np.lexsort((context, anchor))
            a, c = anchor[order], context[order]
            near = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            shared = np.zeros(len(a), bool)
            shared[1:] |= near
            shared[:-1] |= near
            shared |= every
            state[order[shared & (c > 0)]] |= flag
        keep = state > 127
        return out(d[keep], at[keep] >> 14, (at[keep] >> 7) & 127, state[keep])

    key = segment = d = at = np.zeros(0, np.int64)  # the different segments of the last anchor
    crowded = False  # that anchor has so many that all of them are open
    for batch in batches:
        new = [c.to_numpy() for c in batch.columns]
        gone = new[3] < 0
        if gone.any():
            yield out(new[2][gone], -1 - new[3][gone], new[1][gone], np.full(gone.sum(), -1))
        rows = [np.concatenate([old, x[~gone]]) for old, x in zip((key, segment, d, at), new, strict=True)]
        if not len(rows[0]):
            continue
        held = len(key)
        anchor = rows[0] >> 16
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (rows[1][1:] == rows[1][:-1])
        twice = np.zeros(len(anchor), bool)  # a repeated row of the input
        twice[1:] = same[1:] & (rows[2][1:] == rows[2][:-1]) & (rows[3][1:] == rows[3][:-1])
        again = same & ~twice
        again[:held] = False
        if again.any():
            yield out(rows[2][again], rows[3][again] >> 14, (rows[3][again] >> 7) & 127, np.full(again.sum(), -1))
        key, segment, d, at = (x[~same] for x in rows)
        anchor = key >> 16
        last = int(np.searchsorted(anchor, anchor[-1], "left"))
        if crowded:  # the first anchor here goes on
            end = int(np.searchsorted(anchor, anchor[0], "right"))
            yield settled(key[1:end], d[1:end], at[1:end], True)  # its first row, the last one held, is out already
            if end == len(key):
                key, segment, d, at = (x[-1:] for x in (key, segment, d, at))
                continue
            key, segment, d, at = (x[end:] for x in (key, segment, d, at))
            last, crowded = last - end, False
        if last:
            yield settled(key[:last], d[:last], at[:last], False)
        key, segment, d, at = (x[last:] for x in (key, segment, d, at))
        if len(key) > COMPARED:
            yield settled(key, d, at, True)
            key, segment, d, at = (x[-1:] for x in (key, segment, d, at))
            crowded = True
    if len(key) > 1:
        yield settled(key, d, at, False)


def _cut(length: int, k: int):
    half = _half(length, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (d, text, runs(first, windows, open)) become (group, d, first, windows, segment).

        A run's windows with ``half`` bytes or more before the anchor go with the left context, the others with the
        right one; group is a hash of the anchor with that context, so equal windows are in equal groups.
        """
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                runs = part.column(2)
                flat = runs.flatten()
                row = np.repeat(np.arange(len(part)), np.diff(runs.offsets.to_numpy()))
                first, windows, state = (flat.field(i).to_numpy() for i in range(3))
                text = part.column(1).cast(pa.large_string())
                base = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
                data = np.frombuffer(text.buffers()[2], np.uint8)
                d = part.column(0).to_numpy()
                out = []
                for flag in (128, 256):
                    own = np.flatnonzero(state & flag)
                    start = base[row[own]] + first[own]
                    anchor, stop = start + (state[own] & 127), start + windows[own]  # stop: after the last window
                    a, b = (start, np.minimum(stop, anchor - half + 1)) if flag == 128 else (np.maximum(start, anchor - half + 1), stop)
                    edge = anchor - half if flag == 128 else anchor
                    fits = np.flatnonzero(b > a)
                    own, start, a, b, edge = own[fits], start[fits], a[fits], b[fits], edge[fits]
                    group = np.zeros(len(own), np.uint64)
                    for i in range(0, half + k, 8):  # hash of the bytes of anchor and context
                        word = np.zeros(len(own), np.uint64)
                        for j in range(i, min(i + 8, half + k)):
                            word = (word << np.uint64(8)) | data[edge + j]
                        group = mix(group * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(flag))
                    out.append((group.view(np.int64), row[own], first[own] + (a - start), a, b - a))
                group, at_row, at_first, a, many = (np.concatenate(x) for x in zip(*out, strict=True))
                size = many + length - 1
                edges = np.concatenate([[0], np.cumsum(size)])
                where = np.repeat(a - edges[:-1], size) + np.arange(edges[-1])
                segment = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[where])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(d[at_row]), pa.array(at_first), pa.array(many), segment], ["group", "d", "first", "windows", "segment"])

    return run


def _repeats(length: int):
    names = ["w", "d", "first", "windows"]

    def judged(rows: pa.Table, whole: bool) -> pa.RecordBatch:
        """Windows whose longest previous factor among the rows has ``length`` bytes: runs (null, d, first, windows).

        If the rows are not whole groups, each window without such a factor comes out too, by a hash of its bytes.
        """
        rows = rows.combine_chunks()
        d, first, many = (rows.column(n).to_numpy() for n in ("d", "first", "windows"))
        segment = rows.column("segment").combine_chunks()
        base = np.frombuffer(segment.buffers()[1], np.int32, len(segment) + 1, segment.offset * 4).astype(np.int64)
        data = np.frombuffer(segment.buffers()[2], np.uint8)[base[0] : base[-1]]
        base = base - base[0]
        row = np.repeat(np.arange(len(many)), many)
        within = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        at = base[row] + within
        again = previous_factors(data, at, length) >= length
        d2, first2, windows = _joined(d[row[again]], first[row[again]] + within[again], np.ones(again.sum(), np.int64))
        w, null = np.zeros(len(d2), np.int64), np.ones(len(d2), bool)
        if not whole:
            own = span_hashes(prefix_sums(data), at[~again], at[~again] + length).view(np.int64)
            w, null = np.concatenate([w, own]), np.concatenate([null, np.zeros(len(own), bool)])
            d2, first2 = np.concatenate([d2, d[row[~again]]]), np.concatenate([first2, first[row[~again]] + within[~again]])
            windows = np.concatenate([windows, np.ones(len(own), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(w, mask=null), *(pa.array(x) for x in (d2, first2, windows))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (group, d, first)."""
        held, size, parts = [], 0, False  # parts: some rows of the group that the held ones begin with are out
        last_row = [None] * 3
        for batch in batches:
            if not len(batch):
                continue
            same = np.ones(len(batch), bool)  # a repeated row of the input
            for c in range(3):
                x = batch.column(c).to_numpy()
                same[1:] &= x[1:] == x[:-1]
                same[0] &= last_row[c] == x[0]
                last_row[c] = x[-1]
            batch = batch.filter(pa.array(~same))
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size <= SORTED:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            group = rows.column("group").to_numpy()
            if not len(group):
                continue
            last = int(np.searchsorted(group, group[-1], "left"))  # where the group starts that may go on
            head = int(np.searchsorted(group, group[0], "right")) if parts else 0  # where the one ends that is out in parts
            if head and head < len(group):
                yield judged(rows.slice(0, head), False)
                parts = False
            if last > head:
                yield judged(rows.slice(head, last - head), True)
            rows = rows.slice(last)
            if rows.nbytes > SORTED:
                yield judged(rows, False)
                rows, parts = rows.slice(len(rows)), True
            held, size = [rows], rows.nbytes
        if held and sum(map(len, held)):
            rows = pa.concat_tables(held).combine_chunks()
            group = rows.column("group").to_numpy()
            head = int(np.searchsorted(group, group[0], "right")) if parts else 0
            for a, b, whole in ((0, head, False), (head, len(group), True)):
                if b > a:
                    yield judged(rows.slice(a, b - a), whole)

    return run


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, runs) become the digest columns and the removed byte spans."""
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            spans: list[list[int]] = []
            for first, windows in sorted((r["first"], r["windows"]) for r in runs or ()):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], first + windows + length - 1)
                else:
                    spans.append([first, first + windows + length - 1])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), spans))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, d, first, windows) sorted by w, d and first: runs with a null w pass, of windows with one w all but the first."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        w, d, first = (batch.column(i).fill_null(0).to_numpy() for i in range(3))
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        before = [np.concatenate([[0 if last is None else last[i]], x[:-1]]) for i, x in enumerate((w, d, first))]
        known = np.concatenate([[last is not None and not last[3]], ~null[:-1]])
        keep = null | (known & (w == before[0]) & ((d != before[1]) | (first != before[2])))
        last = (w[-1], d[-1], first[-1], bool(null[-1]))
        yield batch.filter(pa.array(keep)).select([1, 2, 3])


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, id, text): d a long in the order of the ids, one for each pair of an id and a text.

    Integers stand for themselves. Where ids are of another kind, or an id has several texts, the pairs are numbered:
    sorted by id (null first) and a hash of the text over ranges, each range a part of the stored table.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text)
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        seen = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(LEAST_ID)).alias("d"), F.col("id").isNull().cast("int").alias("x"), F.xxhash64("text").alias("y"))
        seen = seen.groupBy("d").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)))
        if not seen.where("min_x <> max_x or min_y <> max_y").limit(1).count():
            return rows.select(F.coalesce(F.col("id").cast("long"), F.lit(LEAST_ID)).alias("d"), "id", "text")
    hashes = [F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y")]
    pairs = rows.select("id", *hashes).distinct()
    numbers = pairs.repartitionByRange(F.col("id").asc_nulls_first(), "x", "y").sortWithinPartitions(F.col("id").asc_nulls_first(), "x", "y")
    numbers = materialize(numbers.withColumn("d", F.monotonically_increasing_id()), "numbers")
    keyed = rows.select("id", "text", *hashes)
    return keyed.join(numbers, null_safe(keyed, numbers, "id", "x", "y")).select("d", keyed["id"], "text")


def dedup_substrings(docs: DataFrame, length: int = 100, k: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier in the corpus; exact.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed): removed holds the byte spans [start, stop).
    ``apply_removed`` gives the remaining text. Order is by id, then position; matches never cross documents.

    Each window of ``length`` bytes is anchored at its k-gram of smallest hash; windows that follow one another with one
    anchor are a run, and equal windows have equal anchors.

    1. Runs meet by anchor as hashes, without their bytes: of equal runs all but the first are repeats. A task settles
       those it holds itself before the exchange, so a passage in many documents is a few rows of each task.
    2. Different runs of an anchor stay open if their bytes before or after the anchor agree too, as they do if they
       share a window. Only open runs are cut out of the texts.
    3. Open runs meet by anchor and context. Their longest previous factors are computed from previous and next smaller
       positions in suffix order; a window is a repeat if its factor has ``length`` bytes. Groups of more than ``SORTED``
       bytes are judged in parts, and what is first in its part meets by a hash of the window.

    Null texts are empty; null ids come first. Rows with the same id and text are judged as one document and get the
    same result; rows with the same id and different texts come in the order of a hash. Ids of any type that sorts;
    extra columns are ignored; an empty table gives an empty result.
    """
    if not 16 <= k < length <= k + 96:
        raise ValueError("16 <= k < length <= k + 96 is needed")
    texts = _ordered(docs, id_col, text_col)
    anchors = _anchors(texts, length, k)
    met = anchors.repartition(F.shiftright("key", 16)).sortWithinPartitions(F.shiftright("key", 16), "segment", "d", "at")
    runs = materialize(met.mapInArrow(lean(_opened), "d long, first long, windows long, open long"), "runs")
    open_ = runs.where("open >= 0").groupBy("d").agg(F.collect_list(F.struct("first", "windows", "open")).alias("runs"))
    segments = texts.join(open_, "d").select("d", "text", "runs").mapInArrow(lean(_cut(length, k)), "`group` long, d long, first long, windows long, segment binary")
    sorted_ = segments.repartition("group").sortWithinPartitions("group", "d", "first")
    judged = sorted_.select("group", "d", "first", "windows", "segment").mapInArrow(lean(_repeats(length)), "w long, d long, first long, windows long")
    judged = judged.repartition(F.coalesce("w", F.xxhash64("d", "first"))).sortWithinPartitions("w", "d", "first")
    removed = judged.mapInArrow(lean(_once), "d long, first long, windows long").union(runs.where("open < 0").select("d", "first", "windows"))
    removed = removed.groupBy("d").agg(F.collect_list(F.struct("first", "windows")).alias("runs"))
    out = texts.join(removed, "d", "left").select("id", "text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()
    out = out.mapInArrow(lean(lambda batches: _kept(batches, length)), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")
    return out.withColumnRenamed("id", id_col)


def apply_removed(text: str | None, removed: list[list[int]]) -> bytes:
    """The bytes that ``dedup_substrings`` leaves of a text."""
    data, out, at = (text or "").encode(), [], 0
    for a, b in removed:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])
