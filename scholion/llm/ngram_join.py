"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.llm.bytesets import mix, shingle_sets
from scholion.llm.components import connected_components
from scholion.llm.workers import lean
from scholion.session import discard, hinted, materialize

#: Most class ids that are handed to the Python workers as one array (16 MB); beyond it a join filters.
SENT = 2_000_000
#: Class ids that a task remembers, so that it sends the fragments of copies once.
SEEN = 100_000
#: N-grams of the sets that a task holds at once, twice: of two blocks of a cluster.
BLOCK = 500_000
#: Classes that agree on a fragment and are held to name their group; more of them are a group by the fragment's key.
GROUP = 100_000
#: Classes that agree on a fragment and make it a common one, of which a class may leave out as many as its plan spares.
COMMON = 4
#: Longs of the parity sketch that every class has; larger classes have one with a bit or more for each n-gram too.
SKETCH = 8
#: Times that the components are taken anew before what is left between them is paired in full.
ROUNDS = 2
#: Growth of the sizes that share one cut into fragments.
GROWTH = 1.5
#: Cuts that are tried for a set that leaves too many fragments empty.
CUTS = 4
#: Most fragments of a cut that a set leaves out (23 bits of its lot).
MOST_ROOM = (1 << 23) - 1
SIGN = np.uint64(1 << 63)


@dataclass
class JaccardGroups:
    """``members(doc_id, n_shingles, node)``, node null for empty sets; ``links(a, b, overlap)`` between different
    sets; ``components(node, component)`` for linked nodes."""

    members: DataFrame
    links: DataFrame
    components: DataFrame


class FragmentPlan:
    """How the global n-gram order, that of the hashes, is cut into fragments.

    Sets of similar sizes share a scheme; the pair of a and b, a the smaller, belongs to the scheme of b's size. Two sets
    with the similarity differ in at most ``differ`` n-grams, so of ``differ + 1 + spare`` fragments they agree on
    ``spare + 1`` or more. If one of them leaves at most ``spare`` fragments empty, they agree on one that is not empty.
    Sets that leave more empty are cut in other ways too, by other hashes, and after ``CUTS`` of them give their empty
    fragments as well; so no pair is missed.

    A set that leaves fewer than ``spare`` empty has room to leave out as many more, the commonest: of ``spare + 1``
    fragments that two sets agree on, the rarest (in an order that is the same for all sets, empty ones first) is left
    out by neither.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.sizes = [1]
        while self.sizes[-1] < 1 << 31:
            self.sizes.append(max(self.sizes[-1] + 1, int(self.sizes[-1] * GROWTH)))
        fragments, spare = [], []
        for low, high in zip(self.sizes, self.sizes[1:], strict=False):
            differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
            least = -(-percent * low // 100)
            spare.append(0)
            for _ in range(3 if differ else 0):  # the spare fragments leave more of them empty
                many = differ + 1 + spare[-1]
                empty = many * (1 - 1 / many) ** least
                spare[-1] = int(np.ceil(empty + np.sqrt(empty)))
            fragments.append(differ + 1 + spare[-1])
        self.fragments, self.spare = np.array(fragments, np.int64), np.array(spare, np.int64)

    def scheme(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sizes, n, "right") - 1

    def keys(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key): a key for each fragment of each set and scheme that the set can meet a partner in."""
        return self.lots(values, bounds)[:2]

    def lots(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, lot): the keys, and the lot of each: 256 times the room of the set in this cut, and the cut's number."""
        n = np.diff(bounds)
        first, last = self.scheme(n), self.scheme(100 * n // self.percent)
        rows_out, keys_out, lots_out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for step in range(int((last - first).max(initial=-1)) + 1):
            rows = np.flatnonzero((n > 0) & (first + step <= last))
            for cut in range(CUTS):
                if not len(rows):
                    break
                many, scheme = n[rows], first[rows] + step
                fragments = self.fragments[scheme]
                owner = np.repeat(np.arange(len(rows)), many)
                u = values[np.arange(len(owner)) + (bounds[rows] - np.cumsum(many) + many)[owner]].view(np.uint64) ^ SIGN
                if cut:
                    u = mix(u + np.uint64(cut))
                    u = u[np.lexsort((u, owner))]
                at = ((u >> np.uint64(32)) * fragments[owner].astype(np.uint64)) >> np.uint64(32)
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                place = lambda r, f: mix((((scheme[r] * CUTS + cut) << 32) + f + 1).astype(np.uint64))  # noqa: B023, E731
                rows_out.append(rows[owner[begin]])
                keys_out.append(mix(np.add.reduceat(mix(u), begin) + place(owner[begin], at[begin].astype(np.int64))))
                room = self.spare[scheme] - fragments + np.bincount(owner[begin], minlength=len(rows))
                lots = (np.clip(room, 0, MOST_ROOM) * 256 + scheme * CUTS + cut).astype(np.int32)
                lots_out.append(lots[owner[begin]])
                poor = np.flatnonzero(room < 0)
                if cut == CUTS - 1:
                    for r in poor.tolist():
                        f = np.setdiff1d(np.arange(fragments[r]), at[owner == r].astype(np.int64))
                        rows_out.append(np.full(len(f), rows[r]))
                        keys_out.append(mix(place(np.full(len(f), r), f)))
                        lots_out.append(np.full(len(f), lots[r]))
                rows = rows[poor]
        return np.concatenate(rows_out), np.concatenate(keys_out).view(np.int64), np.concatenate(lots_out)


def _names(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.view(np.uint64)))])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _sketches(values: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Parities of each set's hashes by places: ``SKETCH`` longs, and a power of two of longs with at least a bit for each
    n-gram (none, if the first has). The first is the second folded, by exclusive or, to its length."""
    n = np.diff(bounds)
    longs = 1 << np.ceil(np.log2(np.maximum(n / 64, SKETCH))).astype(np.int64)
    row, u = np.repeat(np.arange(len(n)), n), values.view(np.uint64)
    edges = np.concatenate([[0], np.cumsum(longs)])
    flips = np.zeros(edges[-1], np.uint64)
    np.bitwise_xor.at(flips, edges[row] + ((u >> np.uint64(6)).astype(np.int64) & (longs[row] - 1)), np.uint64(1) << (u & np.uint64(63)))
    owner = np.repeat(np.arange(len(n)), longs)
    small = np.zeros((len(n), SKETCH), np.uint64)
    np.bitwise_xor.at(small, (owner, (np.arange(edges[-1]) - edges[owner]) % SKETCH), flips)
    large = longs > SKETCH
    ends = np.concatenate([[0], np.cumsum(np.where(large, longs, 0))])
    lists = lambda e, x: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x.view(np.int64)))
    return lists(np.arange(len(n) + 1) * SKETCH, small.ravel()), lists(ends, flips[large[owner]])


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, n, node, small, sketch): the set's size, its fingerprint, and its two parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, bounds in shingle_sets(batch.column(1), size):
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(n)), pa.array(n, pa.int64()), pa.array(_names(values, bounds), mask=n == 0), *_sketches(values, bounds)], ["doc_id", "n", "node", "small", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n long, node long, small array<long>, sketch array<long>")


def _fragments(docs: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """(h, node, lot): the key of each fragment of each set; lot, 2**32 times its lot in the plan, and the set's size.

    A task sends a set once, as far as it remembers.
    """
    plan = FragmentPlan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, values, bounds in shingle_sets(batch.column(0), size):
                n, node = np.diff(bounds), _names(values, bounds)
                fresh = np.zeros(len(n), bool)
                for r, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[r] = True
                if len(seen) > SEEN:
                    seen.clear()
                fresh &= n > 0
                own = np.concatenate([[0], np.cumsum(n[fresh])])
                row, key, lot = plan.lots(values[np.repeat(fresh, n)], own)
                at = np.flatnonzero(fresh)[row]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[at]), pa.array((lot.astype(np.int64) << 32) + n[at])], ["h", "node", "lot"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "h long, node long, lot long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, lot) sorted by h and node become (h, node, lot, often): those with keys of two nodes or more.

    often is the number of the key's nodes, ``GROUP`` at most. Of keys of fewer than ``COMMON`` nodes that have the same
    nodes, one goes on, as far as a batch tells.
    """

    def out(h: np.ndarray, node: np.ndarray, lot: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(node), pa.array(lot), pa.array(np.minimum(often, GROUP).astype(np.int32))], ["h", "node", "lot", "often"])

    def counted(h: np.ndarray, node: np.ndarray, lot: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        many = np.diff(np.append(begin, len(h)))
        wanted = many > 1
        few = np.flatnonzero(wanted & (many < COMMON))
        if len(few):
            same = mix(np.add.reduceat(mix(node.view(np.uint64)), begin)[few] + many[few].astype(np.uint64))
            wanted[few] = False
            wanted[few[np.unique(same, return_index=True)[1]]] = True
        keep = np.repeat(wanted, many)
        return out(h[keep], node[keep], lot[keep], np.repeat(many, many)[keep])

    rows, large = [np.zeros(0, np.int64)] * 3, False  # the last key's rows; whether it is large and its rows are out
    for batch in batches:
        rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(rows, batch.columns, strict=True)]
        h, node, _ = rows
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        rows = [x[keep] for x in rows]
        if not len(rows[0]):
            continue
        if large:
            end = int(np.searchsorted(rows[0], rows[0][0], "right"))
            yield out(*(x[1:end] for x in rows), np.full(end - 1, GROUP))
            large = end == len(rows[0])
            rows = [x[-1:] if large else x[end:] for x in rows]
            if large:
                continue
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        yield counted(*(x[:last] for x in rows))
        rows = [x[last:] for x in rows]
        if len(rows[0]) > GROUP:
            large = True
            yield out(*rows, np.full(len(rows[0]), GROUP))
            rows = [x[-1:] for x in rows]
    if not large:
        yield counted(*rows)


def _rare(met: DataFrame) -> DataFrame:
    """(h, node, n) of the rows of ``_counted`` without the common keys that their sets have room to leave out."""
    rank = F.row_number().over(Window.partitionBy("node", F.expr("shiftright(lot, 32) & 255")).orderBy(F.desc("often"), "h"))
    common = met.where(F.col("often") >= COMMON).withColumn("rank", rank).where("rank > shiftright(lot, 40)")
    return met.where(F.col("often") < COMMON).union(common.drop("rank")).select("h", "node", F.expr("cast(lot & 4294967295 as int)").alias("n"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node, n) sorted by h and node become (g, node, n, hub): the groups of two nodes or more with one key.

    g is a hash of the group's nodes, so that the many fragments that the same nodes agree on are one group in the end
    (should two groups share a hash, they are one larger group, which does no harm); hub is the first node.
    """
    names = ["g", "node", "n", "hub"]

    def out(g: np.ndarray, node: np.ndarray, n: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(hub)], names)

    def grouped(h: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(h)))
        g = mix(np.add.reduceat(mix(node.view(np.uint64)), begin) + many.astype(np.uint64)).view(np.int64) if len(begin) else h
        once = np.zeros(len(g), bool)
        once[np.unique(g, return_index=True)[1]] = True
        keep = np.repeat((many > 1) & once, many)
        return out(np.repeat(g, many)[keep], node[keep], n[keep], np.repeat(node[begin], many)[keep])

    rows, hub = [np.zeros(0, np.int64)] * 3, None  # the last key's rows; its hub, if it is large and its rows are out
    for batch in batches:
        rows = [np.concatenate([x, c.to_numpy()]) for x, c in zip(rows, batch.columns, strict=True)]
        h, node, _ = rows
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        rows = [x[keep] for x in rows]
        if not len(rows[0]):
            continue
        if hub is not None:
            end = int(np.searchsorted(rows[0], rows[0][0], "right"))
            yield out(*(x[1:end] for x in rows), np.full(end - 1, hub))
            if end == len(rows[0]):
                rows = [x[-1:] for x in rows]
                continue
            rows, hub = [x[end:] for x in rows], None
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        yield grouped(*(x[:last] for x in rows))
        rows = [x[last:] for x in rows]
        if len(rows[0]) > GROUP:
            hub = rows[1][0]
            yield out(*rows, np.full(len(rows[0]), hub))
            rows = [x[-1:] for x in rows]
    if hub is None:
        yield grouped(*rows)


def _differ(left: Column, right: Column) -> Column:
    """Places in which two parity sketches of one length differ."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int, small: bool) -> DataFrame:
    """Pairs whose sketches allow the threshold: the parities of two sets differ in no more places than the sets do in n-grams.

    Without ``small`` the pairs have been held against the small sketches before.
    """
    # at least ``differ`` n-grams are in one set only, so at most (n_a + n_b - differ) / 2 are in both
    allowed = f"100 * (n_a + n_b - differ) >= {percent} * (n_a + n_b + differ)"

    def tried(rows: DataFrame, column: str, halvings: int) -> DataFrame:
        for x, name in (("a", "left"), ("b", "right")):
            rows = rows.join(sketches.select(F.col("node").alias(x), F.col(column).alias(name)), x)
        for _ in range(halvings):  # the longer sketch, folded to the length of the other one
            for x, y in (("left", "right"), ("right", "left")):
                half = F.expr(f"transform(sequence(0, size({x}) div 2 - 1), i -> {x}[i] ^ {x}[i + size({x}) div 2])")
                rows = rows.withColumn(x, F.when(F.size(x) > F.size(y), half).otherwise(F.col(x)))
        return rows.withColumn("differ", _differ(F.col("left"), F.col("right"))).where(allowed).select("a", "b", "n_a", "n_b")

    some = tried(pairs, "small", 0) if small else pairs.select("a", "b", "n_a", "n_b")
    large = f"least(n_a, n_b) > {64 * SKETCH}"
    # sizes differ by 100 / percent at most, and the lengths by a halving more
    return some.where(f"not ({large})").union(tried(some.where(large), "sketch", (100 // percent).bit_length()))


def _texts(docs: DataFrame, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, one text for each."""
    only = np.sort(wanted.toArrow().column(0).to_numpy()) if wanted.count() <= SENT else None
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only, seen = shared.value, set()
        for batch in batches:
            for lo, values, bounds in shingle_sets(batch.column(0), size):
                node = _names(values, bounds)
                keep = np.diff(bounds) > 0
                if only is not None:
                    keep &= np.isin(node, only)
                rows = [r for r in np.flatnonzero(keep).tolist() if node[r] not in seen]
                seen.update(node[rows].tolist())
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), batch.column(0).take(pa.array(rows, pa.int64()) if not rows else pa.array(np.array(rows) + lo))], ["node", "text"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "node long, text string")
    if only is None:
        found = found.join(wanted, "node", "left_semi")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _overlaps(size: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, i, j, a, b, n_a, n_b, text) sorted by the first three and b: the texts of two blocks, b null,
        then their pairs, which become (a, b, n_a, n_b, overlaps), an overlap for each fragment."""
        here, sets = None, {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for lo, values, bounds in shingle_sets(batch.column(7), size):
                found, at = [], []
                for k in range(len(bounds) - 1):
                    r = lo + k
                    if keys[r] != here:
                        here, sets = keys[r], {}
                    if b[r] is None:
                        sets[a[r]] = values[bounds[k] : bounds[k + 1]].copy()
                        continue
                    x, y = sorted((sets[a[r]], sets[b[r]]), key=len)
                    both = x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x]
                    f = ((both.view(np.uint64) ^ SIGN) >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)
                    found.append(np.bincount(f.astype(np.int64), minlength=fragments))
                    at.append(r)
                if at:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(3, 7)), pa.array(found, pa.list_(pa.int64()))], ["a", "b", "n_a", "n_b", "overlaps"])

    return run


def _verified(docs: DataFrame, text_col: str, size: int, percent: int, fragments: int, pairs: DataFrame, sketches: DataFrame, small: bool = True) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose partial overlaps, counted per fragment and summed, reach the threshold: (a, b, overlap).

    The pairs' clusters are the components of the pairs; a text goes to its cluster's task once. A cluster of more than
    ``BLOCK`` n-grams is cut into blocks, and each two of them that have a pair are a task.
    """
    pairs = materialize(_possible(pairs, sketches, percent, small), "possible")
    clusters = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = pairs.select(F.col("a").alias("node"), F.col("n_a").alias("n")).union(pairs.select("b", "n_b")).distinct().join(clusters, "node")
    blocks = nodes.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    nodes = materialize(nodes.join(blocks, "component").select("node", "component", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "candidates")
    tasks = pairs.join(nodes.select(F.col("node").alias("a"), "component", F.col("block").alias("i")), "a").join(nodes.select(F.col("node").alias("b"), F.col("block").alias("j")), "b")
    tasks = materialize(tasks.select("component", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a", "b", "n_a", "n_b"), "tasks")
    asks = tasks.select("component", "i", "j", F.col("a").alias("node")).union(tasks.select("component", "i", "j", "b")).distinct()
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("b", "long"), ("n_a", "int"), ("n_b", "int"))]
    texts = _texts(docs, text_col, size, nodes.select("node")).join(asks, "node").select("component", "i", "j", F.col("node").alias("a"), *none, "text")
    met = texts.union(tasks.select("*", F.lit(None).cast("string"))).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "b")
    partial = met.mapInArrow(lean(_overlaps(size, fragments)), "a long, b long, n_a int, n_b int, overlaps array<long>")
    sums = partial.withColumn("overlap", F.aggregate("overlaps", F.lit(0).cast("long"), lambda s, x: s + x))
    links = materialize(sums.where(F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")).select("a", "b", "overlap"), "links")
    discard(nodes, tasks, pairs)
    return links


def ngram_jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, fragments: int = 8) -> JaccardGroups:
    """Group documents whose sets of word n-grams have a Jaccard similarity of ``percent`` / 100 or more; exact.

    1. Documents with the same set form one class, named by a 64-bit fingerprint of the set, so copies are never paired
       with one another.
    2. The global n-gram order is cut into fragments (``FragmentPlan``), each joined by itself: two similar sets agree
       on the whole of one fragment at least. A fragment that holds common n-grams only is shared as a whole or not at
       all, so common passages make no pairs of documents that differ otherwise. Of the fragments that many classes
       agree on, each class leaves out as many, the commonest, as the cut has to spare for it.
    3. Classes that agree on a fragment are first paired with one hub class of that fragment, then with hubs of other
       components as long as that links any. What remains between different components after that is paired in full, within the length bound and the bound of the parity sketches;
       fragments all of whose classes are in one component are done. So a group of near copies costs a linear number of
       pairs.
    4. A pair's overlap is counted on each of ``fragments`` parts of the order by itself and summed, in tasks of a cluster
       of pairs each, or of two blocks of a large one.

    Letters A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer than ``size`` words is one n-gram;
    texts that are null or without words have an empty set, which links with nothing. Repeated rows and repeated or
    null ids are kept: each row is a member of its set's class. Extra columns are ignored.
    """
    sets = materialize(_sets(docs, id_col, text_col, size), "sets")
    members = sets.select("doc_id", F.col("n").alias("n_shingles"), "node")
    sketches = materialize(sets.where("n > 0").groupBy("node").agg(F.first("small").alias("small"), F.first("sketch").alias("sketch")), "sketches")
    by_key = lambda rows: rows.repartition("h").sortWithinPartitions("h", "node")
    met = materialize(by_key(_fragments(docs, text_col, size, percent)).mapInArrow(lean(_counted), "h long, node long, lot long, often int"), "met")
    shared = materialize(by_key(_rare(met)).mapInArrow(lean(_met), "g long, node long, n int, hub long").distinct(), "shared")
    discard(met)

    sizes = sets.where("n > 0").groupBy(F.col("node").alias("hub")).agg(F.first(F.col("n").cast("int")).alias("n_hub"))
    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    pairs = shared.where("node <> hub").select("node", "n", "hub").distinct().join(sizes, "hub")
    pairs = pairs.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("n_hub").alias("n_a"), F.col("n").alias("n_b"))  # the hub is the smaller name
    tried = materialize(pairs.where(fits), "pairs")
    links = _verified(docs, text_col, size, percent, fragments, tried, sketches)
    for k in range(ROUNDS):
        components = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        owned = shared.join(components, "node", "left").select("g", "node", "n", F.coalesce("component", "node").alias("component"))
        owned = materialize(owned, "owned")
        by, whole = F.struct("component", "node"), F.struct("component", "node", "n")
        mixed = owned.groupBy("g").agg(F.min_by(whole, by).alias("x"), F.max_by(whole, by).alias("y")).where("x.component < y.component")
        open_ = materialize(owned.join(mixed, "g").withColumn("hub", F.expr("if(component = x.component, y, x)")).drop("x", "y"), "open")
        discard(owned)
        if k == ROUNDS - 1:
            break
        ab = F.expr("if(node < hub.node, named_struct('a', node, 'b', hub.node, 'n_a', n, 'n_b', hub.n), named_struct('a', hub.node, 'b', node, 'n_a', hub.n, 'n_b', n)) as p")
        new = open_.select(ab).select("p.*").where(fits).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        new = materialize(new.select("a", "b", "n_a", "n_b"), "pairs")
        more = _verified(docs, text_col, size, percent, fragments, new, sketches)
        tried, links = tried.union(new), links.union(more)
        if not more.limit(1).count():
            break
        discard(open_)
    places = [F.col("small")[k].alias(f"s{k}") for k in range(SKETCH)]
    open_ = open_.join(sketches.select("node", *places), "node")
    open_ = materialize(open_, "open")
    side = lambda x: [F.col("g"), F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"), *(F.col(f"s{k}").alias(f"{x}{k}") for k in range(SKETCH))]
    differ = " + ".join(f"bit_count(a{k} ^ b{k})" for k in range(SKETCH))
    # the sketches are compared where the pairs meet, so that pairs they rule out are never rows
    alike = F.expr(f"100 * (n_a + n_b - ({differ})) >= {percent} * (n_a + n_b + ({differ}))")
    rest = open_.select(side("a")).join(open_.select(side("b")), "g").where(F.expr("a < b and c_a <> c_b") & fits & alike).select("a", "b", "n_a", "n_b").distinct()
    rest = materialize(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = _verified(docs, text_col, size, percent, fragments, rest, sketches, small=False)
    links = links.union(more)
    if more.limit(1).count():
        components = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    discard(shared, open_, rest, sketches)
    return JaccardGroups(members, links, components)


def ngram_jaccard_components(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id), component_id the smallest doc_id of its component.

    A row with an empty set, or a null id that nothing links, is a component of its own. Options: those of
    ``ngram_jaccard_groups``.
    """
    groups = ngram_jaccard_groups(docs, **options)
    low = groups.members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    own = low.join(groups.components, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    named = own.join(own.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("node", "component_id")
    out = groups.members.join(hinted(materialize(named, "named")), "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
