"""Edges of the corpus operators: bounds that are reached, ids of other kinds, long runs, labels of any type."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("scholion.llm")

from pyspark.sql import functions as F

from scholion.llm import bpe, embedding_join, language_id, ngram_join, substring_dedup
from scholion.llm.queries import vocabulary


def batches(names, rows, size):
    for lo in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + size], strict=True)], names)


def test_fragments_miss_no_pair():
    """Two sets with the similarity share a key, whatever their sizes and wherever they differ."""
    rng = np.random.default_rng(1)
    for percent in (50, 80, 85):
        plan = ngram_join.FragmentPlan(percent)
        for _ in range(1500):
            n = int(rng.integers(1, 60)) if rng.random() < 0.8 else int(rng.integers(60, 400))
            a = np.unique(rng.integers(-(2**63), 2**63, n))
            room = len(a) - -(-percent * len(a) // 100)
            drop, add = int(rng.integers(0, room + 1)), int(rng.integers(0, room + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(-(2**63), 2**63, add)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                row, key = plan.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(key[row == 0]) & set(key[row == 1]), (percent, len(a), len(b), both)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (3, 500, 700, 3000):
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        b = np.unique(np.concatenate([a[n // 4 :], rng.integers(-(2**63), 2**63, n // 3)]))
        small, large = ngram_join._sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        differ = len(np.setxor1d(a, b))
        for x in (small, large):
            p, q = (np.array(v, np.int64).view(np.uint64) for v in x.to_pylist())
            if len(p) == len(q):
                assert sum(int(v).bit_count() for v in (p ^ q).tolist()) <= differ


@pytest.mark.parametrize("limit", [3, 100_000])
def test_groups_of_any_size(monkeypatch, limit):
    """Groups come out whole if they are larger than what is held."""
    monkeypatch.setattr(ngram_join, "GROUP", limit)
    rng = random.Random(3)
    rows = sorted({(rng.randrange(12), rng.randrange(30), 7) for _ in range(150)} | {(99, 1, 7)})
    rows = sorted(rows + rows[:20])
    for size in (1, 7, 1000):
        got = {}
        for b in ngram_join._met(batches(["h", "node", "n"], rows, size)):
            for g, node, hub in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                got.setdefault(g, set()).add(node)
                assert hub <= node
        want = {frozenset(n for h2, n, _ in rows if h2 == h) for h, _, _ in rows}
        assert {frozenset(v) for v in got.values()} == {w for w in want if len(w) > 1}


@pytest.mark.parametrize("limit", [2, 1 << 17])
def test_open_runs(monkeypatch, limit):
    """Equal segments but the first are repeats; different ones stay open if they share a context, or are too many to compare."""
    monkeypatch.setattr(substring_dedup, "COMPARED", limit)
    rng = random.Random(4)
    rows = []
    for k in range(200):
        segment = rng.randrange(8)
        anchor = rng.randrange(6)
        context = (segment % 3) << 8 | (segment % 5 + 1)
        rows.append((anchor << 16 | context, segment, rng.randrange(40), k << 14 | 5 << 7 | 3))
    rows.sort(key=lambda r: (r[0] >> 16, r[1], r[2], r[3]))
    rows = sorted(rows + rows[::9], key=lambda r: (r[0] >> 16, r[1], r[2], r[3]))
    again, first = set(), {}
    for r in dict.fromkeys(rows):
        if (r[0] >> 16, r[1]) in first:
            again.add((r[2], r[3] >> 14))
        else:
            first[r[0] >> 16, r[1]] = r
    must = {}
    for (anchor, segment), r in first.items():
        others = [x for (a, s), x in first.items() if a == anchor and s != segment]
        flags = sum(f for shift, f in ((8, 128), (0, 256)) if r[0] >> shift & 255 and any(x[0] >> shift & 255 == r[0] >> shift & 255 for x in others))
        must[r[2], r[3] >> 14] = flags
    for size in (1, 13, 1000):
        out = [x for b in substring_dedup._opened(batches(substring_dedup.ANCHORS, rows, size)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert {(d, f) for d, f, _, s in out if s < 0} == again
        got = {(d, f): s & 384 for d, f, _, s in out if s >= 0}
        assert all(flags & ~got.get(k, 0) == 0 for k, flags in must.items())
        assert limit == 2 or got == {k: v for k, v in must.items() if v}


def brute_removed(texts, length):
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((len(t), sum(gone), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_ids_of_other_kinds(spark, monkeypatch):
    """Text ids, an id with several texts, repeated rows, a long text in pieces, groups judged in parts."""
    monkeypatch.setattr(substring_dedup, "SORTED", 600)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(150))) + passage[k * 7 : 160 + 9 * k] + "".join(rng.choice("xyz") for _ in range(90)) for k in range(25)]
    texts.append("".join(rng.choice("abcdefgh") for _ in range(1_200_000)) + passage + texts[3])
    data = sorted((f"id{k:03}", t) for k, t in enumerate(texts))
    df = spark.createDataFrame([*data, data[2], data[2]], "doc_id string, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == dict(zip((i for i, _ in data), brute_removed([t.encode() for _, t in data], 100), strict=True))
    one = spark.createDataFrame([(1, "p" + passage), (1, passage + "q"), (None, passage), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.dedup_substrings(one).collect())
    assert got[0] == (0, 0) and got[1:3] == [(1, 400), (1, 400)] and got[3] == (2, 0)


def test_words_that_underflow():
    """Sixty letters that are all byte pieces: languages differ, and the scores are those of exact sums."""
    pieces = language_id.read_pieces(vocabulary("piece_bpe_32k.model"))
    letters = [chr(0x1780 + k) for k in range(20)]
    model = language_id.fit_pieces(pieces, {"aa": {"".join(letters): 4}, "bb": {"".join(reversed([chr(0x1000 + k) for k in range(20)])): 4}})
    word = "".join(letters) * 3
    (score,) = model.score([word])
    want = np.zeros(2)
    for at in range(0, len(word) + 1, language_id.BLOCK):
        for c in ("▁" + word)[at : at + language_id.BLOCK]:
            k = model.index.get(c)
            want += np.log(model.chances[k] if k is not None else model.chance(tuple(model.bytes[b] for b in c.encode())))
    assert score[0] > score[1] + 100 and np.allclose(score, want)


def test_two_vocabularies(spark, tmp_path):
    """A second vocabulary of the same file name is another vocabulary; one that is not known is an error."""
    spec = json.load(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8"))
    docs = spark.createDataFrame([(1, "the other words")], "doc_id long, text string")
    whole = bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json")).first()
    spec["model"]["merges"] = spec["model"]["merges"][:1]
    (tmp_path / "byte_bpe_50k.json").write_text(json.dumps(spec), encoding="utf-8")
    cut = bpe.encode_documents(docs, str(tmp_path / "byte_bpe_50k.json")).first()
    assert cut.n_tokens > whole.n_tokens and cut.decoded_sha256 == whole.decoded_sha256
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "byte_bpe_50k.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, str(tmp_path / "byte_bpe_50k.json"))


@pytest.mark.parametrize("kind", ["double", "boolean", "date", "decimal(5,2)", "binary"])
def test_labels_of_any_type(spark, kind):
    value = {"date": "date'2020-01-02'", "binary": "x'00ff'"}.get(kind, f"cast(1 as {kind})")
    df = spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.expr(f"if(id < 2, {value}, null)").alias("label"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_join.vector_components(df).collect()) == [(0, 1, 0), (1, 1, 0), (2, 0, 2)]


def test_words_are_learned_once():
    """A word that stands in other parts of a text, such as before other signs, is not encoded anew."""
    own = bpe.ByteBpe(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    seen, insert = [], own.insert
    own.insert = lambda words: seen.extend(words) or insert(words)
    for text in (" zlorbunt, zlorbunt", " zlorbunt. zlorbunt!", " zlorbunt<|endoftext|>"):
        assert own.decode(own.encode(text)) == text
    assert seen.count(b" zlorbunt") == 1


def test_vectors_are_copied_to_few_cells(spark):
    """Single precision stays, and a vector goes only to cells whose side of the plane between two pivots it is near."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(4, 16))]).astype(np.float32)
    x = np.concatenate([x, x[:100] + 0.02 * rng.normal(size=(100, 16)).astype(np.float32)])
    rows = [("a", 16, k, 1, v) for k, v in enumerate(x.tolist())]
    classes = spark.createDataFrame(rows, "label string, dim int, node long, copies long, embedding array<float>")
    pivots, radius = {("a", 16): unit(x[200:204].astype(float))}, float(np.sqrt(0.04))
    near = {(r.label, r.dim, r.cell): r.r for r in embedding_join._placed(classes, pivots, radius, None).groupBy("label", "dim", "cell").agg(F.max("r").alias("r")).collect()}
    placed = embedding_join._placed(classes, pivots, radius, near)
    assert placed.schema["embedding"].dataType.simpleString() == "array<float>"
    p, u = pivots["a", 16], unit(x.astype(float))
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ p.T))
    own = d.argmin(axis=1)
    cells = {(r.node, r.cell) for r in placed.collect()}
    linked = np.argwhere(u @ u.T >= 0.98)
    assert len(linked) > 400
    assert all((b, own[a]) in cells for a, b in linked.tolist())  # each neighbour of a home vector is there
    for node, cell in cells:
        between = np.linalg.norm(p[cell] - p[own[node]])
        assert d[node, cell] ** 2 - d[node, own[node]] ** 2 <= 2 * radius * between + 1e-5
