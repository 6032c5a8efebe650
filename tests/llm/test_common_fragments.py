"""Fragments that many sets agree on are left out where the plan has room, and no link is lost."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("scholion.llm")

from scholion.llm import ngram_join


def shingles(text, size):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_common_passages_make_few_pairs(spark, monkeypatch):
    """Long texts that share a few passages each, far below the threshold, are hardly paired; near copies still link."""
    rng = random.Random(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(24)) for k in range(12)]
    texts = []
    for d in range(150):
        parts = [" ".join(f"d{d}w{j}x{i}" for i in range(40)) for j in range(45)]
        for k in rng.sample(range(12), 10):
            parts.insert(rng.randrange(len(parts)), passages[k])
        texts.append(" ".join(parts))
    for d in range(0, 150, 15):  # a near copy: some words replaced
        words = texts[d].split()
        for i in rng.sample(range(len(words)), 15):
            words[i] = f"new{d}x{i}"
        texts.append(" ".join(words))
    made, whole = {}, ngram_join.materialize

    def counting(df, name="table"):
        out = whole(df, name)
        made[name] = made.get(name, 0) + (out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(ngram_join, "materialize", counting)
    rows = ngram_join.ngram_jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), size=5, percent=80).collect()
    sets = [shingles(t, 5) for t in texts]
    low = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low[b] = min(low[b], low[a])
    assert sum(x != i for i, x in enumerate(low)) >= 8
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), low[i]) for i in range(len(texts))}
    assert made["pairs"] <= 25 * len(texts)  # 12,189 if no fragment is left out


def test_rare_keys_lose_no_pair(spark):
    """Sets of common and rare n-grams: each pair with the similarity still shares a key after the common ones are left out."""
    rng = np.random.default_rng(6)
    common = rng.integers(-(2**63), 2**63, 60)
    for percent in (80, 85):
        sets = []
        for _ in range(60):
            n = int(rng.integers(5, 300))
            a = np.unique(np.concatenate([rng.integers(-(2**63), 2**63, n), rng.permutation(common)[: int(rng.integers(0, 60))]]))
            sets.append(a)
            for _ in range(2):
                room = (100 - percent) * len(a) // (100 + percent)
                sets.append(np.unique(np.concatenate([rng.permutation(a)[room:], rng.integers(-(2**63), 2**63, room)])))
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        row, key, lot = ngram_join.FragmentPlan(percent).lots(np.concatenate(sets), bounds)
        n = np.diff(bounds)
        rows = sorted(zip(key.tolist(), row.tolist(), ((lot.astype(np.int64) << 32) + n[row]).tolist(), strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["h", "node", "lot"])
        met = pa.Table.from_batches(ngram_join._counted(iter([batch.slice(lo, 1000) for lo in range(0, len(rows), 1000)])))
        kept = ngram_join._rare(spark.createDataFrame(met.to_pandas(), "h long, node long, lot long, often int")).collect()
        assert len(kept) < met.num_rows
        assert all(r.n == n[r.node] for r in kept)
        nodes = {}
        for r in kept:
            nodes.setdefault(r.h, set()).add(r.node)
        meet = {(a, b) for group in nodes.values() for a in group for b in group if a < b}
        for b in range(len(sets)):
            for a in range(b):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= percent * (n[a] + n[b] - both):
                    assert (a, b) in meet, (percent, n[a], n[b], both)


@pytest.mark.parametrize("limit", [5, 100_000])
def test_keys_are_counted_across_batches(monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "GROUP", limit)
    rng = random.Random(7)
    rows = sorted({(rng.randrange(12), rng.randrange(40), 9) for _ in range(150)} | {(50, 1, 9), (60, 1, 9), (60, 2, 9), (61, 1, 9), (61, 2, 9)})
    rows = sorted(rows + rows[:20])
    want = {}
    for h, node, _ in rows:
        want.setdefault(h, set()).add(node)
    for size in (1, 7, 1000):
        got = {}
        parts = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[lo : lo + size], strict=True)], ["h", "node", "lot"]) for lo in range(0, len(rows), size))
        for b in ngram_join._counted(parts):
            for h, node, often in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                assert node not in got.setdefault(h, {})
                got[h][node] = often
        for h, nodes in want.items():
            if len(nodes) >= ngram_join.COMMON:
                assert got[h] == dict.fromkeys(nodes, min(len(nodes), limit))
        small = {frozenset(v) for h, v in want.items() if 1 < len(v) < ngram_join.COMMON}
        assert {frozenset(v) for h, v in got.items() if len(v) < ngram_join.COMMON} == small
