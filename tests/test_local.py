"""Layers of a document are worked on where its text lies: no exchange, and the results of plain loops."""

import random
import re

import pyarrow as pa
import pytest

from scholion.operators.local import Nodes, Texts, checked, inside, runs, segments
from scholion.plans import derived

TOKEN = re.compile("[a-zA-Z]+|[0-9]+|[ \t\r\n\f\x0B]+|[^ \t\r\n\f\x0Ba-zA-Z0-9]")
TEXTS = [(1, "ab 12é\n\n漢 x"), (2, None), (3, ""), (4, "\n"), (5, "😀a1 .\t\n" * 40)]


@pytest.mark.parametrize("name", ["line_runs", "line_words", "line_bodies", "token_segments", "compact_words"])
def test_no_exchange(spark, name):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").repartition(2).localCheckpoint()
    out = getattr(derived, name)(docs)
    assert out.count() > 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_against_loops():
    pick = random.Random(1)
    for k in range(60):
        texts = [None if pick.random() < 0.1 else "".join(pick.choice("ab1 \n\n.é漢😀\t") for _ in range(pick.choice([0, 1, 5, 30]))) for _ in range(6)]
        x = Texts(pa.array([*texts, "zz"]).slice(0, 6) if k % 2 else pa.array(texts, pa.string()))
        nodes, _, begin, end = derived.token_nodes(x)
        tokens, lines, cut = [], [], []
        for r, text in enumerate(texts):
            own = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text or "") if m.group().strip(" \t\r\n\f\x0b")]
            tokens += [(r, i, *t) for i, t in enumerate(own)]
            cuts = sorted({0, len(text or ""), *(p for t in own for p in t[:2])})
            cut += [(r, a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            at = 0
            for j, line in enumerate(text.split("\n") if text is not None else ()):
                lines.append((r, j, at, at + len(line), [i for i, t in enumerate(own) if t[0] < max(at + len(line), at + 1) and at < t[1]]))
                at += len(line) + 1
        assert list(zip(nodes.row, nodes.node, nodes.start, nodes.stop, x.between(begin, end).to_pylist(), strict=True)) == tokens
        line = derived.line_nodes(x)
        members = [[] for _ in line.row]
        for run, at in zip(*inside(*runs(line, nodes)), strict=True):
            members[run].append(int(nodes.node[at]))
        assert list(zip(line.row, line.node, line.start, line.stop, members, strict=True)) == lines
        row, start, segment = segments(x, nodes)
        assert list(zip(row, start, segment.to_pylist(), strict=True)) == cut


def test_spans_outside_are_an_error():
    import numpy as np

    texts, one = Texts(pa.array(["é", "abc"])), lambda *v: [np.array([x]) for x in v]
    assert checked(texts, Nodes(*one(1, 0, 0, 3)))
    for bad in ((0, 0, 0, 2), (1, 0, 2, 1), (1, 0, -1, 1)):
        with pytest.raises(ValueError, match="invalid spans"):
            checked(texts, Nodes(*one(*bad)))
