"""The queries against their SQL and, where SQL cannot say it, against brute force on the small tables."""

import hashlib
import os

import pytest

pytest.importorskip("scholion.llm")

from oracle import compare, connect
from scholion.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    message = compare(Q.QUERIES[name](spark, SF_DIR), Q.ORACLE_SQL[name], connect(SF_DIR))
    assert message is None, message


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = [r for r in Q.op10_language_id(spark, SF_DIR).collect() if r.held_out]
    assert len(rows) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_pipeline(spark):
    """Each stage's decisions follow from its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        before, current = current, Q_materialize(stage(spark, current, SF_DIR))
        kept[name] = current
        if name != "bpe":
            assert current.columns == docs.columns
        if name == "ngram_join":
            con = connect(SF_DIR)
            con.register("stage_in", before.toPandas())
            con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM stage_in")
            want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({Q.SQL_OP4}) WHERE doc_id = component_id").fetchall()}
            assert {r.doc_id for r in current.collect()} == want
        if name == "pii":
            assert current.count() == before.count() and not any("@" in r.text and ".example" in r.text for r in current.select("text").collect() if r.text and "@mail" in r.text)
    from scholion.llm.bpe import ByteBpe

    own = ByteBpe(open(Q.vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, own.encode(r.text))).encode()).hexdigest()) for r in kept["mixing"].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in kept["bpe"].collect()) == want
    assert kept["language_id"].count() >= 0.95 * docs.count()


def Q_materialize(df):
    from scholion.session import materialize

    return materialize(df, "stage")
