"""The near-copy stage against brute force on 5-word shingles at 0.8."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_near_copies(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for k in range(12):
        text = [rng.choice(words) for _ in range(200)]
        at = 60 + k
        texts += [text, text + [rng.choice(words) for _ in range(40 + k)], text[:at] + [rng.choice(words) for _ in range(14 + k)] + text[at + 14 + k :]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {k for k in range(len(texts)) if low[k] == k}


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_ string, judged_lang_ string, x string"


def table(spark):
    """Nulls in each column, empty and blank texts, repeated rows and ids, copies of a text, a long text."""
    prose = "the quick brown fox jumps over the lazy dog while seven other animals watch from a quiet hill near the old mill"
    rows = [(k, f"{prose} and sees number {k} of many more things that nobody has ever seen", "en", "s1", 100, "a", "b", None) for k in range(6)]
    rows += [(10, prose, "en", "s1", 1, None, None, "z"), (11, prose, None, None, None, None, None, None), (None, prose, "en", "s2", 1, None, None, "z"), (None, prose, "en", "s2", 1, None, None, "z"),
             (12, "", "en", "s1", 0, None, None, None), (13, None, "en", "s1", None, None, None, None), (14, " \n ", "en", None, 3, None, None, None), (15, "mail to a.b@mail.example.com now please", "en", "s1", 1, None, None, None),
             (15, "something else that has letters", None, "s1", 1, None, None, None), (None, None, None, None, None, None, None, None), (16, " ".join(f"word{k}" for k in range(20000)), "en", "s3", 1, None, None, None)]
    rows += [rows[0], rows[0], (17, "กขค" * 200, "th", "s4", 1, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_on_odd_rows(spark):
    """Each stage keeps the columns and does what its docstring says on odd rows and on an empty table."""
    docs = table(spark).cache()
    none = docs.limit(0)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    assert listed(kept.select("doc_id", "text")) == listed(docs.where("text rlike '\\\\p{L}'").select("doc_id", "text"))
    near = stages["ngram_join"](spark, docs, "")
    assert near.columns == docs.columns
    got = listed(near.select("doc_id", "text"))
    copies = listed(docs.where("text like 'the quick%mill'").select("doc_id", "text"))
    assert [r for r in got if r in copies] == [r for r in copies if r[0] == 10]
    assert [r for r in got if r[0] in (0, 12, 13, 14, 15, 16, 17)] == [r for r in listed(docs.select("doc_id", "text").distinct()) if r[0] in (0, 12, 13, 14, 15, 16, 17)]
    hidden = stages["pii"](spark, docs, "")
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    assert [r.n_chars for r in hidden.where("text is null").collect()] == [None, None] and "[EMAIL]" in hidden.where("doc_id = 15 and text like 'mail%'").first().text
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and not mixed.where("text is null or trim(text) = '' or text rlike '^\\\\s+$'").count()
    assert mixed.select("doc_id", "source").distinct().exceptAll(docs.select("doc_id", "source").distinct()).count() == 0
    assert stages["bpe"](spark, docs, "").count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
