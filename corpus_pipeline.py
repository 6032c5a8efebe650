"""A corpus pipeline of five stages: language, near copies, personal data, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import bpe, language_id, mixing, ngram_join, pii
from scholion.llm.queries import vocabulary
from scholion.session import discard, hinted, materialize


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they are none of the table's columns (in any case of letters)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language with a score of one half or more; the rest go.

    So null texts and texts without a letter go, and all texts if no language was learned (no labels, an empty table).
    Rows are judged one by one: repeated rows, null or repeated ids and other null columns do not matter.
    """
    model = language_id.fit_language_model(docs, vocabulary("piece_bpe_32k.model"))
    lang, score = _fresh(docs, "judged_lang_", "judged_score_")
    judged = language_id.predict_language(docs, model, keep=[c for c in docs.columns if c != "doc_id"], names=(lang, score))
    return judged.where(f"{lang} <> 'und' and {score} >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of 5-word shingle sets with a Jaccard of 0.8 or more stays.

    It is the one with the smallest id, null last, then by a hash of the row; of repeated rows one stays. Rows without
    words (null, empty, blank texts) are in no group and all stay.
    """
    row, x, y = _fresh(docs, "row_", "row_x_", "row_y_")
    names = docs.columns
    keyed = docs.withColumns({x: F.xxhash64(*names), y: F.xxhash64(F.lit(1), *names)})
    ids = keyed.withColumn(row, F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(x).alias("x"), F.col(y).alias("y")))
    groups = ngram_join.ngram_jaccard_components(ids, id_col=row, size=5, percent=80).where("n_shingles > 0")
    members = materialize(groups.groupBy("doc_id.x", "doc_id.y").agg(F.count("*").alias("n"), F.min(F.col("doc_id") == F.col("component_id")).alias("stays")), "near")
    listed = lambda rows: hinted(rows.select(F.col("x").alias(x), F.col("y").alias(y)))
    kept = keyed.join(listed(members.where("not stays")), [x, y], "left_anti")
    again = members.where("stays and n > 1")
    if again.limit(1).count():
        again = listed(again)
        kept = kept.join(again, [x, y], "left_anti").unionByName(kept.join(again, [x, y], "left_semi").dropDuplicates([x, y]))
    return kept.select(*names)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; n_chars follows.

    All rows stay; null texts stay null, with a null n_chars. Equal rows get equal texts.
    """
    return pii.sanitised_documents(docs, everywhere=True).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target of words: documents are left out, cut or repeated.

    Texts without words give nothing and go. A null source is a source. Repeated rows share what they give.
    """
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row of the mix; a null text has none."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", keep_languages), ("ngram_join", drop_near_copies), ("pii", hide_personal_data), ("mixing", mix), ("bpe", encode)]

#: Language scores, partial overlaps and merges have no SQL; a brute-force version in tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
