"""The queries opN_<name> over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import bpe, embedding_join, language_id, licenses, mixing, ngram_join, pii, quality_rules, substring_dedup, toxicity

#: Severity grades of the labels: 0 not toxic, 1 toxic, 2 toxic in a text of low quality.
GRADE = "if(toxic = 1, if(coalesce(quality, 1) = 0, 2, 1), toxic)"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), F.expr(GRADE))
    return toxicity.predict_severity(docs, model)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.vector_components(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.host_quality(_table(spark, sf_dir, "documents")).documents
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_ok", "kept")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(_table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.fit_licenses(docs))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"), everywhere=True).drop("x", "y")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit_language_model(docs, vocabulary("piece_bpe_32k.model"))
    return language_id.predict_language(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_quality_rules, op4_ngram_join, op5_suffix_dedup, op6_bpe, op7_mixing, op8_licenses, op9_pii, op10_language_id)}

SQL_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SQL_OP2 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.b AS component_id, e.vec_id = l.b AS kept FROM embeddings e JOIN low l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id"""

#: Base columns by windows over word positions; hosts with the prior of ``shrunken_rates``.
SQL_OP3 = f"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {SQL_WORDS.format('text')} AS w FROM documents),
word AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM word) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, source, len(w) AS n_words, CAST(list_sum([0] || list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id LEFT JOIN line l ON l.doc_id = t.doc_id),
f AS (SELECT *, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS fails, unnest(range(5)) AS rule FROM m),
host AS (SELECT source, rule, count(*) AS n, sum(CAST(fails AS INT)) AS k FROM f GROUP BY source, rule),
prior AS (SELECT rule, sum(k) / sum(n) AS p, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS v FROM host GROUP BY rule),
strong AS (SELECT rule, p, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, p * (1 - p) / v - 1)) ELSE 1e6 END AS s FROM prior),
verdict AS (SELECT source, NOT bool_or((k + p * s) / (n + s) > 0.6) AS ok FROM host JOIN strong USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, ok AS host_ok,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ok AS kept FROM m JOIN verdict v ON v.source IS NOT DISTINCT FROM m.source"""

SQL_OP4 = f"""WITH RECURSIVE t AS (SELECT doc_id, {SQL_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.b AS component_id FROM documents d JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: SQL of the operators that SQL expresses on whole tables.
ORACLE_SQL: dict[str, str] = {"op2_embedding_dedup": SQL_OP2, "op3_quality_rules": SQL_OP3, "op4_ngram_join": SQL_OP4}
