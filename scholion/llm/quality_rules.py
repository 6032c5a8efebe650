"""Quality rules per document, and verdicts per host with failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.session import hinted, materialize

SPACES = "[\\x20\\x09-\\x0D]+"
#: Rules by name; each is true where a document fails it. They read the columns of ``text_metrics``.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
#: Rules that reject a document by themselves.
BASE = ("few_words", "repeats")


@dataclass
class HostReport:
    """``documents``: metrics, rule failures and verdict of each document; ``hosts``: counts and shrunken rates."""

    documents: DataFrame
    hosts: DataFrame


def _with(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more in the text, the first occurrence included."""

    def covered(at: Column) -> Column:
        # each window covers the words from its start to the next start, three at most
        after = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0)))
        return F.aggregate(F.zip_with(at, after, lambda p, q: F.least(F.lit(3), F.coalesce(q, p + 3) - p)), F.lit(0).cast("long"), lambda s, x: s + x)

    def repeated(h: Column) -> Column:
        """h: hashes of the windows, sorted with their places, so equal ones are neighbours however long the text is."""
        keys = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(k: Column) -> Column:
            pairs = F.zip_with(k, F.slice(k, 2, F.size(k)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))

        return _with(_with(keys, twins), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(F.lit(0).cast("long")))

    hashes = F.slice(F.transform(words, lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.when(F.size(words) > 3, _with(hashes, repeated)).otherwise(F.lit(0).cast("long"))


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of each whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``, lengths count code points; a null text has no words. Extra columns are dropped.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    per_line = _with(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    symbols = F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACES), "")
    facts = _with(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))
    rows = base.select("doc_id", "host", symbols.alias("n_symbols"), facts.alias("w"), per_line.alias("l"))
    return rows.select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def shrunken_rates(counts: DataFrame, rules: list[str]) -> DataFrame:
    """Add ``rate_<rule>`` to ``counts(host, n, fails_<rule>...)``: the posterior mean of each host's failure rate.

    The beta prior of a rule comes from all hosts by the method of moments: mean m of the rates, weighted by n, and
    their variance beyond the binomial noise; its strength is m (1 - m) / variance - 1, between 1 and 1e6.
    """
    sums = []
    for r in rules:
        rate = F.col(f"fails_{r}") / F.col("n")
        sums += [F.sum(f"fails_{r}").alias(f"f_{r}"), F.sum(F.col("n") * rate * rate).alias(f"q_{r}")]
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *sums).first()
    out = counts
    for r in rules:
        n, hosts = total.n or 1, total.hosts or 1
        m = (total[f"f_{r}"] or 0) / n
        noise = m * (1 - m) * hosts / n
        spread = max(0.0, (total[f"q_{r}"] or 0.0) / n - m * m - noise)
        strength = min(1e6, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6
        out = out.withColumn(f"rate_{r}", (F.col(f"fails_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)))
    return out


def host_quality(docs: DataFrame, threshold: float = 0.6, rules: dict[str, str] | None = None, base: tuple[str, ...] = BASE, **columns: str) -> HostReport:
    """Judge documents by the rules and by their hosts.

    ``documents`` has the metrics, ``base_failed`` (a rule in ``base`` fails), ``host_ok`` and ``kept``: false if
    base_failed, else the host's verdict. A host is rejected if the shrunken failure rate of any rule exceeds
    ``threshold``. Documents with a null host form one host. DataFrame functions only: hosts are counted by partial
    aggregates, a hot host's rows come back to its verdict by a broadcast of a counted table or a join that AQE splits.
    """
    rules = RULES if rules is None else rules
    rows = text_metrics(docs, **columns)
    for name, rule in rules.items():
        rows = rows.withColumn(f"fails_{name}", F.expr(rule))
    rows = materialize(rows, "metrics")
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"fails_{r}").cast("long")).alias(f"fails_{r}") for r in rules))
    counts = materialize(counts, "hosts")
    hosts = shrunken_rates(counts, list(rules))
    bad = F.lit(False)
    for r in rules:
        bad = bad | (F.col(f"rate_{r}") > threshold)
    verdicts = hosts.select(F.col("host").alias("of_host"), (~bad).alias("host_ok"))
    failed = F.lit(False)
    for r in base:
        failed = failed | F.col(f"fails_{r}")
    out = rows.join(hinted(verdicts), F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host").withColumn("base_failed", failed)
    return HostReport(out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")), hosts)
