"""Mixing sources to target weights with exact word budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.session import hinted, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Ranges of the hash-random key for each shuffle partition, over all sources.
RANGES = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """Add ``target`` to ``sizes(source, source_size)``: the share of all words that each source should give.

    Sources in order of code points, null last, have the weights in turn. No target exceeds ``epochs`` times its
    source's size; the excess goes to the others by weight until none is above. That fixed point is found at once:
    in order of cap / weight, a source is capped if its share of what the ones before it leave exceeds its cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.select(
        "*", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"))
    level = F.col("left") / F.col("weights")
    final = F.max(level).over(every)  # levels rise while sources are to be capped, and fall beyond the fixed point
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * final).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Choose how many words of each document the mix takes: (doc_id, source, key, size, source_size, target, taken).

    Each document has a hash-random key of the seed, its id and text. Within a source the documents stand in order of
    the key; a source is cut into ranges of the key, as many as its share of rows asks for, so a hot source is many
    tasks. Prefix sums: within each range, plus the sums of the ranges before it. The target, rounded to whole words,
    is filled with whole passes over the source and then from the start of the order to the exact word, so ``taken`` of
    a document is a multiple of its size, plus a part of it for the one document at the cut.

    Null texts and texts without words have size 0 and taken 0; a null source is a source. Documents with equal keys
    and ids stand in order of their sizes; such rows with equal sizes are interchangeable. Reruns agree.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"))
    sized = materialize(sized, "sizes")
    sources = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    total = max(1, sources.agg(F.sum("rows")).first()[0] or 0)
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a power of two, so that a range is a value of the key's upper bits
    plan = source_targets(sources, weights, epochs).withColumnRenamed("source", "s").join(sources.select(F.col("source").alias("s2"), "rows"), F.expr("s <=> s2")).drop("s2")
    plan = plan.withColumn("shift", F.lit(63) - F.least(F.lit(40), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") * ranges / F.lit(total)))).cast("int")))
    plan = materialize(plan.drop("rows"), "targets")
    placed = sized.join(hinted(plan), F.expr("source <=> s")).drop("s")
    placed = placed.withColumn("range", F.expr("(key & 9223372036854775807L) >> shift"))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    by = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(by), F.lit(0)).alias("offset"))
    offsets = materialize(offsets, "offsets")
    inside = Window.partitionBy("source", "range").orderBy(F.expr("key & 9223372036854775807L"), "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(hinted(offsets), F.expr("source <=> s and range = r")).withColumn("before", F.col("before") + F.col("offset"))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (whole * F.col("size") + part).cast("long")
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each whole copy, and at the cut the document's first words.

    Rows with equal ids and texts share what they take together; each gets the same part of it, rounded up to a word.
    """
    plan = mix_sources(docs, seed=seed, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("mix_id_"), F.col("key").alias("mix_key_")).agg(F.count("*").alias("rows"), F.max("size").alias("mix_size_"), F.sum("taken").alias("taken"))
    plan = plan.select("mix_id_", "mix_key_", "mix_size_", F.expr("cast(ceil(taken / rows) as long)").alias("mix_taken_"))
    keyed = docs.withColumn("mix_own_", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    rows = keyed.join(plan, (F.col(id_col).eqNullSafe(F.col("mix_id_"))) & (F.col("mix_own_") == F.col("mix_key_")))
    copies = "transform(sequence(0, cast((mix_taken_ - 1) div mix_size_ as int)), i -> cast(least(mix_size_, mix_taken_ - i * mix_size_) as int))"
    rows = rows.withColumn("mix_words_", F.explode(F.expr(copies)))
    pieces = F.regexp_extract_all(text_col, F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("mix_words_") < F.col("mix_size_"), F.array_join(F.slice(pieces, 1, F.col("mix_words_")), "")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)
