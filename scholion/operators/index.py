"""Equality indexes over document properties."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def property_postings(docs: DataFrame, *properties: str) -> DataFrame:
    """(property, value, doc_id): one row for each property that a document has; missing ones are not indexed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties)))
    return docs.select("doc_id", pairs.alias("p")).where("p.value is not null").select("p.property", "p.value", "doc_id")


def property_index(docs: DataFrame, *properties: str) -> DataFrame:
    """(property, value, n, doc_ids): documents of each value, ascending. For values of bounded frequency.

    Postings of any size stay rows: ``property_postings`` written partitioned by property.
    """
    return property_postings(docs, *properties).groupBy("property", "value").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


def search(postings: DataFrame, **conditions: Any) -> DataFrame:
    """(doc_id) of the documents that meet all equality conditions; none for no conditions."""
    if not conditions:
        return postings.select("doc_id").limit(0)
    hits = [postings.where((F.col("property") == k) & (F.col("value") == F.lit(v).cast("string"))).select("doc_id") for k, v in conditions.items()]
    return reduce(DataFrame.intersect, hits) if len(hits) > 1 else hits[0].distinct()


def search_many(indexes: list[DataFrame], **conditions: Any) -> DataFrame:
    """The union of searches over several indexes, in order of the indexes (column ``part``)."""
    return reduce(DataFrame.unionByName, (search(p, **conditions).withColumn("part", F.lit(k)) for k, p in enumerate(indexes)))


def save_index(postings: DataFrame, path: str) -> None:
    postings.write.partitionBy("property").mode("errorifexists").parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("property", "value", "doc_id")
