"""The chunk index: a Parquet table partitioned by collection, in generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.predicates import article_tag
from doclens.functions.text import strip
from doclens.operators import generations


def collection_of(kind: Column) -> Column:
    """"law" is the law collection; all others are knowledge."""
    return F.when(kind == "law", "law").otherwise("knowledge")


def record_id(collection: Column, source: Column, chunk_index: Column) -> Column:
    """The stable id of an index row: a hash of what names it, as JSON."""
    return F.sha2(F.to_json(F.struct(collection.alias("collection"), source.alias("source"), chunk_index.alias("chunk_index"))), 256)


def records(chunks: DataFrame, collection: str = "collection", source: str = "source", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks as index rows: trimmed, blank ones dropped (numbers stay those before), with article, a stable id and, by `embed`, an embedding."""
    rows = chunks.withColumn("text", strip(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("article", article_tag(F.col("text"))).withColumn("id", record_id(F.col(collection), F.col(source), F.col("chunk_index")))
    return rows if embed is None else rows.withColumn("embedding", embed(F.col("text")))


def add(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Rows as one new generation of the index; of a batch that was added before, nothing is written again."""
    generations.add(rows.sparkSession, path, rows, batch)


def read(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame | None:
    """The index at a path as it is now, or as a generation had it; None if there is nothing. What is changed later does not show in it."""
    found = generations.rows(spark, path, generations.load(spark, path, generation))
    return None if found is None else found.drop("batch")


def count_by_source(index: DataFrame) -> DataFrame:
    return index.where("source <> ''").groupBy("source").agg(F.count("*").alias("chunks"))


def list_sources(index: DataFrame) -> DataFrame:
    return index.where("source <> ''").select("source").distinct()


def without_source(index: DataFrame, source: str) -> DataFrame:
    return index.where(~F.col("source").eqNullSafe(source))


def delete_by_source(spark: SparkSession, path: str, collection: str, source: str) -> int:
    """Removes a source's rows from one collection and says how many there were. Only the files that have some are written anew, aside; the change
    counts at once or not at all, and readers keep what they read. generations.vacuum frees the old files."""
    return generations.replace(spark, path, collection, F.col("source").eqNullSafe(source))


def first_per_label(docs: DataFrame, label: Column, order: str) -> DataFrame:
    """(label, first, duplicates): with equal labels the first in order is taken, the others are duplicates. Pre-aggregated, so a common label spreads."""
    return docs.groupBy(label.alias("label")).agg(F.min(order).alias("first"), (F.count("*") - 1).alias("duplicates"))


def new_labels(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents whose label (source) is in no row of the index."""
    return docs.join(list_sources(index), "source", "left_anti")
