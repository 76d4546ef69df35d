"""Documents that arrive in a stream, added to the index batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.operators import chunking, index, ingestion


def start(docs: DataFrame, index_path: str, checkpoint: str, embed: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """docs (doc_id, source, collection, text) as a stream: of each batch, documents whose source is new are chunked and appended.

    Of a source, the document with the smallest id counts. Documents without a source (null) are no copies of each other: all are added. With `embed`, rows
    have embeddings, and the duplicates of ingestion.ingest by label and content are left out instead, source being what the document itself says.
    """

    def batch(df: DataFrame, number: int) -> None:
        if embed is not None:
            ingestion.ingest(df, index_path, embed, batch=f"{checkpoint}-{number}")
            return
        spark = df.sparkSession
        named, unnamed = df.where("source is not null"), df.where("source is null")
        firsts = named.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
        new, stored = named.join(firsts, ["source", "doc_id"]), index.read(spark, index_path)
        if stored is not None:
            new = index.new_labels(new, stored)
        new = new.select("doc_id", "source", "collection", "text").union(unnamed.select("doc_id", "source", "collection", "text"))
        cut = new.select("doc_id", "source", "collection", F.explode(chunking.chunk_arrays(F.col("text"))).alias("c")).select("doc_id", "source", "collection", "c.chunk_index", "c.text")
        named_by = F.coalesce("source", F.concat(F.lit("\x00"), F.col("doc_id").cast("string")))
        rows = index.records(cut.withColumn("__name", named_by), source="__name").select("collection", "id", "source", "article", "chunk_index", "text")
        index.add(rows, index_path, f"{checkpoint}-{number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_stateful(docs: DataFrame, index_path: str, checkpoint: str, keep: str = "30 days", embed: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """docs (doc_id, source, collection, text, time) as a stream: those whose source and content are new are chunked and appended; the index is never read.

    What came before is in the state store: the sources and the hashes of the contents (white space apart) of each collection, until the watermark, which
    follows `time` by `keep`, has passed them. So a repeated document is left out as long as it comes within `keep`, also after a restart; a document older than
    the watermark is dropped. Of new ones that are alike inside one micro-batch, one stays, whichever Spark reads first. A content counts as known from the first
    document on that has it, even if that one is left out for its source. Documents without a source (null) are compared by content only; null texts bring
    nothing. A micro-batch that is run again adds nothing twice: its number is the name of its generation.
    """
    content = F.sha2(F.regexp_replace(F.trim(F.col("text")), r"\s+", " "), 256)
    named = docs.where("text is not null and collection is not null").withColumns({"content": content, "label": F.coalesce("source", F.concat(F.lit("\x00"), F.col("doc_id").cast("string")))})
    new = named.withWatermark("time", keep).dropDuplicatesWithinWatermark(["collection", "content"]).dropDuplicatesWithinWatermark(["collection", "label"])

    def batch(df: DataFrame, number: int) -> None:
        cut = df.select("doc_id", "source", "label", "collection", F.explode(chunking.chunk_arrays(F.col("text"))).alias("c")).select("doc_id", "source", "label", "collection", "c.chunk_index", "c.text")
        rows = index.records(cut, source="label", embed=embed)
        index.add(rows.select("collection", "id", "source", "article", "chunk_index", "text", *(["embedding"] if embed else [])), index_path, f"{checkpoint}-{number}")

    return new.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
