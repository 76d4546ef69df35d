"""Ingestion of a batch: each document in order is a duplicate of the index, of an earlier accepted one, or accepted itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import predicates
from doclens.operators import chunking, index, metadata, retrieval
from doclens.operators.greedy import accept, alike, dropped, kept  # noqa: F401


def embed(c: Column, dims: int = 256) -> Column:
    """A stand-in for a sentence model: counts of hashed words, at length 1 (texts without words: zero). Any array<double> column may take its place."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> np.ndarray:
            v = np.bincount([crc32(w.encode()) % dims for w in (text or "").lower().split()], minlength=dims).astype(float)
            return v / (np.linalg.norm(v) or 1.0)

        for b in batches:
            yield b.map(one)

    return vectors(c)


def probe(body: Column, text: Column) -> Column:
    """What a document's duplicates are looked for with: the first 2000 characters of its body, else of its text."""
    return F.substring(F.btrim(F.when(body != "", body).otherwise(text)), 1, 2000)


def preview(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, so_van_ban, label, chunks, n_chunks) a document would have in the index. Nothing is written."""
    meta = metadata.extract_metadata(docs, id_col, text_col)
    label = predicates.source_label(F.col("so_van_ban"), F.col("tieu_de"), F.col("issuer"))
    text = F.when(F.col("body_text") != "", F.col("body_text")).otherwise(F.col("clean_text"))
    return meta.select(id_col, "so_van_ban", label.alias("label"), chunking.chunk_arrays(text).alias("chunks")).withColumn("n_chunks", F.size("chunks"))


def _twins(v: Column) -> Column:
    """The class of equal vectors that a vector is in; null for one that can't be compared."""
    return F.when(retrieval.comparable(v), F.sha2(F.to_json(F.transform(v, lambda x: x + F.lit(0.0))), 256))


def resolve(batch: DataFrame, index: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, label, status) of a batch (id, label, v), in the order of id, against an index (id, label, v) and itself.

    Vectors are alike where 1 - squared distance reaches `least`; an index row without a label is no match. Documents without a label
    (null) are compared by vectors only, those whose vector can't be compared by labels only. Equal vectors are one class, compared once. The classes of the
    batch are the query set, read in blocks; the index is passed over once for each block.
    """
    rows = batch.select("id", "label", _twins(F.col("v").cast("array<double>")).alias("twin"), "v")
    classes = rows.where("twin is not null").groupBy("twin").agg(F.first("v").alias("v"))
    own = classes.select(F.col("twin").alias("query_id"), "v")
    stored = index.where("label <> ''")
    place = lambda df, seq: df.withColumns({"seq": F.lit(seq).cast("long"), "collection": F.lit("")})
    old = retrieval.hits(place(own, 1), place(stored.select("id", "v"), 0), least).select(F.col("query_id").alias("twin"), F.lit(True).alias("alike"))
    known = stored.select("label").distinct().withColumn("known", F.lit(True))
    refused = F.coalesce("alike", F.lit(False)) | F.coalesce("known", F.lit(False))
    new = kept(rows.drop("v").join(old, "twin", "left").join(known, "label", "left").select("id", "label", "twin", refused.alias("refused")))
    left = new.where("not refused").select(F.col("id").alias("seq"), "label", "twin", F.lit(True).alias("counts"))
    vectors = kept(classes.select("twin", F.lit("").alias("collection"), "v"))
    done = alike(left, vectors, vectors, least).withColumnRenamed("seq", "id")
    return new.join(done, "id", "left").select("id", "label", F.coalesce("status", F.lit("duplicate")).alias("status"))


def prepared(docs: DataFrame, embed: Callable[[Column], Column] = embed, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of docs (id, collection, text) as the index would have them.

    documents: seq (a number in the order of ids, then collections), doc_id, collection, label, issuer, so_van_ban, v (of the first 2000 characters, which
    duplicates are looked for with). chunks: the same without v, and chunk_index, text (trimmed; blank ones are dropped), embedding.
    """
    one = docs.select(F.col(id_col).alias("doc_id"), "collection", F.col(text_col).alias("text"))
    dealt = one.repartitionByRange("doc_id", "collection").sortWithinPartitions("doc_id", "collection").withColumn("seq", F.monotonically_increasing_id())
    numbered = kept(dealt)
    meta = metadata.extract_metadata(numbered, "seq", "text").join(numbered.select("seq", "doc_id", "collection"), "seq")
    label = predicates.source_label(F.col("so_van_ban"), F.col("tieu_de"), F.col("issuer"))
    text = F.when(F.col("body_text") != "", F.col("body_text")).otherwise(F.col("clean_text"))
    fields = ["seq", "doc_id", "collection", "label", "issuer", "so_van_ban"]
    rows = meta.select(*fields[:3], label.alias("label"), "issuer", "so_van_ban", embed(probe(F.col("body_text"), F.col("clean_text"))).alias("v"), text.alias("text"))
    rows = kept(rows)
    chunks = rows.select(*fields, F.explode(chunking.chunk_arrays(F.col("text"))).alias("c")).select(*fields, "c.chunk_index", "c.text")
    made = index.records(chunks.withColumn("source", F.col("label")), embed=embed)
    return rows.drop("text"), kept(made)


def decided(documents: DataFrame, chunks: DataFrame, stored: DataFrame | None, least: float = 0.8) -> DataFrame:
    """(doc_id, collection, source, status, matched_source, chunks, existing_chunks) of prepared documents, in the order of seq.

    status is duplicate if the document's label is in the index, or if its probe is alike (1 - squared distance of at least `least`) to a chunk of the same
    collection; success if not; empty without any chunk. Earlier accepted documents of the batch count as the index does. matched_source is the
    source of the nearest chunk, where the label isn't known; chunks is how many were added, existing_chunks how many a duplicate's source had
    when the document came.
    """
    docs = documents.join(chunks.groupBy("seq").agg(F.count("*").alias("n")), "seq", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = lambda c: F.concat_ws("\x00", "collection", c)
    docs = kept(docs.withColumn("key", key("label")))
    probes = docs.select("seq", "collection", "v")
    asked = probes.withColumnRenamed("seq", "query_id").withColumn("seq", F.col("query_id"))
    fields = ["seq", "similarity", "source"]
    if stored is None:
        old, had = docs.limit(0).select("seq", F.lit(0.0).alias("similarity"), F.col("label").alias("source")), docs.limit(0).select("key", F.lit(0).cast("long").alias("had"))
    else:
        rows = stored.where("source <> ''").select(F.struct("source", "id").alias("id"), "collection", F.col("embedding").alias("v"), F.lit(-1).alias("seq"))
        old = retrieval.hits(asked, rows, least).select(F.col("query_id").alias("seq"), "similarity", F.col("id.source").alias("source"))
        had = stored.where("source <> ''").groupBy(key("source").alias("key")).agg(F.count("*").alias("had"))
    old, had = kept(old), kept(had)
    refused = docs.join(had.select("key", F.lit(True).alias("known")), "key", "left").join(old.select("seq", F.lit(True).alias("alike")), "seq", "left")
    refused = kept(refused.select(*docs.columns, F.coalesce("known", F.lit(False)).alias("known"), (F.coalesce("known", F.lit(False)) | F.coalesce("alike", F.lit(False))).alias("refused")))
    left = refused.where("not refused").select("seq", F.col("key").alias("label"), F.col("seq").alias("twin"), (F.col("n") > 0).alias("counts"))
    # Links go one way here: the probe of the later document against the chunks of the earlier one.
    own = chunks.select(F.col("seq").alias("twin"), "collection", F.col("embedding").alias("v"))
    state = alike(left, probes.withColumnRenamed("seq", "twin"), own, least)
    status = F.when(F.col("refused") | (F.col("status") == "duplicate"), "duplicate").when(F.col("n") == 0, "empty").otherwise("success")
    rows = kept(refused.join(state, "seq", "left").withColumn("status", status))
    # What was accepted: of each label one document, as labels refuse.
    taken = rows.where("status = 'success'").select("key", F.col("seq").alias("first"), F.col("n").alias("took"))
    again = rows.where("status = 'duplicate'").select("seq")
    accepted = chunks.join(taken.select(F.col("first").alias("seq")), "seq", "left_semi").select(F.struct("source", "id").alias("id"), "collection", F.col("embedding").alias("v"), "seq")
    near = retrieval.hits(asked.join(again, "seq", "left_semi"), accepted, least).select(F.col("query_id").alias("seq"), "similarity", F.col("id.source").alias("source"))
    best = old.select(*fields).union(near.select(*fields)).groupBy("seq").agg(F.min_by("source", F.struct(-F.col("similarity"), F.col("source"))).alias("matched"))
    same = F.col("known") | F.coalesce(F.col("first") < F.col("seq"), F.lit(False))
    rows = rows.join(best, "seq", "left").join(taken.select("key", "first"), "key", "left")
    rows = rows.withColumn("matched_source", F.when((F.col("status") == "duplicate") & ~same, F.col("matched"))).drop("first")
    rows = rows.withColumn("key", F.when(F.col("status") == "duplicate", key(F.coalesce("matched_source", "label")))).join(had, "key", "left").join(taken, "key", "left")
    before = F.coalesce("had", F.lit(0)) + F.when(F.col("first") < F.col("seq"), F.col("took")).otherwise(0)
    added = F.when(F.col("status") == "success", F.col("n")).otherwise(0)
    out = kept(rows.select("doc_id", "collection", F.col("label").alias("source"), "status", "matched_source", added.alias("chunks"), before.cast("long").alias("existing_chunks")))
    dropped(docs, old, had, refused)
    return out


def ingest(docs: DataFrame, path: str, embed: Callable[[Column], Column] = embed, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, batch: str | None = None) -> DataFrame:
    """What decided says of docs (id, collection, text), whose accepted chunks are added to the index at path, as the batch of that name. Ids are longs and in the order of arrival.

    A null text has no chunks; a row without an id or collection is left out; of rows that repeat an id and collection the one with the smallest text counts
    (null first). An id may be in several collections: each is a document of its own.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col("collection").isNotNull()).groupBy(id_col, "collection").agg(F.min(F.struct(F.col(text_col).alias("t"))).alias("x"))
    documents, chunks = prepared(rows.select(id_col, "collection", F.col("x.t").alias(text_col)), embed, id_col, text_col)
    out = decided(documents, chunks, index.read(docs.sparkSession, path), least)
    good = chunks.join(out.where("status = 'success'").select("doc_id", "collection"), ["doc_id", "collection"], "left_semi")
    index.add(good.select("collection", "id", "source", "article", "chunk_index", "issuer", "so_van_ban", "text", "embedding"), path, batch)
    dropped(documents, chunks)
    return out
