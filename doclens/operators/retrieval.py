"""Nearest chunks of each collection for a set of queries, their fused ranking, and the context made of it.

Vectors that are null or have a null or non-finite component are nobody's neighbours and have none; vectors are compared with those of
their own length only. Ids may have any type; a row is no neighbour of the query of its own id, and null ids are unlike each other.

Queries and rows both stay tables: they are dealt to blocks, and a task compares one block of each. What it gives is bounded: the k best rows of each query,
or a summary of its hits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.predicates import article_tag
from doclens.functions.text import strip

#: Queries and rows of a block, about, and queries that are compared with all rows of a block at once.
QUERY_BLOCK, ROW_BLOCK, AT_ONCE = 4096, 4096, 256


def comparable(v: Column) -> Column:
    """Whether a vector can be compared: not null nor empty, no null, infinite or undefined component."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order, nulls first, as Spark sorts them."""
    values = [tuple(x.values()) if isinstance(x, dict) else x for x in ids.to_pylist()]
    known = [i for i, x in enumerate(values) if x is not None]
    place = np.zeros(len(values), dtype=np.int64)
    try:
        known.sort(key=values.__getitem__)
    except TypeError:  # a struct with nulls inside
        known.sort(key=lambda i: tuple((x is not None, x if x is not None else 0) for x in values[i]))
    place[known] = np.arange(1, len(known) + 1)
    return place


def _matrix(v: pa.ChunkedArray, own: np.ndarray, n: int) -> np.ndarray:
    return v.combine_chunks().take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)


def distances(queries: pa.Table, rows: pa.Table, each: Callable[[np.ndarray, np.ndarray, np.ndarray, Callable], None]) -> None:
    """each(queries, rows, d, exact) for pieces of the two: the numbers of the queries and rows, squared distances as products tell them, a row's own
    query's infinite; exact(i, j) computes those of pairs by differences. Products are off by `slack` relative to the squares' sum at the most."""
    sizes, lengths = rows.column("v").combine_chunks().value_lengths().to_numpy(), queries.column("v").combine_chunks().value_lengths().to_numpy()
    names, ids = queries.column("query_id"), rows.column("id")
    same = None
    if names.type == ids.type and not pa.types.is_nested(ids.type):
        same = pc.index_in(names.combine_chunks(), value_set=ids.combine_chunks(), skip_nulls=True)
        copies = {}
        for j, x in enumerate(ids.to_pylist()) if same.null_count < len(same) else ():
            if x is not None:
                copies.setdefault(x, []).append(j)
        named = names.to_pylist()
    for n in sorted(set(sizes.tolist()) & set(lengths.tolist())):
        own, asked = np.flatnonzero(sizes == n), np.flatnonzero(lengths == n)
        x, q = _matrix(rows.column("v"), own, n), _matrix(queries.column("v"), asked, n)
        squares, norms = (x * x).sum(axis=1), (q * q).sum(axis=1)
        place = {j: c for c, j in enumerate(own.tolist())}
        for at in range(0, len(asked), AT_ONCE):
            part = q[at : at + AT_ONCE]
            d = norms[at : at + AT_ONCE, None] + squares[None, :] - 2 * (part @ x.T)
            slack = 1e-12 * (norms[at : at + AT_ONCE, None] + squares[None, :])
            if same is not None:
                for i, k in enumerate(asked[at : at + AT_ONCE].tolist()):
                    if same[k].is_valid:
                        d[i, [place[j] for j in copies[named[k]] if j in place]] = np.inf
            exact = lambda i, j, part=part: np.concatenate([((x[j[a : a + 20_000]] - part[i[a : a + 20_000]]) ** 2).sum(axis=1) for a in range(0, len(i), 20_000)] or [np.zeros(0)])
            each(asked[at : at + AT_ONCE], own, d - slack, exact)


def _in_blocks(queries: DataFrame, rows: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, size: int | None = None) -> DataFrame:
    """fn(queries, rows) for every pair of a block of queries (query_id, v, …) and one of rows (id, v, …). A row is written once for each block of queries."""
    count = lambda df, most: max(1, -(-df.count() // most))
    many, size = count(queries, QUERY_BLOCK), count(rows, size or ROW_BLOCK)
    good = lambda df: df.where(comparable(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = good(queries).withColumns({"__q": F.pmod(F.xxhash64("query_id", "v"), F.lit(many)).cast("int")}).withColumn("__r", every(size))
    right = good(rows).withColumns({"__r": F.pmod(F.xxhash64("id", "v"), F.lit(size)).cast("int")}).withColumn("__q", every(many))
    by = ["__q", "__r"]
    left, right = left.select(*by, *queries.columns).toDF(*by, *queries.columns), right.select(*by, *rows.columns).toDF(*by, *rows.columns)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fn, schema)


def _top(queries: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance): of each query the k nearest rows of each collection, equal ones by id."""
    kinds = np.unique(np.array(["" if x is None else "=" + x for x in rows.column("collection").to_pylist()]), return_inverse=True)[1] if rows.num_rows else np.zeros(0, dtype=np.int64)
    order = _order(rows.column("id"))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def each(asked: np.ndarray, own: np.ndarray, d: np.ndarray, exact: Callable) -> None:
        for c in np.unique(kinds[own]).tolist():
            cols = np.flatnonzero(kinds[own] == c)
            near = d[:, cols]
            worst = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(near), np.inf)
            i, j = np.nonzero((near <= worst[:, None] * (1 + 1e-9) + 1e-9) & np.isfinite(near))
            true = exact(i, cols[j])
            j = own[cols[j]]
            sort = np.lexsort((order[j], true, i))
            i, j, true = i[sort], j[sort], true[sort]
            some = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((asked[i[some]], j[some], true[some]))

    if queries.num_rows and rows.num_rows:
        distances(queries, rows, each)
    none = np.zeros(0, dtype=np.int64)
    q, r, d = (np.concatenate([f[i] for f in found] or [none]) for i in range(3))
    return q, r, d


def _taken(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    q, r, d = _top(queries, rows, k)
    q, r = pa.array(q), pa.array(r)
    return pa.table({"query_id": queries.column("query_id").take(q), "collection": rows.column("collection").take(r), "id": rows.column("id").take(r), "dist": pa.array(d, pa.float64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "collection").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, collection, id, dist, rank): of each collection the k rows at the least squared distance, equal ones by id. Exact.

    queries (query_id, v) and corpus (id, collection, v) are compared in pairs of blocks, of which a task keeps the k best rows for each query and collection.
    """
    rows = corpus.select("id", F.col("collection").cast("string").alias("collection"), "v")
    kinds, of = dict(queries.dtypes), dict(rows.dtypes)
    found = _in_blocks(queries.select("query_id", "v"), rows, lambda q, r: _taken(q, r, k), f"query_id {kinds['query_id']}, collection string, id {of['id']}, dist double")
    return _best(found, k)


def _near(queries: pa.Table, rows: pa.Table, least: float, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the pairs within `least`; ordered: of one collection, and the row's seq smaller."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if ordered and queries.num_rows and rows.num_rows:
        before, after = rows.column("seq").to_numpy(), queries.column("seq").to_numpy()
        kinds = np.unique(np.array([x or "" for c in (queries, rows) for x in c.column("collection").to_pylist()]), return_inverse=True)[1]
        asked_kind, kind = kinds[: len(after)], kinds[len(after) :]

    def each(asked: np.ndarray, own: np.ndarray, d: np.ndarray, exact: Callable) -> None:
        close = d <= 1 - least
        if ordered:
            close &= (before[own][None, :] < after[asked][:, None]) & (kind[own][None, :] == asked_kind[asked][:, None])
        i, j = np.nonzero(close)
        s = 1 - exact(i, j)
        some = s >= least
        found.append((asked[i[some]], own[j[some]], s[some]))

    if queries.num_rows and rows.num_rows:
        distances(queries, rows, each)
    none = np.zeros(0, dtype=np.int64)
    q, r, s = (np.concatenate([f[i] for f in found] or [none]) for i in range(3))
    return q, r, s


def within(queries: DataFrame, corpus: DataFrame, least: float = 0.8, ordered: bool = False) -> DataFrame:
    """(query_id, id, similarity): all rows of corpus (id, v) with 1 - squared distance of at least `least` from a query (query_id, v), itself left out.

    ordered: both have seq and collection, and only rows of the query's collection with a smaller seq count. As many rows as there are
    hits: ask `hits` first where groups of near copies may be large.
    """
    kinds, of = dict(queries.dtypes), dict(corpus.dtypes)
    fields = ["v", *([F.col("seq").cast("long").alias("seq"), "collection"] if ordered else [])]

    def pairs(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, r, s = _near(queries, rows, least, ordered)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q)), "id": rows.column("id").take(pa.array(r)), "similarity": pa.array(s, pa.float64())})

    return _in_blocks(queries.select("query_id", *fields), corpus.select("id", *fields), pairs, f"query_id {kinds['query_id']}, id {of['id']}, similarity double")


def hits(queries: DataFrame, corpus: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, n, first, id, similarity): how many rows of corpus (id, v, seq, collection) are within `least` of each query (query_id, v, seq, collection)
    that has any, their least seq, and the nearest one; ordered as in within.

    One row a query, whatever the number of its hits. Of equally near rows the smallest id is taken.
    """
    kinds, of = dict(queries.dtypes), dict(corpus.dtypes)

    def told(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, r, s = _near(queries, rows, least, True)
        sort = np.lexsort((_order(rows.column("id"))[r], -s, q))
        q, r, s = q[sort], r[sort], s[sort]
        at = np.flatnonzero(np.diff(q, prepend=-1))
        n = np.diff(np.append(at, len(q)))
        first = np.minimum.reduceat(rows.column("seq").to_numpy()[r], at) if len(at) else np.zeros(0, dtype=np.int64)
        return pa.table({"query_id": queries.column("query_id").take(pa.array(q[at])), "n": pa.array(n, pa.int64()), "first": pa.array(first, pa.int64()), "id": rows.column("id").take(pa.array(r[at])), "similarity": pa.array(s[at], pa.float64())})

    fields = ["v", F.col("seq").cast("long").alias("seq"), "collection"]
    found = _in_blocks(queries.select("query_id", *fields), corpus.select("id", *fields), told, f"query_id {kinds['query_id']}, n long, first long, id {of['id']}, similarity double")
    best = F.min_by(F.struct("id", "similarity"), F.struct(-F.col("similarity"), F.col("id")))
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), best.alias("b")).select("query_id", "n", "first", "b.id", "b.similarity")


def rank_fused(hits: DataFrame, k: int = 6) -> DataFrame:
    """(…, score, pos): score = 1 / (1 + dist), 0.05 more for law and for an article; of equal first 200 characters the best stays; the best k of each query.

    hits has query_id, collection, dist, rank, id, text, article. Equal scores: law first, then the rank.
    """
    score = 1 / (1 + F.col("dist")) + F.when(F.col("collection") == "law", 0.05).otherwise(0.0) + F.when(F.coalesce("article", F.lit("")) != "", 0.05).otherwise(0.0)
    order = [F.desc("score"), F.when(F.col("collection") == "law", 0).otherwise(1), "rank"]
    rows = hits.withColumn("score", score).withColumn("key", F.substring(strip(F.col("text")), 1, 200))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order))).where("n = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= k).drop("n", "key")


def context(ranked: DataFrame) -> DataFrame:
    """(query_id, context): labelled blocks in order; at most k of a query."""
    tag = F.when(F.col("collection") == "law", F.concat(F.lit("[LUẬT"), F.when(F.col("article") != "", F.concat(F.lit(" - "), "article")).otherwise(""), F.lit("]"))).otherwise(F.concat(F.lit("[TÀI LIỆU"), F.when(F.col("issuer") != "", F.concat(F.lit(" - "), "issuer")).otherwise(""), F.lit("]")))
    source = F.when(F.col("source") != "", F.concat(F.lit("\n(Nguồn: "), F.substring("source", 1, 80), F.lit(")"))).otherwise("")
    block = F.concat(tag, F.lit("\n"), strip(F.col("text")), source)
    rows = ranked.select("query_id", F.struct("pos", block.alias("block")).alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return rows.select("query_id", F.array_join("b.block", "\n\n").alias("context"))


def retrieve_context(queries: DataFrame, index: DataFrame, embed: Callable[[Column], Column], n: int = 5, k: int = 6) -> DataFrame:
    """(query_id, context) of every row of queries (query_id, text): the n nearest chunks of each collection, fused to k, as labelled blocks; '' without any.

    index has the rows of index.records: id, collection, embedding, text, source, article, issuer. A null text is like an empty one. Of rows that
    share an id (or have none) the first text in order is asked, and each of them gets its context.
    """
    asked = queries.groupBy("query_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    hits = knn(asked.select("query_id", embed(F.col("text")).alias("v")), index.select("id", "collection", F.col("embedding").alias("v")), n)
    rows = hits.join(index.select("id", "text", "source", "issuer", F.coalesce("article", article_tag(F.col("text"))).alias("article")), "id")
    made = context(rank_fused(rows, k)).withColumnRenamed("query_id", "__query")
    return queries.select("query_id").join(made, F.col("query_id").eqNullSafe(F.col("__query")), "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))


def similar(queries: DataFrame, corpus: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, id, similarity): the nearest row of any collection where 1 - dist reaches `least`."""
    near = knn(queries, corpus.withColumn("collection", F.lit("")), 1)
    return near.select("query_id", "id", (1 - F.col("dist")).alias("similarity")).where(F.col("similarity") >= least)
