"""Nearest vectors by inner product: a forest of hash prefixes.

Each tree gives every vector a long hash string, the signs of 64 random projections. The strings of a tree are kept as sorted arrays, cut
into cells: variable-length prefixes with BLOCK rows at most. A query goes down to the cell of its own longest prefix, then up in all trees
together to a prefix so short that its nearest rows share it in some tree with probability `recall`; all rows with that prefix are compared.

How far up follows from what was found below: rows at a cosine c share x signs with probability (1 - acos(c) / pi)^x in one tree, and the
least of the k nearest found so far bounds c. So the work depends on how near the neighbours are, not on a number of candidates: close
neighbours are found within a cell; of vectors that are all nearly at right angles, most have to be compared, as with any index.

Inner products become cosines by one more component (Neyshabur and Srebro, 2015): rows are scaled to the largest norm M and filled up to length 1.
Rows of much smaller norms get trees of their own, with a smaller M (bands), which a query skips if none of their products can be as large.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.common import id_of, key_of, written

TREES, BITS = 10, 64
#: Trees whose cells tell how near the neighbours are; rows of a cell and queries of a task at most; bands of norms, each half of the last.
SCOUTS, BLOCK, BANDS = 3, 4096, 9
_STEP = 8
_SPACE = ["dim", "band", "tree"]
_CELL = [*_SPACE, "depth", "prefix"]


@lru_cache(64)
def _directions(dim: int, trees: int) -> np.ndarray:
    """The directions of all trees, one more component than the vectors have."""
    return np.random.default_rng([12, dim]).standard_normal((trees * BITS, dim + 1))


def strings(x: np.ndarray, trees: int) -> np.ndarray:
    """The hash strings of rows of one length (with the added component), a column for each tree."""
    bits = (x @ _directions(x.shape[1] - 1, trees).T > 0).reshape(len(x), trees, BITS)
    return np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def _prefix(h: Column, bits: Column) -> Column:
    return F.when(bits > 0, F.call_function("shiftrightunsigned", h, F.lit(BITS) - bits)).otherwise(F.lit(0).cast("long"))


def _hashed(df: DataFrame, trees: int, top: bool) -> DataFrame:
    """df with h, the strings of v; of rows (top: scaled to `m`) or of queries (whose added component is 0)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("h", ArrayType(LongType()))])
    kind = to_arrow_type(schema["h"].dataType)

    def run(batches):
        for batch in batches:
            v, n = batch.column("v"), batch.num_rows
            sizes = v.value_lengths().to_numpy()
            out = np.zeros((n, trees), dtype=np.uint64)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
                m = batch.column("m").to_numpy()[own][:, None] if top else np.abs(x).max(axis=1, keepdims=True)
                x = x / m
                rest = np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True))) if top else np.zeros((len(own), 1))
                out[own] = strings(np.hstack((x, rest)), trees)
            made = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * trees), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(kind)], names=[*batch.schema.names, "h"])

    return df.mapInArrow(run, schema)


def _cells(rows: DataFrame) -> DataFrame:
    """(dim, band, tree, step, pre, depth, n): to which cell the strings go whose first 8 (step + 1) bits are pre: its depth, and how many rows it has.

    Counts of prefixes are taken by rounds of 8 bits; as many neighbouring prefixes are one cell as have BLOCK rows at most together. Prefixes of all
    64 bits stay whole, whatever their number. Empty prefixes have a cell too, so that every query finds one.
    """
    open_, out, step = None, None, 0
    flat = rows.select("dim", "band", F.posexplode("h").alias("tree", "s"))
    while True:
        bits = F.lit(_STEP * (step + 1))
        some = flat.select(*_SPACE, _prefix(F.col("s"), bits).alias("pre"), _prefix(F.col("s"), bits - _STEP).alias("parent"))
        if open_ is not None:
            some = some.join(open_.select(*_SPACE, F.col("pre").alias("parent")), [*_SPACE, "parent"], "left_semi")
        counts = some.groupBy(*_SPACE, "parent", "pre").agg(F.count("*").alias("n")).withColumn("step", F.lit(step))

        def cut(group: pd.DataFrame) -> pd.DataFrame:
            step = int(group["step"].iloc[0])
            n = np.zeros(1 << _STEP, dtype=np.int64)
            n[group["pre"].to_numpy() & 255] = group["n"].to_numpy()
            depth, size, todo = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int64), [(0, 256, 0)]
            while todo:
                a, b, d = todo.pop()
                total = n[a:b].sum()
                if total <= BLOCK or d == _STEP:
                    depth[a:b], size[a:b] = _STEP * step + d, total
                else:
                    todo += [(a, (a + b) // 2, d + 1), ((a + b) // 2, b, d + 1)]
            dim, band, tree, parent = group[[*_SPACE, "parent"]].iloc[0]
            ends = (np.uint64(parent) << np.uint64(_STEP) | np.arange(256, dtype=np.uint64)).view(np.int64)
            return pd.DataFrame({"dim": dim, "band": band, "tree": tree, "step": step, "pre": ends, "depth": depth, "n": size})

        made = written(counts.groupBy(*_SPACE, "parent").applyInPandas(cut, "dim int, band int, tree int, step int, pre long, depth int, n long"), "cells")
        full = (F.col("n") > BLOCK) & (F.col("depth") == bits) & (F.col("depth") < BITS)
        closed = made.where(~full)
        out = closed if out is None else out.union(closed)
        open_ = made.where(full).select(*_SPACE, "pre").distinct()
        step += 1
        if open_.isEmpty():
            return written(out, "prefixes")


def _placed(df: DataFrame, cells: DataFrame, steps: int) -> DataFrame:
    """df (dim, band, tree, s, …) with the depth and prefix of the cell of s, and its number of rows, cell_n."""
    at = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("pre", _prefix(F.col("s"), (F.col("step") + 1) * _STEP))
    known = cells.select(*_SPACE, "step", "pre", "depth", F.col("n").alias("cell_n"))
    return at.join(known, [*_SPACE, "step", "pre"]).drop("step", "pre").withColumn("prefix", _prefix(F.col("s"), F.col("depth")))


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: list, k: int) -> list[tuple[int, int, float]]:
    """(query, id, product): of each query the k rows of largest product, ties to smaller ids; rows have several ids, its own one does not count."""
    out = []
    approx = q @ x.T
    slack = 1e-12 * np.linalg.norm(q, axis=1) * (np.linalg.norm(x, axis=1).max() if len(x) else 0.0)
    for i in range(len(q)):
        near = approx[i]
        if len(near) > k + 1:
            least = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
            rows = np.flatnonzero(near >= least - slack[i])
        else:
            rows = np.arange(len(near))
        score = (x[rows] * q[i]).sum(axis=1)
        found = sorted((-s, int(e)) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for e in ids[r] if e != own[i])
        out += [(i, e, -s) for s, e in found[:k]]
    return out


def _scanned(routes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, owner, id, score): the k best rows of each route's cell; routes (cell, query, owner, q, s, x): of the rows with the first x bits of s alone.

    A cell's rows and routes are dealt to blocks, so a task's share of either is bounded.
    """
    counts = written(routes.groupBy(*_CELL).agg(F.count("*").alias("asked")), "asked")
    blocks, parts = F.ceil(F.col("cell_n") / BLOCK).cast("int"), F.ceil(F.col("asked") / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    left = routes.join(counts, _CELL).withColumn("part", F.pmod(F.xxhash64("query"), parts).cast("int")).withColumn("block", every(blocks))
    right = rows.join(counts, _CELL).withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.greatest(blocks, F.lit(1))).cast("int")).withColumn("part", every(parts))
    by = [*_CELL, "block", "part"]

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "owner": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if asked.empty or held.empty:
            return none
        h = held["s"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        h, ids = h[order], [held["ids"].iloc[i] for i in order.tolist()]
        x = np.stack(held["v"].to_numpy()).astype(np.float64)[order]
        q = np.stack(asked["q"].to_numpy()).astype(np.float64)
        own, name, s, bits = asked["owner"].to_numpy(), asked["query"].to_numpy(), asked["s"].to_numpy().view(np.uint64), asked["x"].to_numpy()
        bits = np.where(bits <= asked["depth"].to_numpy(), 0, bits)
        # The rows that share `bits` signs with the query are neighbours in the sorted array.
        shift = (BITS - np.maximum(bits, 1)).astype(np.uint64)
        low = (s >> shift) << shift
        high = low | ((np.uint64(1) << shift) - np.uint64(1))
        a, b = np.where(bits > 0, np.searchsorted(h, low), 0), np.where(bits > 0, np.searchsorted(h, high, side="right"), len(h))
        found = []
        ranges, group = np.unique(np.stack((a, b), axis=1), axis=0, return_inverse=True)
        for g, (lo, hi) in enumerate(ranges.tolist()):
            mine = np.flatnonzero(group.ravel() == g)
            for at in range(0, len(mine), 512):
                some = mine[at : at + 512]
                found += [(some[i], e, score) for i, e, score in best(q[some], own[some], x[lo:hi], ids[lo:hi], k)] if hi > lo else []
        if not found:
            return none
        i, e, score = zip(*found, strict=True)
        i = np.array(i)
        return pd.DataFrame({"query": name[i], "owner": own[i], "id": np.array(e, dtype=np.int64), "score": np.array(score)})

    left = left.select(*by, "query", "owner", "q", "s", "x")
    right = right.select(*by, "s", "v", "ids").toDF(*by, "s", "v", "ids")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(scan, "query long, owner long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query", "owner", "id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _good(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """key, v, dim, norm of the vectors that take part."""
    rows = df.select(key_of(id_col).alias("key"), F.col(vector_col).alias("v"))
    inf = F.lit(float("inf"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    rows = rows.withColumn("most", most).withColumn("dim", F.size("v"))
    norm = F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most"))))
    return rows.withColumn("norm", norm).drop("most")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, recall: float = 0.93) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of queries the k rows of vectors of largest inner product, in double precision, ties to smaller ids.

    Rows of the query's own id are left out. Vectors that are null, empty, zero or have a null or non-finite component take no part, nor do
    those of another length than the query's. A null id comes out null and is smaller than any other. Rows of queries that repeat an id with
    another vector are queries of their own; full repeats are one. Without rows, or with fewer than k, there are as many as are found. Other columns aren't read.

    Equal vectors are one row with its k + 1 smallest ids: no more of them can be among the k nearest. `recall` is the least expected share of the k
    nearest that are found. Cells of rows that all 64 projections leave together are compared in blocks, whole.
    """
    rows = _good(vectors, id_col, vector_col)
    hashes = {"rep": F.xxhash64("v"), "mark": F.xxhash64(F.lit(1), "v")}
    few = rows.withColumns(hashes).withColumn("n", F.row_number().over(Window.partitionBy("rep", "mark").orderBy("key"))).where(F.col("n") <= k + 1)
    classes = few.groupBy("rep", "mark").agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.sort_array(F.collect_list("key")).alias("ids"))
    classes = written(classes.drop("rep", "mark"), "classes")
    tops = classes.groupBy("dim").agg(F.max("norm").alias("largest"))
    band = F.least(F.floor(F.log2(F.col("largest") / F.col("norm"))).cast("int"), F.lit(BANDS - 1))
    scaled = classes.join(tops, "dim").withColumn("band", F.greatest(band, F.lit(0))).withColumn("m", F.col("largest") * F.pow(F.lit(0.5), F.col("band"))).drop("largest")
    hashed = written(_hashed(scaled.select("dim", "band", "m", "ids", "v"), trees, True), "hashed")

    asked = _good(queries, id_col, vector_col)
    asked = asked.groupBy(F.xxhash64("key", "v").alias("query"), F.col("key").alias("owner")).agg(F.first("v").alias("v"), F.first("dim").alias("dim"), F.first("norm").alias("norm"))
    asked = written(_hashed(asked, trees, False), "queries")

    cells = _cells(hashed)
    steps = (cells.agg(F.max("step")).first()[0] or 0) + 1
    flat = hashed.select("dim", "band", F.posexplode("h").alias("tree", "s"), "v", "ids")
    held = _placed(flat, cells, steps)
    spaces = hashed.groupBy("dim", "band").agg(F.max("m").alias("m"))
    routes = asked.join(spaces, "dim").select("dim", "band", "m", "norm", "query", "owner", F.posexplode("h").alias("tree", "s"), F.col("v").alias("q"))
    scouts = _placed(routes.where(F.col("tree") < SCOUTS), cells, steps).withColumn("x", F.lit(0))
    first = written(_ranked(_scanned(scouts, held.where(F.col("tree") < SCOUTS), k), k), "scouted")

    # How many signs rows as near as the k-th one found have in common, with the wanted probability, in one of the trees at least.
    least = first.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    share = math.log(1 - (1 - recall) ** (1 / trees))
    cosine = F.col("least") / (F.col("norm") * F.col("m"))
    alike = 1 - F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) / math.pi
    x = F.when(F.col("least").isNull() | (alike <= 0), 0).when(alike >= 1, BITS).otherwise(F.least(F.floor(F.lit(share) / F.ln(alike)), F.lit(BITS))).cast("int")
    wide = routes.join(least, "query", "left").where(F.coalesce(cosine <= 1 + 1e-9, F.lit(True))).withColumn("x", x).drop("least")
    own = _placed(wide, cells, steps).drop("cell_n").withColumnsRenamed({"depth": "own_depth", "prefix": "own"})
    own = own.withColumn("up", F.least("x", "own_depth")).withColumn("shared", _prefix(F.col("s"), F.col("up")))
    every = cells.select(*_SPACE, "depth", "n", _prefix(F.col("pre"), F.col("depth") + BITS - _STEP * (F.col("step") + 1)).alias("prefix")).distinct()
    above = every.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("shared", _prefix(F.col("prefix"), F.col("up") + BITS - F.col("depth")))
    onward = own.join(above, [*_SPACE, "up", "shared"]).where((F.col("n") > 0) & ((F.col("tree") >= SCOUTS) | (F.col("depth") != F.col("own_depth")) | (F.col("prefix") != F.col("own"))))
    second = _scanned(onward.withColumnRenamed("n", "cell_n"), held, k)
    out = _ranked(first.select("query", "owner", "id", "score").union(second), k)
    return out.select(id_of("owner").alias("query_id"), "rank", id_of("id").alias("vec_id"), "score")
