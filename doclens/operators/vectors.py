"""A vector index on disk: rows by collection and coarse cell, so that a search reads the cells near its queries and no others.

The cells are those of k-means centres that are learned from a bounded sample; every row is written to the cell of its nearest centre, whatever the sample. Queries
stay a table: each is dealt to its `probes` nearest cells, and in these it is compared with all rows, in pairs of blocks. The more cells are asked, the more
of the true neighbours are found; `retrieval.knn` finds all of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators import generations, retrieval
from doclens.operators.greedy import kept

#: Rows that the centres are learned from, centres at most (their table is given to every task: at 1024 components it has 32 MB), and rounds of learning.
SAMPLE, CELLS, ROUNDS = 32_768, 4096, 12


def _centres(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """k-means from rows drawn at random; a centre that no row is nearest to moves to a row drawn anew."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    at = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        near = nearest(x, at, 1)[:, 0]
        size = np.bincount(near, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        at = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), len(at))])
    return at


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, the nearest first."""
    squares, out, k = (centres * centres).sum(axis=1), [], min(k, len(centres))
    for a in range(0, len(x), 1024):
        d = squares[None, :] - 2 * (x[a : a + 1024] @ centres.T)
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def _cells(v: Column, centres: dict[int, np.ndarray], k: int) -> Column:
    """array<int>: of a vector its k nearest cells; those of an unknown length have cell 0."""

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        out: list = [[0]] * len(v)
        sizes = v.map(len).to_numpy()
        for n in set(sizes.tolist()) & set(centres):
            own = np.flatnonzero(sizes == n)
            for i, c in zip(own.tolist(), nearest(np.stack(v.iloc[own].to_list()), centres[n], k).tolist(), strict=True):
                out[i] = c
        return pd.Series(out)

    return cells(v)


def build(rows: DataFrame, path: str, cells: int | None = None) -> str:
    """Writes rows (id, collection, v, …) as a new generation of the vector index at path, in place of what was there, and gives its name.

    cells are the number of centres for vectors of one length, at most CELLS; by default one for about every 1000 rows. They are learned from about SAMPLE rows whose
    hashed vector is low, the same in every run. Vectors that can't be compared are left out.
    """
    spark, good = rows.sparkSession, kept(rows.where(retrieval.comparable(F.col("v"))).withColumn("v", F.col("v").cast("array<double>")))
    counts = {r.dim: r.n for r in good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(16).collect()}
    level = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    centres = {}
    for dim, n in counts.items():
        some = good.where((F.size("v") == dim) & (level <= F.lit(int(min(1.0, SAMPLE / n) * (1 << 30))))).select("v").toArrow()
        x = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        centres[dim] = _centres(x, min(cells or -(-n // 1000), CELLS)) if len(x) else np.zeros((1, dim))
    name = uuid.uuid4().hex
    placed = good.withColumn("cell", _cells(F.col("v"), centres, 1)[0])
    placed.repartition("collection", "cell").write.partitionBy("collection", "cell").parquet(f"{path.rstrip('/')}/rows/{name}")
    told = spark.createDataFrame([(dim, k, c.tolist()) for dim, x in centres.items() for k, c in enumerate(x)], "dim int, cell int, v array<double>")
    told.coalesce(1).write.parquet(f"{path.rstrip('/')}/centres/{name}")
    generations.commit(spark, path, lambda last: generations.Generation(0, frozenset({(name, str(good.count()))}), last.batches))
    return name


class Index:
    """What is at a path now: its rows and centres. Later builds don't change it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        found = generations.load(spark, path).folders
        if not found:
            raise ValueError(f"no vector index in {path}")
        self.name = next(iter(found))[0]
        self.rows = spark.read.parquet(f"{path.rstrip('/')}/rows/{self.name}")
        by_dim: dict[int, list] = {}
        for r in spark.read.parquet(f"{path.rstrip('/')}/centres/{self.name}").orderBy("dim", "cell").toLocalIterator():
            by_dim.setdefault(r.dim, []).append(r.v)
        self.centres = {dim: np.array(x) for dim, x in by_dim.items()}

    def knn(self, queries: DataFrame, k: int = 5, probes: int = 8) -> DataFrame:
        """(query_id, collection, id, dist, rank) as retrieval.knn gives them, of the rows in the `probes` nearest cells of each query (query_id, v).

        Partitions of cells that no query asks are not read. A cell's queries and rows are dealt to blocks, so a popular cell spreads.
        """
        kinds, of = dict(queries.dtypes), dict(self.rows.dtypes)
        good = queries.where(retrieval.comparable(F.col("v"))).select("query_id", F.col("v").cast("array<double>").alias("v"))
        asked = kept(good.withColumn("cell", F.explode(_cells(F.col("v"), self.centres, probes))))
        sizes = kept(asked.groupBy("cell").agg(F.count("*").alias("queries")))
        # The numbers of cells, CELLS at most, are what the scan's partition filter needs.
        rows = self.rows.where(F.col("cell").isin([r.cell for r in sizes.select("cell").collect()]))
        counts = rows.groupBy("cell").agg(F.count("*").alias("rows"))
        blocks = kept(sizes.join(counts, "cell").select("cell", F.ceil(F.col("queries") / retrieval.QUERY_BLOCK).cast("int").alias("q"), F.ceil(F.col("rows") / retrieval.ROW_BLOCK).cast("int").alias("r")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(F.broadcast(blocks), "cell").withColumn("__q", F.pmod(F.xxhash64("query_id", "v"), F.col("q")).cast("int")).withColumn("__r", every("r"))
        right = rows.join(F.broadcast(blocks), "cell").withColumn("__r", F.pmod(F.xxhash64("id", "v"), F.col("r")).cast("int")).withColumn("__q", every("q"))
        by = ["cell", "__q", "__r"]
        left = left.select(*by, "query_id", "v").toDF(*by, "query_id", "v")
        right = right.select(*by, "id", F.col("collection").cast("string").alias("collection"), "v").toDF(*by, "id", "collection", "v")
        schema = f"query_id {kinds['query_id']}, collection string, id {of['id']}, dist double"
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda q, r: retrieval._taken(q, r, k), schema)
        return retrieval._best(found, k)
