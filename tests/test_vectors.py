import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclens.operators import retrieval, vectors


def rows(spark, n=2000, dim=16, clusters=30, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.3 * rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "id long, collection string, v array<double>")


def pairs(df):
    return {(r.query_id, r.collection, r.id): round(r.dist, 9) for r in df.collect()}


def test_cells_find_most_and_all_cells_find_all(spark, tmp_path):
    df, path = rows(spark), str(tmp_path / "v")
    vectors.build(df, path, 25)
    found = vectors.Index(spark, path)
    queries = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    want = pairs(retrieval.knn(queries, df, 5))
    some = pairs(found.knn(queries, 5, probes=6))
    assert len(want) == 1000 and len(some) == 1000
    assert len(some.keys() & want.keys()) >= 0.95 * len(want)
    assert pairs(found.knn(queries, 5, probes=25)) == want


def test_only_asked_cells_are_read(spark, tmp_path):
    df, path = rows(spark), str(tmp_path / "v")
    vectors.build(df, path, 25)
    found = vectors.Index(spark, path)
    one = df.where("id = 3").select(F.col("id").alias("query_id"), "v")
    near = found.knn(one, 5, probes=2)
    plan = near._jdf.queryExecution().explainString(near.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if line.startswith("PartitionFilters") and "cell" in line]
    assert scans and all(re.search(r"cell#\d+ IN \(\d+,\d+\)", line) for line in scans), scans
    assert near.count() == 10


def test_a_search_keeps_its_build_and_odd_vectors_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    path = str(tmp_path / "v")
    schema = "id long, collection string, v array<double>"
    odd = [(9001, "a", None), (9002, "a", [float("nan")] * 16), (9003, "a", []), (9004, "a", [1.0, 2.0])]
    df = rows(spark, 400).union(spark.createDataFrame(odd, schema))
    vectors.build(df, path)
    found = vectors.Index(spark, path)
    vectors.build(spark.createDataFrame([(1, "a", [1.0])], schema), path)
    assert vectors.Index(spark, path).rows.count() == 1
    queries = df.where("id % 20 = 0 or id > 9000").select(F.col("id").alias("query_id"), "v")
    assert pairs(found.knn(queries, 3, probes=100)) == pairs(retrieval.knn(queries, df, 3))
    with pytest.raises(ValueError):
        vectors.Index(spark, str(tmp_path / "none"))
