import numpy as np

from doclens.llm import prefixes

VEC = "vec_id long, embedding array<float>"


def brute(rows, queries, k=20):
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    x = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if fine(v)]
    out = {}
    for i, v in queries:
        if fine(v):
            q = np.array(v, dtype=np.float32).astype(float)
            found = sorted((-float((q * c).sum()), j) for j, c in x if j != i and len(c) == len(q))
            out[i] = found[:k]
    return out


def run(spark, rows, queries, **named):
    got = {}
    for r in prefixes.search(spark.createDataFrame(rows, VEC), spark.createDataFrame(queries, VEC), **named).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return got


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in found}) for q, found in want.items()) / max(1, sum(map(len, want.values())))


def made(n, dim, seed, crowd=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, dim))
    x = base[rng.integers(0, 40, n)] + 0.35 * rng.standard_normal((n, dim))
    x[:crowd] = x[0] + 1e-4 * rng.standard_normal((crowd, dim))
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def test_recall_on_clusters_of_unequal_norms_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 200)
    rows = made(3000, 24, 1)
    rows = [(i, [x * (1 + i % 7) / 4 for x in v]) for i, v in rows]
    queries = rows[::20]
    want, got = brute(rows, queries), run(spark, rows, queries)
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        assert found == sorted(found) and len(found) == 20 and q not in {i for _, i in found}


def test_a_crowd_that_no_string_parts_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 100)
    rows = made(900, 16, 2, crowd=400)
    queries = rows[::20]
    assert recall(run(spark, rows, queries), brute(rows, queries)) >= 0.95


def test_small_tables_are_exact_with_ties_and_repeats(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(60)] + [(100, [2.0, 0.0, 0.0]), (101, [0.0, 1.0, 0.0]), (102, [-1.0, 0.0, 0.0]), (101, [0.0, 1.0, 0.0])]
    queries = [(0, one), (101, [0.0, 1.0, 0.0]), (500, [0.0, 0.0, 3.0])]
    got = run(spark, rows, queries)
    assert [i for _, i in got[0]] == [100, *range(1, 20)]
    assert got == {q: found[:20] for q, found in brute([*dict.fromkeys((i, tuple(v)) for i, v in rows)], queries).items()}


def test_nulls_lengths_extra_columns_and_empty(spark):
    assert prefixes.search(spark.createDataFrame([], VEC), spark.createDataFrame([], VEC)).count() == 0
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [3.0, 1.0]), (9, [1e-30, 1e-30]), (10, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], VEC + ", tree string, score double")
    got = {(r.query_id, r["rank"]): r.vec_id for r in prefixes.search(df, df).collect()}
    assert {q for q, _ in got} == {None, 1, 9, 10}  # 8 alone has its length
    assert [got[1, k] for k in (1, 2, 3)] == [10, None, 9]
    assert run(spark, rows[:1], rows[:1]) == {}


def test_cells_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 50)
    rows = spark.createDataFrame([(3, 0, [int(x) for x in np.random.default_rng(5).integers(-(2**63), 2**63, 2) >> np.int64(9 * (i % 2))]) for i in range(700)], "dim int, band int, h array<long>")
    cells = prefixes._cells(rows)
    steps = cells.agg({"step": "max"}).first()[0] + 1
    from pyspark.sql import functions as F

    flat = rows.select("dim", "band", F.posexplode("h").alias("tree", "s"))
    placed = prefixes._placed(flat, cells, steps)
    assert placed.count() == 1400
    bad = placed.groupBy("dim", "band", "tree", "depth", "prefix").agg(F.count("*").alias("c"), F.first("cell_n").alias("n")).where("c <> n")
    assert bad.isEmpty()
