import datetime as dt
import random

from pyspark.sql import functions as F

from doclens.operators import asof

LEFT, RIGHT = "id int, k string, t timestamp", "n int, rk string, rt timestamp"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def brute(left, right, keyed):
    out = []
    for i, k, t in left:
        own = [r for r in right if t is not None and r[2] is not None and r[2] <= t and (not keyed or (k is not None and r[1] == k))]
        best = max(own, key=lambda r: (r[2], r[0]), default=(None, None, None))
        out.append((i, k, t, *best))
    return sorted(out, key=str)


def test_as_by_brute_force_with_a_hot_key_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(1)
        key = lambda: r.choice(["hot"] * 8 + ["a", "b", None, "rare"])
        left = [(i, key(), day(r.choice([None, *range(300)]))) for i in range(400)]
        right = [(i, key(), day(r.choice([None, *range(0, 300, 7)]))) for i in range(300)]
        a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
        for keyed in (True, False):
            got = asof.as_of(a, b, "t", "rt", {"k": "rk"} if keyed else None, ["n"])
            assert got.columns == ["id", "k", "t", "n", "rk", "rt"]
            assert sorted(map(tuple, got.collect()), key=str) == brute(left, right, keyed)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "a", day(1))], LEFT), spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in asof.as_of(a, b, "t", "rt", {"k": "rk"}).collect()] == [(1, "a", day(1), None, None, None)]
    assert asof.as_of(a.limit(0), b, "t", "rt").count() == 0


def test_intervals_as_by_brute_force(spark):
    r = random.Random(2)
    points = [(i, r.choice("ab"), r.choice([None, *range(-50, 400)])) for i in range(300)]
    spans = [(i, r.choice("ab"), s, s + r.choice([0, 1, 3, 30, 500])) for i, s in enumerate(r.choices(range(-60, 400), k=80))] + [(90, "a", None, 5), (91, "a", 5, None), (92, "b", 9, 3)]
    p, s = spark.createDataFrame(points, "id int, k string, at long"), spark.createDataFrame(spans, "n int, sk string, a long, b long")
    got = asof.in_intervals(p, s, F.col("at"), F.col("a"), F.col("b"), {"k": "sk"}).select("id", "n").collect()
    want = [(i, n) for i, k, t in points for n, sk, a, b in spans if k == sk and None not in (t, a, b) and a <= t < b]
    assert sorted(map(tuple, got)) == sorted(want)
    assert asof.in_intervals(p, s.limit(0), F.col("at"), F.col("a"), F.col("b")).count() == 0


def test_intervals_between_midnights_are_dealt_not_broadcast(spark):
    """Points around midnights, before and after 1970. The points' rows are many times what Spark expects: it would broadcast them."""
    day_, r = 86_400_000_000, random.Random(3)
    points = [(i, r.choice("ab"), r.randrange(-9, 9) * day_ + r.choice([-1, 0, 1, 5])) for i in range(200)]
    for off in (0, 7):
        spans = [(i, r.choice("abc"), s * day_, (s + r.choice([0, 1, 2, 9])) * day_ + off) for i, s in enumerate(r.choices(range(-9, 9), k=60))]
        p, s = spark.createDataFrame(points, "id int, k string, at long"), spark.createDataFrame(spans, "n int, sk string, a long, b long")
        df = asof.in_intervals(p, s, F.col("at"), F.col("a"), F.col("b"), {"k": "sk"})
        assert df.columns == ["id", "k", "at", "n", "sk", "a", "b"]
        want = [(i, n) for i, k, t in points for n, sk, a, b in spans if k == sk and a <= t < b]
        assert sorted(map(tuple, df.select("id", "n").collect())) == sorted(want)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
