from pyspark.sql import functions as F

from doclens.operators import sketches

SF = "/root/testdata/sf0.01"


def test_rollups_are_within_their_bounds_and_merge_over_generations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.length("text"))
    halves = [sketches.made(docs.where(f"doc_id % 2 = {k}"), ["lang", "source"], "text", "size", "source") for k in (0, 1)]
    merged = sketches.told(sketches.rollup(halves[0].union(halves[1]), ["lang", "source"]))
    got = {(r.level, r.lang, r.source): r for r in merged.collect()}
    exact = docs.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.countDistinct("text").alias("d"), F.sort_array(F.collect_list("size")).alias("sizes")).collect()
    assert len(got) == len(exact)
    for e in exact:
        r = got[e.level, e.lang, e.source]
        assert r.n == e.n and abs(r["distinct"] - e.d) <= max(2, 0.06 * e.d)
        for rank, q in zip((0.5, 0.9, 0.99), r["quantiles"], strict=True):
            low, high = sum(s < q for s in e.sizes) / e.n, sum(s <= q for s in e.sizes) / e.n
            assert low - 0.03 <= rank <= high + 0.03
    counts = {r.source: r["count"] for r in docs.groupBy("source").count().collect() if r.source is not None}
    top = {x["item"]: x["count"] for x in got[3, None, None]["frequent"]}
    assert top and all(counts[k] == c for k, c in top.items()) and min(top.values()) >= sorted(counts.values())[-5]


def test_empty_groups_and_nulls(spark):
    df = spark.createDataFrame([("a", None, None, None), ("a", "x", 3, "i")], "g string, t string, n int, f string")
    r = sketches.told(sketches.rollup(sketches.made(df, ["g"], "t", "n", "f"), ["g"])).where("g = 'a'").first()
    assert r.n == 2 and r["distinct"] == 1 and r["quantiles"] == [3.0, 3.0, 3.0]
    assert sketches.made(df.limit(0), ["g"], "t", "n", "f").count() == 0
