import hashlib
import random

from doclens.llm import common, suffixes

DOC = "doc_id long, text string"


def brute(rows, length=100):
    first, out = {}, []
    raws = [(d if d is not None else -(2**63), (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            first[w] = min(first.get(w, (d, i)), (d, i))
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    some = [" ".join(word() for _ in range(rnd.randint(15, 60))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 99), (4, "a" * 100), (5, "a" * 350), (6, "xy" * 130), (7, "z" + "a" * 120), (8, "ab" * 70)]
    for d in range(9, 80):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            p = rnd.choice(some) if rnd.random() < 0.6 else " ".join(word() for _ in range(rnd.randint(1, 90)))
            a, b = sorted(rnd.sample(range(len(p) + 1), 2)) if rnd.random() < 0.4 and len(p) > 1 else (0, len(p))
            p = p[a:b]
            if rnd.random() < 0.3 and len(p) > 5:
                k = rnd.randrange(len(p))
                p = p[:k] + "Q" + p[k + 1 :]
            parts.append(p)
        rows.append((d, "".join(parts)))
    rows.append((80, rows[20][1]))
    rnd.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = suffixes.digest(spark.createDataFrame(rows, DOC).repartition(6))
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_hot_digits_are_joined_in_shares(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(common, "HOT", 2)
    rows = corpus(7)
    got = suffixes.digest(spark.createDataFrame(rows, DOC).repartition(6))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_other_lengths(spark):
    rows = corpus(3)
    for length in (32, 45, 128):
        got = suffixes.digest(spark.createDataFrame(rows, DOC), length=length)
        assert sorted(map(tuple, got.collect())) == brute(rows, length)


def test_nulls_repeats_extra_columns_and_empty(spark):
    assert suffixes.digest(spark.createDataFrame([], DOC)).count() == 0
    text = "".join(random.Random(4).choices("abcdefgh", k=300))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (5, text[:150], 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.digest(df).collect()}
    assert got == {(None, 300): 0, (5, 300): 300, (5, 150): 150, (9, 0): 0}
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    assert sorted((r.spans, r.text) for r in out.collect() if r.spans != 5) == [(1, text), (2, ""), (3, ""), (4, "")]
    assert out.where("spans = 5").first().text is None


def test_cut_text_keeps_whole_characters(spark):
    text = "éàüö" * 1 + "é" * 76 + "".join(random.Random(6).choices("abc", k=40))
    df = spark.createDataFrame([(1, text), (2, "a" + text + "tail")], DOC)
    assert {r.doc_id: r.text for r in suffixes.without_repeats(df).collect()}[2] == "atail"


def test_a_very_long_text(spark):
    rnd = random.Random(8)
    once = "".join(rnd.choices("abcdefghijklmnop", k=1_500_000))
    rows = [(1, once), (2, "x" + once[700_000:700_400] + "y"), (3, once[:150] + "z" * 99)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digest(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: (1_500_000, 0, 0), 2: (402, 400, 1), 3: (249, 150, 1)}


def test_rows_without_an_id_are_told_apart_by_64_bits(spark):
    """Two texts of one 32-bit hash, of rows without an id: nothing is taken from the one that repeats nothing."""
    from pyspark.sql import functions as F

    half = lambda k: F.concat(F.sha2(F.concat(F.col("id").cast("string"), F.lit(k)), 256), F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(k + "y")), 256), 1, 46))
    made = spark.range(600_000).select(F.concat(half("a"), F.when(F.col("id") % 2 == 0, half("a")).otherwise(half("b"))).alias("text"), (F.col("id") % 2 == 0).alias("twice"))
    pairs = made.groupBy(F.hash("text").alias("h")).agg(F.min(F.when(F.col("twice"), F.col("text"))).alias("a"), F.min(F.when(~F.col("twice"), F.col("text"))).alias("b"))
    pair = pairs.where("a is not null and b is not null").orderBy("h").first()
    got = suffixes.digest(spark.createDataFrame([(None, pair.a), (None, pair.b)], DOC)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {r.kept_sha256: r.n_removed for r in got} == {digest(pair.a[:110]): 110, digest(pair.b): 0}
