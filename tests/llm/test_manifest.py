import hashlib
import random
import zlib

import duckdb
import pyarrow as pa

from doclens.llm import manifest

DOC = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def say(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def small(t):
    return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        a = k // 8 * 8
        out.append((level[a:k], level[k + 1 : a + 8]))
        k //= 8
    return out


def brute(rows):
    by = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(map(say, r)), h(map(say, (*r[:4], small(r[4])))) if hit else None))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x], key=lambda r: r[:3])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for k, (known, d, leaf, tampered) in enumerate(sorted(by[x], key=lambda r: r[:3])):
            steps, f = path(trees[x], k) + path(top, i), tampered or leaf
            for before, after in steps:
                f = h([*before, f, *after])
            out.append((d if known else None, leaf, trees[x][-1][0], top[-1][0], h([s for a, b in steps for s in a + b]), f, f == top[-1][0]))
    return order(out)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def corpus(n, langs, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", None]), rnd.choice(langs), rnd.choice([5, None]), rnd.choice(["Ab é", "low", "", None, "X" * 50])) for i in range(n)]


def test_same_as_brute_force_over_segments_and_short_runs(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SEGMENT", 21)
    for n, langs in ((700, ["en", "de", "", None, "é"]), (65, ["en"]), (1, [None])):
        rows = corpus(n, langs)
        assert order(map(tuple, manifest.digests(spark.createDataFrame(rows, DOC)).collect())) == brute(rows)


def test_many_groups_and_one_hot_one(spark):
    rows = [(i, None, f"l{i % 90}" if i % 3 else "hot", i, "T") for i in range(600)]
    assert order(map(tuple, manifest.digests(spark.createDataFrame(rows, DOC)).collect())) == brute(rows)


def test_nulls_repeats_extra_columns_and_empty(spark):
    assert manifest.digests(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (4, "s", "en", 1, "Z"), (4, "s", "en", 1, "Z"), (4, "s", "en", 1, "Y"), (7, None, None, None, "long " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], DOC + ", tree string, part int")
    assert order(map(tuple, manifest.digests(df).collect())) == brute(rows)


def test_sql_gives_the_same(spark):
    rows = corpus(300, ["en", "de", None])
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows]))
    assert order(con.execute(manifest.sql()).fetchall()) == brute(rows)


def test_a_range_completes_what_it_holds(spark):
    leaves = [h([str(i)]) for i in range(100)]
    levels = tree(leaves)
    for a, b in ((0, 100), (3, 77), (64, 100), (9, 15)):
        r = manifest.Range(a, 100)
        for d in leaves[a:b]:
            r.push(d)
        r.end()
        assert all(levels[level][k] == d for level, k, d in r.made + r.edges)
        assert len(r.edges) <= 14 * len(levels)
