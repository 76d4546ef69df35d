import random

import numpy as np
import xxhash

from doclens.llm import simhash

DOC = "doc_id long, text string"


def plain(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [(0, None), (1, ""), (2, "One"), (3, "one two\tTHREE"), (4, " \n"), (5, "é À one two three four five")], 6
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 400))]
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = "x"
            rows.append((n, " ".join(copy)))
            n += 1
    rnd.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark):
    rows = corpus()
    got = simhash.groups(spark.createDataFrame(rows, DOC).repartition(5))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(20)]
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")

    def parts(links):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links.collect():
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    truth = spark.createDataFrame([(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 4], "a long, b long")
    assert parts(simhash.links(df)) == parts(truth) == parts(simhash.links(df, split=3))


def test_empty_table_extra_columns_nulls_and_repeats(spark):
    assert simhash.groups(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 2), (4, "q r s t u v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.groups(df).collect()), key=str)
    assert got == [(3, None), (3, None), (4, 4), (None, None)]
    kept = simhash.representatives(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None"]


def test_fingerprint_of_a_long_text_is_summed_in_pieces():
    text = " ".join(f"w{i}" for i in range(9000))
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == plain(text)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    say = lambda seed: " ".join(f"w{random.Random(seed * 1000 + i).randrange(9000)}" for i in range(60))
    rows = [(None, say(1)), (None, say(2)), (None, say(2)), (None, say(3).upper()), (5, say(3)), (6, say(4)), (6, say(1)), (6, say(6)), (7, say(4)), (8, None), (8, "")]
    kept = simhash.representatives(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    texts = sorted((str(r.doc_id), r.text) for r in kept if r.doc_id != 8)
    assert texts == sorted([("None", say(1)), ("None", say(2)), ("None", say(3).upper()), ("6", say(4)), ("6", say(6))])
    assert len(kept) == 6
