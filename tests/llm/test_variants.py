import random
import re
import zlib
from collections import Counter, defaultdict

from doclens.llm import variants

DOC = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{d}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if d is not None and h % 199 == 0 else r] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    around = {w: [v for k in (-1, 0, 1) for v in by[len(w) + k] if near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(around[w]), words[form[w]] if w in form else None))
    return sorted(out)


def run(spark, rows):
    return sorted(map(tuple, variants.variants(spark.createDataFrame(rows, DOC)).collect()))


def test_same_as_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcé", k=rnd.randint(6, 8))) for _ in range(60)]
    weight = [2 ** rnd.randint(0, 9) for _ in base]
    rows = [(i, " ".join(rnd.choices(base, weight, k=rnd.randint(0, 80)))) for i in range(400)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert any(r[1] for r in want) and any(r[4] for r in want)


def test_forms_are_followed_to_the_last(spark):
    rows = [(None, " ".join([w] * n)) for w, n in (("aaaaaaaa", 5), ("aaaaaaab", 25), ("aaaaaabb", 125), ("aaaaabbb", 625), ("aaaabbbb", 3125), ("aaabbbbb", 15625))]
    got = {r[0]: r for r in run(spark, rows)}
    assert {r[2] for r in got.values()} == {"aaabbbbb"}
    assert got["aaaaaaab"][1:] == ("aaaaaabb", "aaabbbbb", 25, 2, 125)


def test_ties_transpositions_and_repeated_letters(spark):
    words = {"kitten": 100, "kittten": 10, "kiten": 50, "mitten": 100, "ikttenx": 9, "bitten": 10, "kittne": 10, "Kitten": 7, "zitten": 107}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()]
    assert run(spark, rows) == brute(rows)
    got = {r[0]: r for r in run(spark, rows)}
    assert got["bitten"][1] == "kitten"  # 107 as zitten, and before it
    assert got["kittne"][4] == 0


def test_very_long_words_and_texts(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choices("abcdefgh", k=40_000))
    rows = [(None, " ".join([long] * 30 + [long[:7] + long[8:]] * 5 + ["a" * 2_000_000]))] + [(None, "x" * 500_000)] * 5
    got = run(spark, rows)
    assert [(len(w), f and len(f), n, k) for w, f, _, n, k, _ in got] == [(39_999, 40_000, 5, 1), (40_000, None, 30, 1), (500_000, None, 5, 0)]


def test_nulls_extra_columns_and_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, ""), (None, "rare words")]) == []
    df = spark.createDataFrame([(i, "Straße straße STRAßE × ÷ naïveté", i) for i in range(8)], DOC + ", word int")
    assert sorted(map(tuple, variants.variants(df).collect())) == brute([(i, "Straße straße STRAßE × ÷ naïveté") for i in range(8)])
    assert variants.spelt(None, "anything") == "anything"
