import random

import numpy as np
import pytest

from doclens.llm import hashed, langid, quality, toxicity

DOC = "doc_id long, text string, lang string"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def corpus(seed=0, n=900):
    rnd = random.Random(seed)
    plain = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        words = rnd.choices(plain, k=rnd.randint(15, 80))
        insult, group = rnd.random() < 0.35, rnd.random() < 0.5
        words += ["blockhead"] * insult + ["foreigners"] * group
        rnd.shuffle(words)
        junk = rnd.random() < 0.3
        docs.append((i, " ".join(w + "***" * junk for w in words), "en"))
        labels.append((i, int(not junk), int(insult and group)))
    return docs, labels


def test_pairs_of_words_are_learned():
    docs, labels = corpus()
    find = hashed.Terms(hashed.words_and_stems)
    rows, y = [find(t) for _, t, _ in docs], np.array([t for _, _, t in labels])
    found = hashed.of_rows(rows[:600], y[:600], np.ones(600), toxicity.pick)
    model = toxicity.fit(found, rounds=60)
    columns = [model.columns[r][model.columns[r] >= 0] for r in rows[600:]]
    assert auc(y[600:], model.logits(columns)) > 0.97


def test_words_that_tell_only_together_are_learned():
    """Label 1 is both words or neither: each alone tells nothing, so no sum of weights can say it."""
    rnd = random.Random(4)
    plain = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    texts, y = [], []
    for _ in range(4000):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join([*rnd.choices(plain, k=rnd.randint(5, 60)), *["stranger"] * a, *["vermin"] * b]))
        y.append(int(a == b))
    find, y = hashed.Terms(hashed.words_and_stems), np.array(y)
    rows = [find(t) for t in texts]
    model = toxicity.fit(hashed.of_rows(rows[:3000], y[:3000], np.ones(3000), toxicity.pick))
    got = model.logits([model.columns[r][model.columns[r] >= 0] for r in rows[3000:]]) > 0
    assert (got == (y[3000:] == 1)).mean() >= 0.95


def test_toxic_recall_on_held_out_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in toxicity.predict(docs, labels).where("held_out").collect() if truth.get(r.doc_id) is not None]
    toxic = [p for t, p in held if t == 1]
    clean = [p for t, p in held if t == 0]
    assert len(toxic) > 100 and np.mean(toxic) > 0.87 and np.mean(clean) < 0.005


def test_quality_on_held_out_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("quality is not null").cache()
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 5 = 0").collect()}
    rated = quality.rate(docs, quality.learn(docs, labels.where("doc_id % 5 <> 0"))).collect()
    held = [(truth[r.doc_id], r.expected_grade, r.keep) for r in rated if r.doc_id in truth]
    assert len(held) > 500 and auc([t for t, *_ in held], [g for _, g, _ in held]) > 0.9
    print("quality held out", len(held), auc([t for t, *_ in held], [g for _, g, _ in held]), np.mean([(t == 1) == k for t, _, k in held]))


def test_very_long_and_equal_texts(spark):
    docs, labels = corpus(6, 300)
    long = " ".join(["plain"] * 200_000 + ["blockhead", "foreigners"])
    rows = [*docs, (9000, long, "en"), (9001, long, "en"), (9002, docs[0][1], "en")]
    df, known = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = {r.doc_id: r.score for r in toxicity.predict(df, known).collect()}
    grade = {r.doc_id: r.expected_grade for r in quality.graded(df, known).collect()}
    lang = {r.doc_id: r.score for r in langid.predict(df).collect()}
    for got in (score, grade, lang):
        assert len(got) == len(rows) and got[9000] == got[9001] and got[9002] == got[0] and np.isfinite(got[9000])


def test_forward_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.standard_normal(9), rng.standard_normal((9, 3))
    rows = [np.array(r) for r in ([0, 3, 4], [], [8], [1, 2, 5, 7])]
    want = [0.5 + w[r.astype(int)].sum() + sum(v[a] @ v[b] for i, a in enumerate(r) for b in r[:i]) for r in rows]
    assert np.allclose(toxicity.forward(0.5, w, v, *hashed.flat(rows))[0], want)


def test_ordinal_gradients_by_differences():
    rng = np.random.default_rng(2)
    ids, bounds = hashed.flat([np.array(r) for r in ([0, 2], [], [1], [0, 1, 3], [2])])
    level, scale = np.array([0, 1, 2, 3, 1]), np.array([0.2, 0.1, 0.3, 0.3, 0.1])
    params = [rng.standard_normal(4), rng.standard_normal(1), rng.standard_normal(2)]
    _, grads = quality.gradients(params, ids, bounds, level, scale)
    for p, g in zip(params, grads, strict=True):
        for i in range(len(p)):
            p[i] += 1e-6
            up = quality.gradients(params, ids, bounds, level, scale)[0]
            p[i] -= 2e-6
            down = quality.gradients(params, ids, bounds, level, scale)[0]
            p[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_ordinal_order_of_grades_and_thresholds():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 800)
    rows = [np.array(sorted({int(k) + 10, 20 + int(rng.integers(0, 30))})) for k in y]
    model = quality.fit(hashed.of_rows(rows, y, np.ones(len(y)), hashed.often), rounds=150)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails([model.columns[r] for r in rows])
    expected = tails.sum(axis=1)
    assert (np.diff([expected[y == k].mean() for k in range(4)]) > 0.5).all()
    assert (np.diff(tails, axis=1) <= 1e-12).all()


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(3)
    docs += [(None, "no id", None), (5000, None, "en"), (5001, "", "en"), (5002, "123 ***", "en"), (5002, "123 ***", "en")]
    labels += [(None, 1, 1), (7000, None, None)]
    return spark.createDataFrame([(*d, 1.5) for d in docs], DOC + ", score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_of_whole_tables(tables):
    docs, labels = tables
    got = toxicity.predict(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 200 < len(held) < 400 and auc([truth[r.doc_id] for r in held], [r.score for r in held]) > 0.9
    kept = quality.graded(docs, labels).collect()
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert len(kept) == docs.count() and np.mean([r.keep == (good[r.doc_id] == 1) for r in kept if r.doc_id in good and r.doc_id is not None]) > 0.98
    assert all(abs(r.expected_grade - r.tail_probability) < 1e-9 for r in kept)


def test_without_labels_or_documents(tables):
    docs, labels = tables
    assert {r.predicted for r in toxicity.predict(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.predict(docs.limit(0), labels).count() == 0
    assert quality.graded(docs, labels.limit(0)).count() == docs.count() and quality.graded(docs.limit(0), labels.limit(0)).count() == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.predict(docs).collect() if r.held_out]
    assert len(held) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_bundles_by_brute_force():
    texts = ["", "a", "Über den Wolken", "x1 -- y\n\nz", "Ab ab AB", "\n", "\u4e2d\u6587\u5b57 \U00020000x"]
    got, has = langid.encode(texts)
    v = lambda code: langid.letter(code).astype(int)
    for t, g, h in zip(texts, got, has, strict=True):
        s = [0]
        for c in t.lower():
            k = ord(c) if c.isalpha() else 0
            s += [k] if k or s[-1] else []
        s += [0] if s[-1] else []
        want = sum((np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in zip(s, s[1:], s[2:]) if b), np.zeros(langid.DIM, dtype=int))
        assert (g == want).all() and h == any(c.isalpha() for c in t)


def test_many_values_of_lang_are_bounded(spark):
    """The most frequent values are learned, ties by name; other rows are predicted all the same."""
    rows = [(i, "the and of with from", "en") for i in range(40)] + [(100 + i, "der die das und nicht", "de") for i in range(30)] + [(200 + i, "el los que una por", f"x{i:03}") for i in range(50)]
    df = spark.createDataFrame(rows, DOC)
    assert list(langid.learn(df, languages=2)) == ["de", "en"] and list(langid.learn(df, languages=4)) == ["de", "en", "x000", "x001"]
    profiles = langid.learn(df, languages=3)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, profiles).collect()}
    assert len(got) == len(rows) and got[0] == "en" and got[100] == "de" and {got[i] for i in range(200, 250)} == {"x000"}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == langid.DIM for v in profiles.values())


def test_equal_cosines_go_to_the_first_language_by_name(spark):
    profiles = langid.learn(spark.createDataFrame([(1, "the and of", "en"), (2, "der die das", "de")], DOC))
    twins = {"b": profiles["en"], "a": profiles["en"], "c": profiles["de"]}
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "the and of", None), (2, "der die das", None)], DOC), twins).collect()}
    assert got == {1: "a", 2: "c"}


def test_every_letter_has_a_vector_of_its_own():
    v = np.stack([langid.letter(c) for c in range(0x4E00, 0x4E00 + 600)]).astype(int)
    assert (np.abs(v @ v.T - langid.DIM * np.eye(600)) < langid.DIM / 3).all()


def test_odd_texts_are_undetermined(spark):
    rows = [(1, "der die das und nicht", "de"), (2, "the and of with from", "en"), (None, "the with and", None), (3, None, "en"), (4, "12 !", "de"), (2, "the and of with from", "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", score string")
    got = langid.predict(df)
    assert got.count() == 6 and {r.doc_id: r.lang_pred for r in got.collect()}[3] == "und"
    nothing = langid.identify(df, {})
    assert {r.lang_pred for r in nothing.collect()} == {"und"} and langid.predict(df.limit(0)).count() == 0
