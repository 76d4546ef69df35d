import random

from doclens.llm import decontaminate as D

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def edit_distance_to_a_window(item, words):
    best = len(item)
    row0 = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        row = [i]
        for j, x in enumerate(words, 1):
            row.append(min(row0[j - 1] + (w != x), row0[j] + 1, row[-1] + 1))
        row0 = row
    return min(best, *row0)


def test_bit_parallel_distance():
    rnd = random.Random(9)
    for _ in range(300):
        item, words = ([rnd.choice("abcd") for _ in range(rnd.randint(1, n))] for n in (80, 120))
        assert D.least_distance(item, words) == edit_distance_to_a_window(item, words) == D.best_window(item, words)[0]


def made(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = {k: say(rnd.randint(15, 57)) for k in range(40)} | {100: say(3), 101: say(8), 102: ["One"]}
    docs, d = {}, 0
    for k, item in items.items():
        for frac in (0, 0.1, 0.15, 0.3, 0.6):
            w = list(item)
            for _ in range(int(frac * len(w))):
                i = rnd.randrange(len(w))
                if rnd.random() < 0.5:
                    w[i] = "zz"
                elif rnd.random() < 0.5:
                    del w[i]
                else:
                    w.insert(i, "yy")
            docs[d] = say(rnd.choice([0, 0, 30, 200])) + w + say(rnd.choice([0, 0, 40]))
            d += 1
    for _ in range(100):
        docs[d] = say(rnd.randint(0, 300))
        d += 1
    return items, docs


def test_finds_what_brute_force_finds(spark):
    items, docs = made()
    truth = {}
    for d, words in docs.items():
        for k, item in items.items():
            item, words = [w.lower() for w in item], [w.lower() for w in words]
            e = edit_distance_to_a_window(item, words)
            if e <= int(0.2 * len(item) + 1e-9):
                truth[d, k] = e
    df = spark.createDataFrame([(d, ", ".join(w)) for d, w in docs.items()], DOC).repartition(4)
    got = D.contaminated(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], ITEM)).collect()
    found = {(r.doc_id, r.item_id): r.edit_distance for r in got}
    assert len(found) == len(got) and found.keys() <= truth.keys()
    assert all(found[k] >= truth[k] for k in found)
    assert len(found) >= 0.98 * len(truth)
    assert all(k in found and found[k] == 0 for k, e in truth.items() if e == 0)
    for r in got:
        window = [w.lower() for w in docs[r.doc_id][r.word_start : r.word_end]]
        assert edit_distance_to_a_window([w.lower() for w in items[r.item_id]], window) == r.edit_distance


def test_nulls_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma delta epsilon"), (3, "...")], ITEM)
    docs = spark.createDataFrame([(None, "x alpha beta gamma delta epsilon y", 1), (2, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, item_id int")
    got = D.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.word_start, r.word_end) for r in got] == [(None, None, 1, 6)]
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [2, 3, 3]
    assert D.clean(docs, bench).columns == docs.columns
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items, docs = made(2)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], DOC)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], ITEM)
    key = lambda rows: sorted((r.doc_id, r.item_id) for r in rows if r.edit_distance == 0)
    whole = key(D.contaminated(df, bench).collect())
    monkeypatch.setattr(D, "_BLOCK_ROWS", 7)
    assert key(D.contaminated(df, bench).collect()) == whole


def edited(rnd, words, edits, kind):
    """words after so many edits: substitutions at random or evenly spaced (which leave the shortest runs), insertions and deletions, or all of them."""
    w, n = list(words), len(words)
    places = [(e + 1) * (n + 1) // (edits + 1) - 1 for e in range(edits)] if kind == "evenly" else rnd.sample(range(n), edits)
    for k, i in enumerate(sorted(places, reverse=True)):
        what = {"random": 0, "evenly": 0, "indels": rnd.choice((1, 2)), "all": rnd.randrange(3)}[kind]
        w[i : i + (what != 2)] = [] if what == 1 and len(w) > 1 else [f"new{k}"]
    return w


def test_recall_by_item_length_at_the_full_allowed_distance():
    """For items of each length, 60 passages with all edits allowed for each way to edit: the walks find 0.95 of each kind at least, and 0.99 of all."""
    rnd = random.Random(12)
    say = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    found = made = 0
    for n in (*range(1, 31), 36, 44, 52, 60, 64, 65, 80, 130):
        items = [(k, " ".join(say(n))) for k in range(60)]
        index = D.Index(items, 0.8)
        for kind in ("random", "evenly", "indels", "all"):
            texts = [" ".join(say(rnd.randrange(12)) + edited(rnd, t.split(), D.allowed(n, 0.8), kind) + say(rnd.randrange(12))) for _, t in items]
            got = {(d, k) for d, k, *_ in index.matches(texts)}
            hits = sum((k, k) in got for k in range(60))
            assert hits >= 57, (n, kind, hits)
            found, made = found + hits, made + 60
    assert found >= 0.99 * made


def test_exact_passages_are_all_found_in_very_long_texts():
    rnd = random.Random(5)
    say = lambda n: [f"w{rnd.randrange(900)}" for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate((1, 4, 5, 9, 15, 40, 63, 64, 65, 300))]
    text = " ".join(" ".join(say(20000)) + " " + t for _, t in items)
    got = {k: e for _, k, e, *_ in D.Index(items, 0.8).matches([text])}
    assert got == dict.fromkeys(range(10), 0)


def test_of_rows_that_share_an_id_only_those_with_a_passage_go(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], ITEM)
    docs = spark.createDataFrame([(None, "x alpha beta gamma delta epsilon y"), (None, "one"), (None, "two"), (None, None), (4, "alpha beta gamma delta epsilon"), (4, "three"), (4, "three")], DOC)
    assert sorted(str(r.text) for r in D.clean(docs, bench).collect()) == ["None", "one", "three", "three", "two"]
