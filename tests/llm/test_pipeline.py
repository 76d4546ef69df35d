import random

import pytest

import corpus_pipeline as C
from doclens.llm import decontaminate, langid
from doclens.llm.common import table
from test_decontaminate import edit_distance_to_a_window
from test_packing import ids_of
from test_simhash import plain

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, seen[-1], SF)
        if k + 1 < len(C.STAGES):
            assert out.columns == columns
        seen.append(out.cache())
    raw, spoken, unique, cut, clean, packed = (d.collect() for d in seen)
    assert {r.doc_id for r in spoken} == {r.doc_id for r in raw if r.text and any(c.isalpha() for c in r.text)}
    assert [{r.doc_id for r in x} >= {r.doc_id for r in y} for x, y in ((spoken, unique), (unique, cut), (cut, clean), (clean, packed))] == [True] * 4
    texts = {r.doc_id: r.text for r in unique}
    assert len(cut) == len(unique) and all(len(r.text) <= len(texts[r.doc_id]) and r.n_chars == len(r.text) for r in cut)
    items = [r.text.lower() for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in r.text.lower() for r in clean for i in items)
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}


def test_run_gives_what_the_stages_give(spark):
    got = C.run(spark, SF)
    lengths = got.groupBy("sequence_id").sum("length").collect()
    assert lengths and max(r[1] for r in lengths) <= 4096


def test_a_text_without_letters_goes(spark):
    df = spark.createDataFrame([(1, "the and of", "en", "s", 10), (2, "12 34", "en", "s", 5), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in C.language_id(spark, df, SF).collect()] == [1]
    assert langid.DIM >= 256


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(seed=3):
    """Documents with letters and without, copies, near copies, shared passages, and exact and edited benchmark items."""
    rnd = random.Random(seed)
    say = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7))) for _ in range(n))
    items = [(k, say(rnd.randint(12, 40))) for k in range(5)] + [(9, None)]
    passages = [say(40) for _ in range(3)]
    texts = [None, "", "12 34 !", "\n\t", "one", "é"]
    texts += [say(rnd.randint(20, 200)) for _ in range(20)]
    texts += [texts[7], texts[7].upper(), texts[8] + " end", texts[9]]
    for i in range(12):
        parts = [say(rnd.randint(5, 60)), rnd.choice(passages), say(rnd.randint(5, 60))]
        rnd.shuffle(parts)
        texts.append(" ".join(parts))
    for k, t in items[:5]:
        words = t.split()
        words[len(words) // 2] = "zzz"
        texts += [say(30) + " " + t + " " + say(9), say(12) + " " + " ".join(words), " ".join(words[: len(words) // 2])]
    texts.append(say(9000))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows, items


def by_hand(rows, items):
    """What each stage but the last keeps, as sorted (doc_id, text)."""
    spoken = sorted((d, t) for d, t, *_ in rows if t and any(c.isalpha() for c in t))
    fps, root = [plain(t) for _, t in spoken], list(range(len(spoken)))
    for i in range(len(spoken)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    unique = [x for i, x in enumerate(spoken) if root[i] == i]
    first, cut = {}, []
    for d, t in unique:
        raw = t.encode()
        for i in range(len(raw) - 99):
            first.setdefault(raw[i : i + 100], (d, i))
    for d, t in unique:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if first[raw[i : i + 100]] < (d, i):
                gone[i : i + 100] = b"\1" * 100
        cut.append((d, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")))
    near = lambda words, item: edit_distance_to_a_window(item, words) <= decontaminate.allowed(len(item), 0.8)
    wanted = [decontaminate.words_of(t) for _, t in items if t]
    clean = [(d, t) for d, t in cut if not any(near(decontaminate.words_of(t), w) for w in wanted)]
    return spoken, unique, cut, clean


@pytest.fixture
def folder(spark, tmp_path):
    rows, items = small_corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_every_stage_and_run_by_brute_force(spark, folder):
    want = by_hand(*small_corpus())
    assert all(len(a) > len(b) for a, b in zip(want, want[1:], strict=False) if a is not want[1]) and want[1] != want[2]
    docs = table(spark, folder, "documents")
    for (_, stage), kept in zip(C.STAGES[:-1], want, strict=True):
        docs = stage(spark, docs, folder).cache()
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == kept
    got = C.run(spark, folder).collect()
    pieces = sorted((r.doc_id, r.piece, r.start, r.length) for r in got)
    made = []
    for d, t in want[-1]:
        n = len(ids_of(t))
        made += [(d, k, a, min(4096, n - a)) for k, a in enumerate(range(0, n, 4096))]
    assert pieces == made
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 4096


def test_stages_with_odd_rows(spark, folder):
    """Rows without an id or with a repeated one are judged by their texts; extra columns with clashing names stay; empty tables give empty ones."""
    say = lambda seed: " ".join("".join(random.Random(seed * 999 + i).choices("abcdefgh", k=5)) for i in range(60))
    rows = [(None, say(1), "a"), (None, say(2), "b"), (None, say(2), "b"), (4, say(3), "c"), (4, say(4), "d"), (5, None, "e"), (6, "7", "f"), (7, small_corpus()[1][0][1], "g"), (7, say(5), "h"), (8, say(2), "i")]
    df = spark.createDataFrame([(d, t, "en", s, 1, 5, "k") for d, t, s in rows], COLUMNS + ", component_id int, key string")
    docs = df
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == df.columns
        assert stage(spark, df.limit(0), folder).count() == 0
    assert sorted(r.source for r in docs.collect()) == ["a", "b", "c", "d", "h"]
    assert C.STAGES[-1][1](spark, docs, folder).count() == 5 and C.STAGES[-1][1](spark, df.limit(0), folder).count() == 0
