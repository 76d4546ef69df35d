import random

from doclens.llm import licenses as L

DOC = "doc_id long, text string"


def brute(text, least=0.8):
    best = {}
    parts = [("line", x) for x in text.split("\n")] + ([("paragraph", p) for p in L._PARAGRAPH.split(text)]) + [("text", text)]
    for kind, p in parts:
        own = L.bigrams(p)
        for name, texts in L.TEMPLATES.items():
            for t in texts:
                theirs = L.bigrams(t)
                if own:
                    d = 2 * len(own & theirs) / (len(own) + len(theirs))
                    if d >= least and d > best.get(name, (0, ""))[0]:
                        best[name] = (d, kind)
    return best


def test_pruned_scan_matches_all_pairs(spark):
    rnd = random.Random(1)
    every = [t for ts in L.TEMPLATES.values() for t in ts]
    rows = [(0, None), (1, ""), (2, "MIT"), (3, "\n\n")]
    for d in range(4, 120):
        words = rnd.choice(every).split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "and", "the"])
        if rnd.random() < 0.3:
            words.insert(len(words) // 2, "\n")
        rows.append((d, rnd.choice(["", "Some prose here.\n", "a b\n\n"]) + " ".join(words) + rnd.choice(["", "\n", "\n \nmore"])))
    got = L.licenses(spark.createDataFrame(rows, DOC).repartition(3)).collect()
    found = {(r.doc_id, r.license): r.dice for r in got}
    assert found == {(d, k): v[0] for d, t in rows if t for k, v in brute(t).items()} and len(found) > 60
    assert L.counted(L.licenses(spark.createDataFrame(rows, DOC))).count() > 3


def test_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License.", "x"), (7, "released UNDER the mit license", None), (7, "released UNDER the mit license", None)], "doc_id long, text string, license string")
    got = L.licenses(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["7", "7", "None"] and {r.license for r in got} == {"MIT"}
    assert L.licenses(df.limit(0)).count() == 0


def test_notices_inside_lines_and_across_paragraphs(spark):
    apache = L.TEMPLATES["Apache-2.0"][1].replace("at http", "at\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")
    prose = "Here is what else the document says, and it goes on for some time about other things."
    long = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, f"{prose}\n\n{apache}\n\n{long}", {"Apache-2.0"}),
        (2, "This code is released under the MIT License.", {"MIT"}),
        (3, "See the notes. Released under the MIT License.", {"MIT"}),
        (4, f"{prose} {L.FULLER['LGPL-2.1'][0]} {prose}", {"LGPL-2.1"}),
        (5, f"{prose} {L.FULLER['Unlicense'][0]} {prose}", {"Unlicense"}),
        (6, "This project is licensed under the terms of its owner, and this work is licensed under no licence at all.", set()),
        (7, f"{prose} Released\n\nunder the MIT\nLicense", {"MIT"}),
        (8, f"{prose} {L.FULLER['BSD-2-Clause'][1]} {prose}", {"BSD-2-Clause"}),
        (9, None, set()),
        (10, prose * 50, set()),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], DOC)
    got = L.licenses(df, windows=True).collect()
    for d, _, want in rows:
        assert {r.license for r in got if r.doc_id == d} >= want and bool(want) == any(r.doc_id == d for r in got), d
    assert {r.part for r in got if r.doc_id == 1 or r.license in ("LGPL-2.1", "Unlicense")} == {"window"}
    assert all(r.dice == 1 for r in got if r.doc_id in (1, 2, 3) and r.license in ("Apache-2.0", "MIT"))
    assert {r.license for r in got if r.doc_id == 8} == {"BSD-2-Clause"}


def test_windows_match_all_windows():
    rnd = random.Random(4)
    templates = L.with_fuller()
    scanner = L.Scanner(templates, 0.8)
    short = [(k, t) for k, ts in templates.items() for t in ts if len(t) < 100]
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(3):
            own = rnd.choice(short)[1].split()
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(["x", "and", "the"])
            words += [rnd.choice(["the", "y", "under"]) for _ in range(rnd.randint(0, 9))] + own
        text = " ".join(words)
        ws = L._WORD.findall(text.lower())
        want = {}
        for name, t in short:
            theirs, n = L.bigrams(t), len(L._WORD.findall(t.lower()))
            for a in range(len(ws)):
                for b in range(a + n, len(ws) + 1):
                    own = set(zip(ws[a:b], ws[a + 1 : b]))
                    d = 2 * len(own & theirs) / (len(own) + len(theirs))
                    if d >= 0.8 and d > want.get(name, 0):
                        want[name] = d
        assert {k: v[0] for k, v in scanner.windows(text, {}).items()} == want
        hits += len(want)
    assert hits > 100


def test_windows_add_rows_and_change_none(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda rows: {tuple(r) for r in rows if r.part != "window"}
    assert key(L.licenses(df).collect()) == key(L.licenses(df, windows=True).collect())


def test_every_template_inside_a_long_text_is_found_as_its_licence(spark):
    """Each passage between other words, broken at its first and last words."""
    rnd = random.Random(7)
    say = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))
    cases = [(name, t) for name, texts in L.with_fuller().items() for t in texts]
    rows = [(i, say(300) + " " + "\n".join(t.replace(" ", "\n", 1).rsplit(" ", 3)) + " " + say(300)) for i, (_, t) in enumerate(cases)]
    best = {}
    for r in L.licenses(spark.createDataFrame(rows, "doc_id long, text string"), windows=True).collect():
        best.setdefault(r.doc_id, {})[r.license] = r.dice
    assert all(name in best[i] for i, (name, _) in enumerate(cases))
    # Of notices that differ in few words, several licences are found. Where windows found them all, the own one is nearest.
    whole = [(i, name) for i, (name, _) in enumerate(cases) if name not in L.TEMPLATES]
    assert all(best[i][name] == max(best[i].values()) for i, name in whole)


def test_a_very_long_text(spark):
    text = "word " * 300_000 + L.with_fuller()["Zlib"][0] + " word" * 300_000
    assert [r.license for r in L.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), windows=True).collect()] == ["Zlib"]
