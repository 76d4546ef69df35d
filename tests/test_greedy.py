import random

import numpy as np
import pytest

from doclens.operators import greedy, index, ingestion, retrieval

STATE = "seq long, label string, twin long, counts boolean"
LINKS = "earlier long, later long"


def in_order(docs, links):
    taken, labels = set(), set()
    around = {}
    for a, b in links:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    for seq, label, *_ in sorted(docs):
        if not (around.get(seq, set()) & taken) and (label is None or label not in labels):
            taken.add(seq)
            labels.add(label)
    return taken


@pytest.mark.parametrize(("most", "least_rounds"), [(greedy.ONE_TASK, 0), (10, 13)])
def test_a_chain_of_ten_thousand_in_few_rounds(spark, monkeypatch, most, least_rounds):
    rounds = []
    monkeypatch.setattr(greedy, "ONE_TASK", most)
    own = greedy.dropped
    monkeypatch.setattr(greedy, "dropped", lambda *t: (rounds.append(len(t)), own(*t))[1])
    n = 10_000
    state = spark.range(n).selectExpr("id AS seq", "CAST(NULL AS string) AS label", "id AS twin", "true AS counts")
    links = spark.range(n - 1).selectExpr("id AS earlier", "id + 1 AS later")
    got = {r.seq for r in greedy.accept(state, links, 10**6).where("status = 'accepted'").collect()}
    assert got == set(range(0, n, 2))
    assert rounds.count(1) <= least_rounds  # one table is dropped in each round of components


@pytest.mark.parametrize("one_task", [0, 30, 10**6])
def test_small_and_large_components_are_decided_alike(spark, one_task):
    r = random.Random(one_task)
    docs = [(i, r.choice([None, None, f"L{r.randrange(60)}"]), i, True) for i in range(150)]
    links = [(i, i + r.randint(1, 3)) for i in range(146) if r.random() < 0.4]
    got = greedy.accept(spark.createDataFrame(docs, STATE), spark.createDataFrame(links, LINKS), one_task).collect()
    assert len(got) == 150 and {x.seq for x in got if x.status == "accepted"} == in_order(docs, links)


@pytest.mark.parametrize("few", [0, 16])
def test_a_crowd_of_near_copies_is_settled_without_its_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(greedy, "FEW", few)
    listed = []
    own = retrieval.within
    monkeypatch.setattr(retrieval, "within", lambda *a, **k: (lambda df: (listed.append(df.count()), df)[1])(own(*a, **k)))
    rng = np.random.default_rng(few)
    crowd = np.array([1.0, 0, 0, 0]) + 0.05 * rng.standard_normal((200, 4))
    x = np.concatenate((crowd, rng.standard_normal((60, 4)), np.repeat(rng.standard_normal((1, 4)), 5, axis=0)))
    x = x[rng.permutation(len(x))]
    labels = [r if r is None else f"L{r}" for r in random.Random(few).choices([None, None, *range(90)], k=len(x))]
    rows = [(i, label, v.tolist()) for i, (label, v) in enumerate(zip(labels, x, strict=True))]
    got = ingestion.resolve(spark.createDataFrame(rows, "id long, label string, v array<double>"), spark.createDataFrame([], "id long, label string, v array<double>")).collect()
    links = [(i, j) for i in range(len(x)) for j in range(i) if 1 - ((x[i] - x[j]) ** 2).sum() >= 0.8]
    assert len(got) == len(x) and {r.id for r in got if r.status == "accepted"} == in_order([(i, label) for i, label, _ in rows], links)
    assert listed[0] <= 16 * len(x) < len(links)


def test_an_id_in_both_collections_is_two_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "law", say(1)), (1, "knowledge", say(1)), (1, "law", None), (2, "knowledge", say(1))], "doc_id long, collection string, text string")
    got = {(r.doc_id, r.collection): r for r in ingestion.ingest(docs, path, batch="b1").collect()}
    assert {k: r.status for k, r in got.items()} == {(1, "law"): "empty", (1, "knowledge"): "success", (2, "knowledge"): "duplicate"}
    again = ingestion.ingest(docs, path, batch="b1")  # a retry of the batch
    assert index.read(spark, path).count() == 1 and {r.status for r in again.collect()} == {"duplicate", "empty"}
    other = spark.createDataFrame([(1, "law", say(1)), (5, "law", say(1))], "doc_id long, collection string, text string")
    got = {r.doc_id: (r.status, r.existing_chunks) for r in ingestion.ingest(other, path).collect()}
    assert got == {1: ("success", 0), 5: ("duplicate", 1)}
    assert sorted(r.collection for r in index.read(spark, path).collect()) == ["knowledge", "law"]
