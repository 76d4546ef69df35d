import pytest

from doclens.operators import generations, index

SCHEMA = "collection string, source string, chunk_index int, text string"


def rows(spark, *sources, collection="law"):
    return spark.createDataFrame([(collection, s, i, f"text {s} {i}") for s in sources for i in range(2)], SCHEMA)


def sources(df):
    return sorted(r.source for r in df.collect()) if df is not None else []


@pytest.fixture
def stopping(monkeypatch):
    def at(name):
        def step(now):
            if now == name:
                raise RuntimeError("stopped")

        monkeypatch.setattr(generations, "step", step)

    return at


@pytest.mark.parametrize("where", ["data", "list", "pointer"])
def test_a_change_that_stops_counts_whole_or_not_at_all(spark, tmp_path, stopping, where):
    path = str(tmp_path / "index")
    index.add(rows(spark, "A", "B"), path, "first")
    index.add(rows(spark, "A", collection="knowledge"), path)
    stopping(where)
    with pytest.raises(RuntimeError):
        index.delete_by_source(spark, path, "law", "A")
    kept = ["A", "A", "A", "A", "B", "B"] if where != "pointer" else ["A", "A", "B", "B"]
    assert sources(index.read(spark, path)) == kept
    with pytest.raises(RuntimeError):
        index.add(rows(spark, "C"), path, "next")
    stopping(None)
    index.add(rows(spark, "C"), path, "next")  # the retry
    index.add(rows(spark, "A", "B"), path, "first")  # an old one
    assert sources(index.read(spark, path)) == sorted([*kept, "C", "C"])
    assert index.delete_by_source(spark, path, "law", "A") == (2 if where != "pointer" else 0)
    assert sources(index.read(spark, path)) == ["A", "A", "B", "B", "C", "C"]


def test_readers_beside_every_step_keep_what_they_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index.add(rows(spark, "A", "B"), path)
    before, seen = index.read(spark, path), []
    monkeypatch.setattr(generations, "step", lambda name: seen.append((name, sources(index.read(spark, path)), sources(before))))
    assert index.delete_by_source(spark, path, "law", "A") == 2
    assert [s[0] for s in seen] == ["data", "list", "pointer"]
    assert [len(s[1]) for s in seen] == [4, 4, 2] and all(len(s[2]) == 4 for s in seen)
    assert sources(index.read(spark, path, 1)) == ["A", "A", "B", "B"]
    with pytest.raises(ValueError):
        index.read(spark, path, 9)


def test_a_faster_writer_is_not_overwritten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index.add(rows(spark, "A", "B"), path)
    left = [1]

    def step(name):
        if name == "list" and left:
            left.pop()
            index.add(rows(spark, "C"), path)
            assert index.delete_by_source(spark, path, "law", "B") == 2

    monkeypatch.setattr(generations, "step", step)
    assert index.delete_by_source(spark, path, "law", "A") == 2
    assert sources(index.read(spark, path)) == ["C", "C"]


def test_a_pointer_half_put_counts_as_none_and_vacuum_frees_files(spark, tmp_path):
    path = tmp_path / "index"
    assert index.read(spark, str(path)) is None and index.delete_by_source(spark, str(path), "law", "A") == 0
    index.add(rows(spark, "A", "B"), str(path))
    (path / "generations" / f"{2:020d}").write_text("")
    assert sources(index.read(spark, str(path))) == ["A", "A", "B", "B"]
    assert index.delete_by_source(spark, str(path), "law", "B") == 2
    index.add(rows(spark, "D", collection="a b/c=d"), str(path))
    assert index.delete_by_source(spark, str(path), "a b/c=d", "D") == 2
    assert generations.numbers(spark, str(path)) == [1, 3, 4, 5]
    assert generations.vacuum(spark, str(path)) == 2
    assert sources(index.read(spark, str(path))) == ["A", "A"] and generations.numbers(spark, str(path)) == [5]
    index.add(rows(spark, "A").limit(0), str(path))
    assert index.delete_by_source(spark, str(path), "law", "A") == 2 and index.read(spark, str(path)) is None


def test_difference_of_generations_with_multiplicities(spark):
    schema = "id string, text string, at int"
    old = spark.createDataFrame([("same", "x", 1), ("twice", "x", 1), ("twice", "x", 1), ("gone", "x", 1), ("other", "x", 1), ("place", "x", 1), ("nulls", None, None)], schema)
    new = spark.createDataFrame([("same", "x", 1), ("twice", "x", 1), ("new", "x", 1), ("new", "x", 1), ("other", "y", 1), ("place", "x", 2), ("nulls", None, 3)], schema)
    got = sorted(map(tuple, generations.difference(old, new, "id", ["text"], ["at"]).collect()))
    assert got == [("gone", "removed", 1), ("new", "added", 2), ("nulls", "moved", 1), ("other", "changed", 1), ("place", "moved", 1), ("twice", "removed", 1)]
    assert generations.difference(old, old, "id", ["text"], ["at"]).isEmpty()
