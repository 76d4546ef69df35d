import os
import uuid

import pytest
from pyspark.sql import functions as F

from doclens.operators import analysis, ingestion
from doclens.plans import prompts, replies

DOC = "doc_id long, text string"
HEAD = "Số: 5/SYT\nV/v khám\n"
LONG = HEAD + "\n".join(f"Điều {i}. Sở Y tế chủ trì khám tại phường {i}, {'chữ ' * 700}." for i in range(1, 6))


def counting(folder, fail=()):
    """A model that leaves a file for each prompt it is asked, and fails on the kinds named."""

    def kind(p):
        return "chunk" if "<doan>" in p else "steps" if "mảng JSON" in p else "brief" if "tóm tắt" in p.split("\n")[0] else "advice" if "khuyen_nghi" in p else "other"

    def model(asked):
        for p in asked:
            open(os.path.join(folder, f"{kind(p)}-{uuid.uuid4().hex}"), "w").close()
        if any(kind(p) in fail for p in asked):
            raise TimeoutError("no answer")
        said = {"chunk": '{"nhiem_vu": [{"don_vi": "Ban A", "noi_dung": "làm"}, {"don_vi": "Tổ B", "noi_dung": "xem"}]}', "steps": '[{"hanh_dong": "làm", "don_vi": "Ban A"}]', "brief": "Bản tóm tắt", "advice": '{"khuyen_nghi": ["K"]}', "other": "đáp"}
        return [said[kind(p)] for p in asked]

    return model


def calls(folder):
    out = {}
    for n in os.listdir(folder):
        out[n.split("-")[0]] = out.get(n.split("-")[0], 0) + 1
    return out


def test_each_distinct_prompt_is_asked_once_and_stays_stored(spark, tmp_path):
    said, store = tmp_path / "said", str(tmp_path / "store")
    said.mkdir()
    df = spark.createDataFrame([(i, f"p{i % 7}" if i % 3 else None) for i in range(60)], "id long, p string")
    got = replies.asked(df, "p", "r", counting(said), store)
    assert got.where("p is not null").where("r = 'đáp' and r_error is null").count() == 40 and got.where("p is null and r is null").count() == 20
    assert got.count() == 60 and calls(said) == {"other": 7}
    replies.asked(df.union(spark.createDataFrame([(99, "new")], df.schema)), "p", "r", counting(said), store).collect()
    assert calls(said) == {"other": 8}
    replies.asked(df, "p", "r", counting(said), store, attempt=1).collect()
    assert calls(said) == {"other": 15}
    assert replies.asked(df.limit(0), "p", "r", counting(said)).count() == 0


def test_rounds_that_were_stored_are_not_asked_again_after_a_stop(spark, tmp_path, monkeypatch):
    said, store = tmp_path / "said", str(tmp_path / "store")
    said.mkdir()
    monkeypatch.setattr(replies, "ROUND", 10)
    df = spark.createDataFrame([(f"p{i}",) for i in range(40)], "p string")
    left, own = [2], replies.generations.add

    def add(*a):
        if not left[0]:
            raise RuntimeError("stopped")
        left[0] -= 1
        return own(*a)

    monkeypatch.setattr(replies.generations, "add", add)
    with pytest.raises(RuntimeError):
        replies.asked(df, "p", "r", counting(said), store)
    first = calls(said)["other"]
    assert 0 < first < 40
    left[0] = 100
    assert replies.asked(df, "p", "r", counting(said), store).where("r is null").isEmpty()
    assert calls(said) == {"other": 40}


def test_failures_are_rows_and_are_tried_again(spark, tmp_path):
    said, store = tmp_path / "said", str(tmp_path / "store")
    said.mkdir()
    df = spark.createDataFrame([("p",)], "p string")
    r = replies.asked(df, "p", "r", counting(said, fail=("other",)), store, tries=2).first()
    assert r.r is None and r.r_error == "TimeoutError: no answer" and calls(said) == {"other": 2}
    assert replies.asked(df, "p", "r", counting(said), store).first().r == "đáp"
    short = replies.asked(df, "p", "r", lambda ps: [], tries=1).first()
    assert short.r is None and short.r_error == "0 replies to 1 prompts"
    assert replies.asked(df, "p", "r", lambda ps: [None for _ in ps]).first().r_error == "no reply"


def test_an_analysis_with_context_asks_each_prompt_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, LONG), (2, LONG)], DOC)
    chunks = analysis.working_chunks(analysis.metadata.extract_metadata(docs)).select("chunk").distinct().count()
    assert chunks > 2
    index = spark.createDataFrame([("a", "law", "Điều 1. chữ", "s", "i", "Điều 1")], "id string, collection string, text string, source string, issuer string, article string").withColumn("embedding", ingestion.embed(F.col("text")))
    got = analysis.analyze_with_context(docs, index, ingestion.embed, counting(tmp_path)).collect()
    assert calls(tmp_path) == {"chunk": chunks, "steps": 1, "brief": 1, "advice": 1}
    for r in got:
        assert [t.don_vi for t in r.nhiem_vu] == ["Ban A", "Tổ B"] and r.tom_tat == "Bản tóm tắt" and len(r.quy_trinh) == 1
        assert r.goi_y.khuyen_nghi == ["K"] and r.errors == []


@pytest.mark.parametrize("fail", [("chunk", "steps", "brief", "advice"), ("brief",)])
def test_a_failing_model_leaves_rules_summary_and_no_steps(spark, tmp_path, fail):
    docs = spark.createDataFrame([(1, LONG), (2, None)], DOC)
    got = {r.doc_id: r for r in analysis.analyze(docs, counting(tmp_path, fail)).collect()}
    rules = {r.doc_id: r for r in analysis.analyze(docs).collect()}
    assert got[1].errors == ["TimeoutError: no answer"] and rules[1].errors == []
    if "chunk" in fail:
        for c in set(rules[1].asDict()) - {"errors"}:
            assert got[1][c] == rules[1][c], c
    else:
        assert got[1].tom_tat.startswith("Ban A: làm. Tổ B: xem") and len(got[1].quy_trinh) == 1
    assert got[2].nhiem_vu == [] and got[2].quy_trinh == []


def test_questions_with_a_failing_model(spark, tmp_path):
    asked = spark.createDataFrame([(1, "gì?"), (2, "gì?")], "query_id long, question string")
    context = spark.createDataFrame([(1, "c"), (2, "c")], "query_id long, context string")
    got = prompts.answer(asked, context, counting(tmp_path, ("other",))).collect()
    assert [r.answer for r in got] == [prompts.NO_CONTEXT] * 2 and calls(tmp_path) == {"other": 3}
