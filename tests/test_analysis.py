import itertools
import json as stdjson
import random

import pytest
from pyspark.sql import functions as F

from doclens.functions import json, text
from doclens.operators import analysis, chunking, extraction, index, ingestion, metadata, retrieval
from doclens.plans import prompts

DOC = "doc_id long, text string"


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want, safe",
    [
        ("đầu\n\n# Mục 1\n\nthân", "# Mục 1\nthân", "# Mục 1\nthân"),
        ("# Độc lập - Tự do - Hạnh phúc\n#\n## Thân\nx", "## Thân\nx", "## Thân\nx"),
        ("đầu\nĐiều 1. a\nChương II\nb", "Chương II\nb", "Điều 1. a\nChương II\nb"),
        ("đầu\nhai\nba", "ba", "đầu\nhai\nba"),
        ("đầu\nhai\n", "", "đầu\nhai"),
        ("", "", ""),
    ],
)
def test_body(spark, text, want, safe):
    assert one(spark, text, metadata.body) == want
    assert one(spark, text, lambda c: metadata.body(c, safe=True)) == safe


def test_deadlines_in_order_of_the_text_and_merged(spark):
    text = "Xong trước 1/2/2024. Tổng hợp gửi trước ngày 1/2/2024; sau 5 ngày làm việc. Trong thời hạn 5 ngày kể từ nay"
    assert one(spark, text, extraction.deadlines) == ["Tổng hợp gửi trước 1/2/2024", "Trong thời hạn 5 ngày kể từ nay"]
    assert one(spark, "Bắt đầu từ ngày 3/4/2024. Thời gian thực hiện: hàng quý, mỗi năm", extraction.when) == "từ 3/4/2024; hàng quý, mỗi năm"
    assert one(spark, "Thời gian: 01/02/2024\n", extraction.when) == "không nói rõ"
    assert one(spark, "", extraction.when) == "không nói rõ"


def test_tasks(spark):
    text = "Sở Y tế chủ trì việc này; sở y tế phối hợp. Giao cho Công an phường thực hiện; người dân hỗ trợ. UBND xã có trách nhiệm làm"
    got = [(t.don_vi, t.vai_tro) for t in one(spark, text, extraction.tasks)]
    assert got[0] == ("Sở Y tế", "chủ trì") and ("UBND xã", "thực hiện") in got
    assert sum(u.lower() == "sở y tế" for u, _ in got) == 1 and all("người dân" != u for u, _ in got)
    assert one(spark, "", extraction.tasks) == []


def test_legal_items(spark):
    assert one(spark, "Căn cứ Luật số 1; Nghị định 2;", extraction.legal_items) == ["Luật số 1; Nghị định 2"]
    assert one(spark, "- Luật số 11\n- Luật số 12;\n- x", extraction.legal_items) == ["Luật số 11", "Luật số 12"]
    assert one(spark, "", extraction.legal_items) == []


REPLIES = [
    ('{"kinh_phi": ["a ", "", "b"], "dia_diem": null, "nhiem_vu": [{"don_vi": "*Sở*", "vai_tro": "Giám sát"}, {"don_vi": "?"}, 5, {"don_vi": "Ban", "vai_tro": "x", "noi_dung": "n"}]}', "a; b", [("Sở", "", "giám sát"), ("Ban", "n", "thực hiện")]),
    ('```json\n{"kinh_phi": "**12** đồng"}\n```', "12 đồng", []),
    ('Kết quả {"kinh_phi": 12} xong', "12", []),
    ("[1, 2]", None, None),
    ("{không phải}", None, None),
    ("null", None, None),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("reply, money, tasks", REPLIES)
def test_replies(spark, reply, money, tasks):
    df = spark.createDataFrame([(reply,)], "r string").select(json.json_object(F.col("r")).alias("v"))
    r = df.select(F.col("v").isNull().alias("no"), json.text_value(F.col("v"), "kinh_phi").alias("m"), json.text_value(F.col("v"), "dia_diem").alias("d"), analysis.model_tasks(F.col("v")).alias("t")).first()
    assert r.no == (money is None) and r.d == "không nói rõ"
    if money is not None:
        assert r.m == money and [tuple(t) for t in r.t] == tasks


def test_steps(spark):
    reply = 'Đây: [{"buoc": 4, "hanh_dong": "*làm*", "don_vi": "Sở"}, {"hanh_dong": ""}, "x", {"hanh_dong": "tiếp"}]'
    assert [tuple(s) for s in one(spark, reply, analysis.steps)] == [(4, "làm", "Sở"), (2, "tiếp", "")]
    assert one(spark, '{"hanh_dong": "a"}', analysis.steps) == [] and one(spark, "chữ", analysis.steps) == []
    assert len(one(spark, stdjson.dumps([{"hanh_dong": "a"}] * 20), analysis.steps)) == 12


def test_without_echoes(spark):
    assert one(spark, "Ví dụ: bỏ\n→→ giữ  lại [NHAN]\r\n\nInput: bỏ\nlà Kết quả: xong", text.without_echoes) == "giữ lại là xong"
    assert one(spark, None, text.without_echoes) == ""


def record(**x):
    return {"nhiem_vu": [], "thoi_gian": "không nói rõ", "kinh_phi": "không nói rõ", "dia_diem": "không nói rõ", "tom_tat": "", "luu_y": "", "tom_tat_parts": []} | x


def test_merging_rules(spark):
    text = lambda f, a, b, *more: spark.range(1).select(f(F.lit(a), F.lit(b), *more).alias("x")).first().x
    assert text(analysis.union_text, "a; abc", "ABC d; không nói rõ") == "ABC d" and text(analysis.union_text, "", "không có") == "không nói rõ"
    assert text(analysis.union_notes, "a b", "a; không; c") == "a b; c"
    assert text(analysis.union_clauses, "làm x", "x; thêm y") == "làm x; thêm y" and text(analysis.union_clauses, "", "y") == "y"
    df = spark.createDataFrame([([("Sở Y tế", "a", "chủ trì")], [("sở y", "b", "hỗ trợ"), ("?", "", "")])], f"a {analysis.TASKS}, b {analysis.TASKS}")
    got = [t.asDict() for t in df.select(analysis.union_tasks(F.col("a"), F.col("b")).alias("x")).first().x]
    assert got == [{"don_vi": "Sở Y tế", "noi_dung": "a; b", "vai_tro": "chủ trì"}]


def test_records_merge_as_an_ordered_tree(spark):
    values = ["x1", "x2", "x3; y", "x4", "x"]
    rows = [(7, i, record(kinh_phi=v, nhiem_vu=[{"don_vi": f"Sở {i}", "noi_dung": "", "vai_tro": "hỗ trợ"}])) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, f"doc_id long, chunk_index int, record {analysis.RECORD}").repartition(5)
    got = analysis.merge_records(df).first().record
    two = lambda a, b: spark.range(1).select(analysis.union_text(F.lit(a), F.lit(b), ", ").alias("x")).first().x
    assert got.kinh_phi == two(two(two("x1", "x2"), two("x3; y", "x4")), "x")
    assert [t.don_vi for t in got.nhiem_vu] == [f"Sở {i}" for i in range(5)]


def test_long_documents_keep_forty_chunks(spark):
    text = "\n".join(f"Chương {i}\n" + "nội dung " * 40 for i in range(1, 46))
    meta = metadata.extract_metadata(spark.createDataFrame([(1, text), (2, None), (3, "")], DOC))
    got = analysis.working_chunks(meta).orderBy("chunk_index").collect()
    assert [r.chunk.split("\n")[0] for r in got] == [f"Chương {i}" for i in [*range(1, 21), *range(26, 46)]]


DOCUMENT = "SỞ Y TẾ\nSố: 5/SYT\nV/v khám\nCăn cứ Luật số 123;\nĐiều 1. Sở Y tế chủ trì khám bệnh. Kinh phí do xã lo.\nĐiều 2. Công an xã phối hợp; báo cáo trước ngày 1/2/2024."


def test_analyze_by_rules(spark):
    rows = {r.doc_id: r for r in analysis.analyze(spark.createDataFrame([(1, DOCUMENT), (2, ""), (3, None)], DOC)).collect()}
    assert rows[1].can_cu_phap_ly == ["Luật số 123"] and rows[1].query == "Luật số 123" and rows[1].quy_trinh == []
    assert rows[1].tom_tat.startswith("Sở Y tế chủ trì. Phối hợp: Công an xã. Thời gian: báo cáo trước 1/2/2024. Kinh phí: Kinh phí do xã lo.")
    assert rows[2].kinh_phi == rows[3].thoi_gian == "không nói rõ" and rows[3].nhiem_vu == [] and rows[2].tom_tat == ""


def test_analyze_with_a_model(spark):
    def model(asked):
        def reply(p):
            if "<doan>" in p:
                return '{"nhiem_vu": [{"don_vi": "Ban A", "noi_dung": "làm"}, {"don_vi": "Tổ B"}], "kinh_phi": "", "luu_y": "gấp"}'
            return '[{"hanh_dong": "làm", "don_vi": "Ban A"}]' if "mảng JSON" in p else "This is English"

        return [reply(p) for p in asked]

    r = analysis.analyze(spark.createDataFrame([(1, DOCUMENT)], DOC), model).first()
    assert [t.don_vi for t in r.nhiem_vu] == ["Ban A", "Tổ B"] and r.kinh_phi == "Kinh phí do xã lo" and r.luu_y == "gấp"
    assert [tuple(s) for s in r.quy_trinh] == [(1, "làm", "Ban A")]
    assert r.tom_tat.startswith("Ban A: làm. Tổ B. Thời gian")


def test_suggestions_and_prompts(spark):
    basis = F.array(F.lit("Luật A"))
    assert one(spark, 'x {"khuyen_nghi": ["a"]} y', lambda c: analysis.suggestions(c, basis)) == (["Luật A"], ["a"])
    assert one(spark, "hỏng", lambda c: analysis.suggestions(c, basis)) == (["Luật A"], [])
    assert one(spark, "a", lambda c: prompts.documents_context(F.array(c, c))) == "[Tài liệu 1]\na\n\n[Tài liệu 2]\na"
    assert one(spark, "a", lambda c: prompts.documents_context(F.array().cast("array<string>"))) == prompts.NO_CONTEXT


def greedy(docs, links):
    taken, labels = set(), set()
    for seq, label in sorted(docs):
        if not ({a for a, b in links if b == seq} & taken) and (label is None or label not in labels):
            taken.add(seq)
            labels.add(label)
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_accept_is_greedy_in_order(spark, seed):
    r = random.Random(seed)
    docs = [(i, r.choice(["A", "B", None, f"L{i}"])) for i in range(40)]
    links = [p for p in itertools.combinations(range(40), 2) if r.random() < 0.06]
    state = spark.createDataFrame([(i, label, i, True) for i, label in docs], "seq long, label string, twin long, counts boolean")
    got = ingestion.accept(state, spark.createDataFrame(links, "earlier long, later long")).collect()
    assert len(got) == 40 and {x.seq for x in got if x.status == "accepted"} == greedy(docs, links)


@pytest.mark.parametrize("seed", range(2))
def test_accept_by_classes_of_equal_documents(spark, seed):
    """Links are between classes; documents that bring nothing refuse no other."""
    r = random.Random(seed)
    docs = [(i, r.choice(["A", None, f"L{i}"]), r.choice([None, *range(12)]), r.random() < 0.8) for i in range(40)]
    near = [p for p in itertools.combinations(range(12), 2) if r.random() < 0.1]
    taken, labels, classes, want = set(), set(), set(), set()
    for seq, label, twin, counts in docs:
        alike = twin is not None and (twin in classes or any({twin, c} in map(set, near) for c in classes))
        if not alike and (label is None or label not in labels):
            want.add(seq)
            if counts:
                taken.add(seq)
                labels.add(label)
                classes |= {twin} - {None}
    got = ingestion.accept(spark.createDataFrame(docs, "seq long, label string, twin long, counts boolean"), spark.createDataFrame(near or [(90, 91)], "earlier long, later long")).collect()
    assert {x.seq for x in got if x.status == "accepted"} == want and len(got) == 40


def test_resolve_many_equal_and_odd_vectors(spark):
    schema = "id long, label string, v array<double>"
    batch = [(i, None, [1.0, 0.0]) for i in range(50)] + [(60, None, None), (61, None, [float("nan"), 1.0]), (62, None, [1.0]), (63, "x", None), (64, "x", None), (65, None, [0.0, 1.0])]
    got = {r.id: r.status for r in ingestion.resolve(spark.createDataFrame(batch, schema), spark.createDataFrame([], schema)).collect()}
    assert len(got) == 56 and {i for i, s in got.items() if s == "accepted"} == {0, 60, 61, 62, 63, 65}


def test_ingest_in_two_batches(spark, tmp_path):
    """The second batch meets the first one in the index: by label, by content (with the nearest source), or not at all."""
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    head = lambda n: f"Số: {n}/UBND-TH\nV/v việc {n}\nĐiều 1. "
    path = str(tmp_path / "index")
    first = [(1, "law", head(1) + say("a")), (2, "law", head(2) + say("b")), (3, "knowledge", head(1) + say("a")), (4, "law", None), (5, "law", "")]
    got = {r.doc_id: r for r in ingestion.ingest(spark.createDataFrame([(*r, "x") for r in first], "doc_id long, collection string, text string, source string"), path).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "success", 2: "success", 3: "success", 4: "empty", 5: "empty"}
    second = [(6, "law", head(1) + say("c")), (7, "law", head(7) + say("b")), (8, "law", head(8) + say("d")), (9, "law", head(9) + say("d")), (None, "law", "x")]
    got = {r.doc_id: r for r in ingestion.ingest(spark.createDataFrame(second, "doc_id long, collection string, text string"), path).collect()}
    assert {i: r.status for i, r in got.items()} == {6: "duplicate", 7: "duplicate", 8: "success", 9: "duplicate"}
    assert got[6].matched_source is None and got[6].existing_chunks == 1
    assert got[7].matched_source == "2/UBND-TH — V/v việc 2" and got[9].matched_source == "8/UBND-TH — V/v việc 8"
    rows = index.read(spark, path)
    assert rows.count() == 4 and {"embedding", "issuer", "so_van_ban", "article"} <= set(rows.columns)
    asked = spark.createDataFrame([("q1", "w1 " + say("b")), ("q2", None), ("q1", "w1 " + say("b"))], "query_id string, text string")
    found = sorted((r.query_id, r.context) for r in retrieval.retrieve_context(asked, rows, ingestion.embed).collect())
    assert len(found) == 3 and found[0][1].startswith("[LUẬT - Điều 1]\nĐiều 1. wbx0") and "(Nguồn: 2/UBND-TH — V/v việc 2)" in found[0][1]
    told = analysis.analyze_with_context(spark.createDataFrame([(1, head(4) + "Căn cứ Luật số 5;\n" + say("a")), (2, None)], DOC), rows, ingestion.embed, lambda ps: ['{"can_cu_phap_ly": ["L"], "khuyen_nghi": ["K"]}' for _ in ps])
    by_id = {r.doc_id: r for r in told.collect()}
    assert by_id[1].related_context and by_id[1].goi_y.khuyen_nghi == ["K"] and len(by_id) == 2


def test_resolve_against_the_index(spark):
    schema = "id long, label string, v array<double>"
    index = spark.createDataFrame([(100, "Cũ", [1.0, 0.0]), (101, "", [0.0, 1.0])], schema)
    batch = [(1, "Cũ", [0.5, 0.5]), (2, "b", [0.95, 0.0]), (3, "c", [0.0, 1.0]), (4, "d", [0.3, 0.9]), (5, "e", [0.6, 0.8]), (6, "c", [-1.0, 0.0])]
    got = {r.id: r.status for r in ingestion.resolve(spark.createDataFrame(batch, schema), index).collect()}
    # 1: known label; 2: near 100; 3: near 101, which has no label; 4: near 3; 5: near 4 alone, which was refused; 6: label of 3
    assert got == {1: "duplicate", 2: "duplicate", 3: "accepted", 4: "duplicate", 5: "accepted", 6: "duplicate"}
    assert ingestion.resolve(spark.createDataFrame([], schema), index).count() == 0


def test_embedding_preview_and_udtf(spark):
    a, b, c = (one(spark, t, ingestion.embed) for t in ("Một hai", "hai một", None))
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(c)
    r = ingestion.preview(spark.createDataFrame([(1, DOCUMENT)], DOC)).first()
    assert r.label == "5/SYT — V/v khám" and r.n_chunks == len(r.chunks) > 0
    spark.udtf.register("split_document", chunking.SplitDocument)
    spark.createDataFrame([(1, DOCUMENT)], DOC).createOrReplaceTempView("given")
    assert spark.sql("SELECT c.chunk_index, c.text FROM given, LATERAL split_document(given.text) AS c").count() == len(chunking.chunk(DOCUMENT))


def test_documents_of_one_id_are_not_mixed_and_plans_stay_small(spark):
    """Two documents share an id, one has no chunk; the plan doesn't grow with the number of chunks that a document may have."""
    docs = spark.createDataFrame([(1, "Sở Y tế chủ trì việc này"), (1, "Ban A phối hợp việc này"), (2, None), (None, "Tổ B hỗ trợ việc này")], DOC)
    df = analysis.analyze(docs)
    got = sorted((str(r.doc_id), [t.don_vi for t in r.nhiem_vu]) for r in df.collect())
    assert got == [("1", ["Ban A"]), ("1", ["Sở Y tế"]), ("2", []), ("None", ["Tổ B"])]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") < 300 and "Join" not in plan
