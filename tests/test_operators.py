import io
import zipfile

from pyspark.sql import functions as F

from doclens.functions import predicates
from doclens.operators import chunking, extraction, index, ingestion, metadata, retrieval
from doclens.plans import prompts
from doclens.sources import files
from doclens.streaming import ingest

DOC = "doc_id long, text string"


def meta(spark, text):
    return metadata.extract_metadata(spark.createDataFrame([(1, text)], DOC)).first()


def test_metadata_traps(spark):
    split = meta(spark, "UBND TỈNH\nSố:\n1584\n/BHXH-QLT\nVề việc thu")
    assert split.so_van_ban == "1584/BHXH-QLT" and split.issuer == "UBND TỈNH"
    assert meta(spark, "Số: 12/2024/NĐ-CP\nx").so_van_ban == ""
    basis = meta(spark, "BỘ Y TẾ\nCăn cứ Luật A;\nI. Mục đầu\nthêm\n1. Dừng\nhết").can_cu
    assert basis == "Căn cứ Luật A; I. Mục đầu thêm"
    motto = meta(spark, "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\n**SỞ Y TẾ**\nSố: 5/SYT\nngày 1 tháng 2 năm 2024\nV/v khám bệnh\nKính gửi: ai")
    assert (motto.issuer, motto.so_van_ban, motto.ngay_ban_hanh, motto.tieu_de) == ("SỞ Y TẾ", "5/SYT", "ngày 1 tháng 2 năm 2024", "V/v khám bệnh")
    assert meta(spark, None).issuer == meta(spark, "").can_cu == ""


def test_predicates(spark):
    rows = [("SỞ Y TẾ báo cáo THE kết quả", True), ("theme isles", False)]
    got = spark.createDataFrame(rows, "t string, e boolean").select(predicates.contains_english(F.col("t")), "e").collect()
    assert all(a == b for a, b in got)
    weak = {"Điều 5. " + "x" * 300: True, "và một phần tiếp theo của câu trước đó": True, "Một câu đủ dài và đầy đủ ý nghĩa.": False, None: True}
    got = spark.createDataFrame([(t,) for t in weak], "t string").select("t", predicates.is_weak(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in got} == weak


def test_chunking():
    text = "Mở đầu văn bản này khá dài để không bị coi là yếu.\n" + "\n".join(f"Điều {i}. " + "nội dung " * 30 for i in range(1, 6))
    got = chunking.chunk(text)
    assert [c["split_by"] for c in got] == ["article"] * 6 and got[1]["header"].startswith("Điều 1.")
    long = "\n".join(f"Chương {k}\n" + "\n".join(f"Điều {i}. " + "chữ " * 200 for i in range(1, 8)) for k in ("I", "II"))
    assert len(chunking.chunk(long)) == 15 and chunking.chunk("") == [] and chunking.chunk("một dòng")[0]["split_by"] == "none"
    assert "".join("".join(c["text"] for c in chunking.chunk(long)).split()) == "".join(long.split())
    moved = chunking.chunk("Điều 1. " + "a " * 150 + "kèm theo mẫu:\nĐiều 2. Một câu. " + "b " * 150)
    assert moved[0]["text"] == "Điều 1. " + "a " * 149 + "a kèm theo mẫu: Điều 2." and moved[0]["header"] == moved[0]["text"][:120]
    assert moved[1]["text"].startswith("Một câu. b b") and moved[1]["header"].startswith("Điều 2. Một câu.")


def test_chunking_by_headings():
    body = "nội dung của mục này đủ dài để không bị bỏ đi. " * 6
    got = chunking.chunk(f"# Tên văn bản\n{body}\n#Một không cách\n{body}\n##\n##   \n## Nhỏ hơn\n{body}\n# Ngắn\nquá ngắn\n# {'Dài ' * 50}\n{body}")
    assert [(c["split_by"], c["level"], c["header"]) for c in got] == [("heading_md", 1, "Tên văn bản"), ("heading_md", 1, "Một không cách"), ("heading_md", 1, ("Dài " * 50).strip())]
    assert "## Nhỏ hơn" in got[1]["text"] and "quá ngắn" not in "".join(c["text"] for c in got)
    # Empty marks are no headings; the first heading's level doesn't count.
    assert chunking.chunk("#\n# \n" + body)[0]["split_by"] == "none"
    deep = chunking.chunk(f"# A\n{body}\n### B\n{body}\n## C\n{body}\n## D\n{body}")
    assert [(c["level"], c["header"]) for c in deep] == [(2, "A"), (2, "C"), (2, "D")]
    weak = chunking.chunk("Điều 1. " + "a " * 150 + "\nĐiều 2. " + "b " * 150)
    assert [c["level"] for c in weak] == [0, 0]


def test_rank_prefers_law_and_keeps_one_of_equal_beginnings(spark):
    rows = [(1, "law", 0.5, 1, 10, "x" * 200 + "a", ""), (1, "knowledge", 0.5, 1, 11, "x" * 200 + "b", ""), (1, "knowledge", 0.4, 2, 12, "y", "Điều 1")]
    df = spark.createDataFrame(rows, "query_id long, collection string, dist double, rank int, id long, text string, article string")
    assert [r.id for r in retrieval.rank_fused(df).orderBy("pos").collect()] == [12, 10]


def test_knn_in_blocks_and_without_queries(spark, monkeypatch):
    rows = spark.range(60).select("id", F.lit("law").alias("collection"), F.array((F.col("id") * 7 % 13).cast("double"), F.col("id").cast("double")).alias("v"))
    queries = rows.where("id < 9").select(F.col("id").alias("query_id"), "v")
    whole = sorted(map(tuple, retrieval.knn(queries, rows, 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, retrieval.knn(queries, rows, 3).select("query_id", "id", "rank").collect())) == whole and len(whole) == 27
    assert retrieval.knn(queries.limit(0), rows).count() == 0


def test_neighbours_of_odd_vectors_and_ids(spark):
    v = [("a", "law", [1.0, 0.0]), ("b", "law", [1.0, 0.1]), ("c", "law", None), ("d", "law", [float("nan"), 0.0]), ("e", "law", [1.0]), ("f", "law", [1.0, None]), (None, "law", [1.0, 0.2]), ("g", None, [1.0, 0.0]), ("b", "law", [1.0, 0.1])]
    corpus = spark.createDataFrame(v, "id string, collection string, v array<double>").repartition(3)
    queries = spark.createDataFrame([("a", [1.0, 0.0]), (None, [1.0, 0.2]), ("z", None), ("y", [2.0]), ("x", [])], "query_id string, v array<double>")
    got = sorted((str(r.query_id), str(r.collection), r["rank"], str(r.id), round(r.dist, 6)) for r in retrieval.knn(queries, corpus, 2).collect())
    assert got == [("None", "None", 1, "g", 0.04), ("None", "law", 1, "None", 0.0), ("None", "law", 2, "b", 0.01), ("a", "None", 1, "g", 0.0), ("a", "law", 1, "b", 0.01), ("a", "law", 2, "b", 0.01), ("y", "law", 1, "e", 1.0)]
    near = sorted((str(r.query_id), str(r.id)) for r in retrieval.within(queries, corpus, 0.95).collect())
    assert near == [("None", "None"), ("None", "a"), ("None", "b"), ("None", "b"), ("None", "g"), ("a", "None"), ("a", "b"), ("a", "b"), ("a", "g")]


def test_neighbours_as_by_brute_force_with_ties(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (400, 4)).astype(float)
    rows = spark.createDataFrame([(i, "ab"[i % 2], x[i].tolist()) for i in range(400)], "id long, collection string, v array<double>").repartition(5)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 37)
    want = []
    for q in range(0, 400, 50):
        for c in "ab":
            own = sorted((((x[q] - x[i]) ** 2).sum(), i) for i in range(400) if i != q and "ab"[i % 2] == c)[:5]
            want += [(q, c, n + 1, i, d) for n, (d, i) in enumerate(own)]
    got = retrieval.knn(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), rows, 5)
    assert sorted((r.query_id, r.collection, r["rank"], r.id, r.dist) for r in got.collect()) == want


def test_stream_with_documents_without_a_source(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "index")
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    spark.createDataFrame([(1, None, "law", say(1)), (2, None, "law", say(2)), (3, "A", "law", say(3))], "doc_id long, source string, collection string, text string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    ingest.start(spark.readStream.schema(schema).parquet(src), path, str(tmp_path / "cp")).awaitTermination()
    assert sorted(str(r.source) for r in index.read(spark, path).collect()) == ["A", "None", "None"]
    other = str(tmp_path / "other")
    for k in range(2):
        ingest.start(spark.readStream.schema(schema).parquet(src), other, str(tmp_path / f"cp{k}"), ingestion.embed).awaitTermination()
    assert index.read(spark, other).count() == 1  # all are without a header, so they have one label


def test_index_delete_and_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "index")
    rows = [(1, "A", "law", "Điều 1. " + "chữ " * 90 + "\nĐiều 2. " + "chữ " * 90), (2, "B", "knowledge", "một văn bản ngắn nhưng đủ dài."), (3, "A", "law", "bản sao cùng nhãn")]
    df = spark.createDataFrame(rows, "doc_id long, source string, collection string, text string")
    for _ in range(2):  # the second time brings nothing new
        df.write.mode("append").parquet(src)
        ingest.start(spark.readStream.schema(df.schema).parquet(src), path, str(tmp_path / "cp")).awaitTermination()
        assert sorted(map(tuple, index.count_by_source(index.read(spark, path)).collect())) == [("A", 2), ("B", 1)]
    assert index.delete_by_source(spark, path, "law", "A") == 2 and index.delete_by_source(spark, path, "law", "A") == 0
    assert [r.source for r in index.read(spark, path).collect()] == ["B"]


def test_sources_feedback_and_answers(spark, tmp_path):
    data = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>Mục</w:t></w:r></w:p><w:p><w:r><w:t>Chữ</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_bytes("một\r\nhai".encode())
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="Tiu3"><w:name w:val="heading 3"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {ns}><w:body>' + "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in (("Heading2", "Hai"), ("Tiu3", "Ba"), ("Normal", "Chữ"))) + "</w:body></w:document>")
    (tmp_path / "e.docx").write_bytes(data.getvalue())
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.docx").write_text("broken")
    got = {r.path[-6:]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["e.docx"].text == "## Hai\n### Ba\nChữ"
    assert got["a.docx"].text == "## Mục\nChữ" and got["/b.txt"].text == "một\nhai"
    assert got["/c.xyz"].error == "Unsupported file format" and "BadZipFile" in got["d.docx"].error
    log = spark.createDataFrame([("q", "a", "positive", None)], "question string, answer string, feedback string, time timestamp")
    files.append_feedback(log, str(tmp_path / "log"))
    files.append_feedback(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    asked = spark.createDataFrame([(1, "gì?"), (2, "sao?")], "query_id long, question string")
    context = spark.createDataFrame([(1, "ngữ cảnh")], "query_id long, context string")
    out = {r.query_id: r for r in prompts.answer(asked, context, lambda ps: [f" {len(p) > 20} " for p in ps]).collect()}
    assert out[1].answer == "True" and out[2].answer == prompts.NO_CONTEXT and not out[2].has_context


def test_an_english_answer_is_asked_for_once_more(spark, tmp_path):
    flag = tmp_path / "asked"

    def model(ps):
        first = not flag.exists()
        if ps:
            flag.touch()
        return ["the answer is for this activity " * 5 if first else "Kết quả: bỏ\nTrả lời  bằng tiếng Việt" for _ in ps]

    asked = spark.createDataFrame([(1, "gì?")], "query_id long, question string")
    context = spark.createDataFrame([(1, "ngữ cảnh")], "query_id long, context string")
    assert prompts.answer(asked, context, model).first().answer == "Trả lời bằng tiếng Việt"


def test_rules(spark):
    text = "Bắt đầu từ ngày 1/2/2024. Gửi báo cáo trước 5/6/2024; trong thời hạn 10 ngày kể từ khi nhận. Kinh phí do đơn vị tự lo. Tại phường 5, điểm a"
    r = extraction.rules(spark.createDataFrame([(1, text)], DOC)).first()
    assert r.start == "từ 1/2/2024" and r.kinh_phi == "Kinh phí do đơn vị tự lo" and r.deadlines == ["Gửi báo cáo trước 5/6/2024", "trong thời hạn 10 ngày kể từ khi nhận"]
    df = spark.createDataFrame([("Tại quận 1; khoản 2 điều 3, phường 5",), ("mục 3",)], "t string")
    assert [x[0] for x in df.select(extraction.clean_place(F.col("t"))).collect()] == ["Tại quận 1; phường 5", "không nói rõ"]
