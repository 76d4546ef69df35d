"""Prompts as columns, and answers by an injectable generator. The wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.predicates import contains_english
from doclens.functions.text import without_echoes
from doclens.plans import replies

NO_CONTEXT = "Không tìm thấy tài liệu liên quan."
QA_HEAD = "Bạn là trợ lý pháp lý. Chỉ trả lời bằng tiếng Việt và chỉ dựa trên ngữ cảnh.\n\nCâu hỏi:\n"


def qa_prompt(question: Column, context: Column) -> Column:
    has = F.coalesce(context, F.lit("")) != ""
    return F.concat(F.lit(QA_HEAD), question, F.lit("\n\nNgữ cảnh:\n"), F.when(has, context).otherwise(NO_CONTEXT))


def answer(questions: DataFrame, contexts: DataFrame, model: replies.Model, store: str | None = None) -> DataFrame:
    """(query_id, answer, context, has_context): the model isn't asked without a context.

    Replies are cleaned of what repeats the prompt; one of over 100 characters with English in it is asked for once more, and the second counts.
    Equal prompts are asked once, and those that `store` has a reply to not at all; where the model fails, the answer says that nothing was found.
    """
    rows = questions.join(contexts, "query_id", "left").withColumn("has_context", F.coalesce("context", F.lit("")) != "")
    rows = replies.asked(rows.withColumn("prompt", F.when(F.col("has_context"), qa_prompt(F.col("question"), F.col("context")))), "prompt", "reply", model, store)
    rows = rows.withColumn("reply", F.when(F.col("reply").isNotNull(), without_echoes(F.col("reply"))))
    foreign = contains_english(F.col("reply")) & (F.length("reply") > 100)
    rows = replies.asked(rows.withColumn("again", F.when(foreign, F.col("prompt"))), "again", "second", model, store, attempt=1)
    said = F.when(F.col("again").isNotNull(), without_echoes(F.col("second"))).otherwise(F.col("reply"))
    return rows.select("query_id", F.coalesce(said, F.lit(NO_CONTEXT)).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), "has_context")


def documents_context(texts: Column) -> Column:
    """A list of texts as numbered blocks; the sentence for no context if there are none."""
    blocks = F.transform(texts, lambda x, i: F.concat(F.lit("[Tài liệu "), (i + 1).cast("string"), F.lit("]\n"), x))
    return F.when(F.size(texts) > 0, F.array_join(blocks, "\n\n")).otherwise(NO_CONTEXT)


def extraction_prompt(chunk: Column) -> Column:
    schema = '{"nhiem_vu": [{"don_vi": "", "noi_dung": "", "vai_tro": ""}], "thoi_gian": "", "kinh_phi": "", "dia_diem": "", "tom_tat": "", "luu_y": ""}'
    return F.concat(F.lit(f"Đọc đoạn văn bản và chỉ trả về một đối tượng JSON theo mẫu {schema}. Điều gì văn bản không nêu thì ghi \"không nói rõ\".\n<doan>\n"), chunk, F.lit("\n</doan>"))


def steps_prompt(tasks: Column) -> Column:
    items = F.transform(tasks, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". ["), t["vai_tro"], F.lit("] "), t["don_vi"], F.lit(": "), t["noi_dung"]))
    return F.concat(F.lit('Sắp xếp các nhiệm vụ sau thành quy trình, chỉ trả về mảng JSON [{"buoc": 1, "hanh_dong": "", "don_vi": ""}].\n'), F.array_join(items, "\n"))


def summary_prompt(record: Column) -> Column:
    items = F.transform(record["nhiem_vu"], lambda t: F.concat(F.lit("- "), t["don_vi"], F.lit(" ("), t["vai_tro"], F.lit("): "), t["noi_dung"]))
    fields = [F.concat(F.lit(label), record[n]) for label, n in (("Thời gian: ", "thoi_gian"), ("Kinh phí: ", "kinh_phi"), ("Địa điểm: ", "dia_diem"))]
    return F.concat(F.lit("Viết một đoạn tóm tắt bằng tiếng Việt từ các ý sau.\n"), F.array_join(F.concat(items, F.array(*fields)), "\n"))


def suggestion_prompt(analysis: Column, context: Column) -> Column:
    """For a document's analysis (as JSON text) and the related chunks."""
    return F.concat(F.lit('Dựa trên phân tích và tài liệu liên quan, chỉ trả về JSON {"can_cu_phap_ly": [], "khuyen_nghi": []}.\nPhân tích:\n'), analysis, F.lit("\n\nTài liệu liên quan:\n"), context)
