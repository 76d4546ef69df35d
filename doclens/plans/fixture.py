"""Administrative documents made of the order tables: one per order, with header, legal basis and an article per line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _items(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Line items with i, their number within `by`, and the article made of each."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    w = Window.partitionBy(by).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    qty, supp = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string")
    role = F.element_at(F.array(F.lit("chủ trì"), F.lit("phối hợp"), F.lit("hỗ trợ")), (F.col("i") % 3 + 1).cast("int"))
    line = F.concat(F.lit("Điều "), F.col("i").cast("string"), F.lit(". Phòng Nghiệp vụ "), supp, F.lit(" "), role, F.lit(" rà soát "), qty, F.lit(" hồ sơ tại địa bàn "), supp, F.lit("; báo cáo trước ngày "), F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit(". Kinh phí từ ngân sách đơn vị "), qty, F.lit("."))
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("i", F.row_number().over(w)).withColumn("line", line)


def _joined(rows: DataFrame, by: str, order: str, text: str, into: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("x")).select(by, F.array_join("x.t", "\n").alias(into))


def chapter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation as its sections: a chapter for each customer, an article for each line item. Chapters and documents are longer than a chunk may be."""
    items = _items(spark, sf_dir, "c_custkey").withColumn("doc_id", F.col("c_nationkey").cast("long"))
    lines = items.groupBy("c_custkey", "doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))
    return lines.select("doc_id", F.col("c_custkey").alias("pos"), F.concat(F.lit("Chương "), F.col("c_custkey").cast("string"), F.lit("\n"), F.array_join("x.line", "\n")).alias("text"))


def heading_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document for each order; every third section is too short to stay."""
    items = _items(spark, sf_dir, "l_orderkey")
    mark = F.concat(F.lit("## Mục "), F.col("i").cast("string"), F.lit("\n"))
    rows = items.withColumn("section", F.when(F.col("i") % 3 == 0, F.concat(mark, F.lit("ngắn."))).otherwise(F.concat(mark, F.col("line"), F.lit("\n"), F.col("line"))))
    head = F.concat(F.lit("# Văn bản "), F.col("l_orderkey").cast("string"), F.lit("\n"), F.lit(PREAMBLE), F.lit("\n"))
    return _joined(rows, "l_orderkey", "i", "section", "body").select(F.col("l_orderkey").alias("doc_id"), F.concat(head, F.col("body")).alias("text"))


PREAMBLE = "Phần mở đầu của văn bản này đủ dài để được giữ lại như một đoạn riêng, trước các mục có tiêu đề; " * 3


FILLER = "nội dung chi tiết của phần này được trình bày đầy đủ trong hồ sơ kèm theo và áp dụng thống nhất, " * 2


def long_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: an article for each line item, each long enough to be a chunk of its own; numbers have leading zeros, so that none is part of another."""
    items = _items(spark, sf_dir, "l_orderkey")
    qty, supp = F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    role = F.element_at(F.array(F.lit("chủ trì"), F.lit("phối hợp"), F.lit("hỗ trợ")), (F.col("i") % 3 + 1).cast("int"))
    line = F.concat(F.lit("Điều "), F.col("i").cast("string"), F.lit(". Phòng Nghiệp vụ "), supp, F.lit(" "), role, F.lit(" rà soát hồ sơ tại địa bàn "), supp, F.lit("; báo cáo trước ngày "), F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit(". Kinh phí từ ngân sách đơn vị "), qty, F.lit(". "), F.lit(FILLER))
    return _joined(items.withColumn("line", line), "l_orderkey", "i", "line", "text").withColumnRenamed("l_orderkey", "doc_id")


def motto_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """admin_docs below a motto and blank lines, with no-break spaces in the title."""
    title = F.regexp_replace("text", "V/v rà soát mức", "V/v\u00a0rà  soát\u00a0 mức")
    head = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\n\n \n"
    return admin_docs(spark, sf_dir).select("doc_id", F.concat(F.lit(head), F.replace(title, F.lit("\nKính gửi"), F.lit("\n\n\u00a0\nKính gửi"))).alias("text"))


def plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text without header and markers for each order; every other one ends with a line end."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    end = F.when(F.col("o_orderkey") % 2 == 0, "\n").otherwise("")
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("dòng đầu\ndòng giữa "), "o_orderpriority", F.lit("\nhạng "), "o_orderstatus", end).alias("text"))


def arriving_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six documents for each nation, in order of doc_id: a first one, one of its number and title, one of its words under another number, an other one, one without header, and an empty one."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    word = lambda kind, i: F.substring(F.md5(F.concat(F.col("n_name"), F.lit(f"{kind}{i}"))), 1, 8)
    words = lambda kind: F.concat_ws(" ", *[word(kind, i) for i in range(40)])
    head = lambda n: F.concat(F.lit("Số: "), (F.col("n_nationkey") + n).cast("string"), F.lit("/UBND-TH\nV/v rà soát "), "n_name", F.lit("\nĐiều 1. "))
    texts = [F.concat(head(100), words("a")), F.concat(head(100), words("b")), F.concat(head(200), words("a")), F.concat(head(300), words("c")), words("d"), F.lit("")]
    made = rows.select("n_nationkey", F.posexplode(F.array(*texts)).alias("v", "text"))
    return made.select((F.col("n_nationkey") * 6 + F.col("v")).cast("long").alias("doc_id"), F.lit("law").alias("collection"), "text")


def admin_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    qty, supp = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string")
    role = F.element_at(F.array(F.lit("chủ trì"), F.lit("phối hợp"), F.lit("hỗ trợ")), (F.col("i") % 3 + 1).cast("int"))
    line = F.concat(F.lit("Điều "), F.col("i").cast("string"), F.lit(". Phòng Nghiệp vụ "), supp, F.lit(" "), role, F.lit(" rà soát "), qty, F.lit(" hồ sơ tại địa bàn "), supp, F.lit("; báo cáo trước ngày "), F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit(". Kinh phí từ ngân sách đơn vị "), qty, F.lit("."))
    items = read("lineitem").withColumn("i", F.row_number().over(w)).select("l_orderkey", F.struct("i", line.alias("line")).alias("x"))
    bodies = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select("l_orderkey", F.array_join("x.line", "\n").alias("body"))
    date = F.col("o_orderdate")
    head = F.concat_ws(
        "\n",
        F.lit("BỘ TÀI CHÍNH"),
        F.concat(F.lit("BHXH "), "n_name"),
        F.concat(F.lit("Số: "), F.col("o_orderkey").cast("string"), F.lit("/BHXH-QLT")),
        F.concat(F.lit("ngày "), F.dayofmonth(date).cast("string"), F.lit(" tháng "), F.month(date).cast("string"), F.lit(" năm "), F.year(date).cast("string")),
        F.concat(F.lit("V/v rà soát mức "), "o_orderpriority"),
        F.concat(F.lit("Kính gửi: "), "c_name"),
        F.concat(F.lit("Căn cứ Luật số "), F.col("c_nationkey").cast("string"), F.lit(";")),
    )
    orders = read("orders").join(bodies, F.col("o_orderkey") == F.col("l_orderkey"))
    named = orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("o_orderkey").alias("doc_id"), F.concat_ws("\n", head, "body").alias("text"))


SQL = """items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem),
bodies AS (SELECT l_orderkey, string_agg('Điều ' || i || '. Phòng Nghiệp vụ ' || l_suppkey || ' ' || CASE i % 3 WHEN 0 THEN 'chủ trì' WHEN 1 THEN 'phối hợp' ELSE 'hỗ trợ' END || ' rà soát ' || l_quantity::INT || ' hồ sơ tại địa bàn ' || l_suppkey || '; báo cáo trước ngày ' || strftime(l_shipdate, '%d/%m/%Y') || '. Kinh phí từ ngân sách đơn vị ' || l_quantity::INT || '.', chr(10) ORDER BY i) AS body FROM items GROUP BY l_orderkey),
admin_docs AS (SELECT o_orderkey AS doc_id, 'BỘ TÀI CHÍNH' || chr(10) || 'BHXH ' || n_name || chr(10) || 'Số: ' || o_orderkey || '/BHXH-QLT' || chr(10) || 'ngày ' || day(o_orderdate) || ' tháng ' || month(o_orderdate) || ' năm ' || year(o_orderdate) || chr(10) || 'V/v rà soát mức ' || o_orderpriority || chr(10) || 'Kính gửi: ' || c_name || chr(10) || 'Căn cứ Luật số ' || c_nationkey || ';' || chr(10) || body AS text
  FROM orders JOIN bodies ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

def items_sql(by: str) -> str:
    """The articles of _items in DuckDB's SQL, numbered within `by`."""
    return f"""items AS (SELECT *, 'Điều ' || i || '. Phòng Nghiệp vụ ' || l_suppkey || ' ' || CASE i % 3 WHEN 0 THEN 'chủ trì' WHEN 1 THEN 'phối hợp' ELSE 'hỗ trợ' END || ' rà soát ' || l_quantity::INT || ' hồ sơ tại địa bàn ' || l_suppkey || '; báo cáo trước ngày ' || strftime(l_shipdate, '%d/%m/%Y') || '. Kinh phí từ ngân sách đơn vị ' || l_quantity::INT || '.' AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""
