"""Header metadata of administrative documents, as column expressions over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.text import MARK, UI, U, extract, first_match, normalized_lines, one_space, strip, strip_markdown
from doclens.operators.chunking import PATTERNS

NUMBER_LINE = rf"{UI}^số\s*:|^\d{{1,6}}\s*/\s*[A-ZĐ\-]+|^/[A-ZĐ\-]+"
NUMBER = rf"{UI}số\s*:\s*(\d{{1,6}})\s*/\s*([A-ZĐ\-]+)"
DATE = rf"{UI}ngày\s+\d{{1,2}}\s+tháng\s+\d{{1,2}}\s+năm\s+\d{{4}}"
IGNORED = rf"{UI}CỘNG HÒA|Độc lập|Hạnh phúc|Kính gửi|ngày\s+\d{{1,2}}\s+tháng"
ORGANISATION = rf"{UI}\b(?:BỘ|BHXH|BẢO HIỂM XÃ HỘI|UBND|SỞ|CỤC|BAN)\b"
BASIS_STOP = rf"{UI}^(?:kính gửi\s*:|phạm vi\b|nội dung\b|điều\s+\d+\b|(?:mục|chương|phần)\s+[ivxlc]+\b|[ivxlc]+[.)]\b|[A-Z][.):\-]\b|\d+\.\d+\b|\d+\.)"
TITLE_STOP = rf"{UI}^(?:kính gửi\s*:|căn cứ\b|nơi nhận\s*:|phạm vi\b|điều\s+\d+\b)"


def without_motto(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iuUds)\*{0,2}CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\*{0,2}.*?Hạnh phúc", "")


def issuer(lines: Column) -> Column:
    """Of the lines above the number (else the first 12), those that name an organisation: the first two if they are short, else the first."""
    end = F.coalesce(first_match(lines, NUMBER_LINE, 20) - 1, F.lit(12))
    own = F.filter(F.slice(lines, F.lit(1), end), lambda x: ~x.rlike(IGNORED) & x.rlike(ORGANISATION))
    one, two = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(2))
    return F.when((F.length(one) <= 25) & (F.length(two) <= 80), F.concat_ws(" ", one, two)).otherwise(F.coalesce(one, F.lit("")))


def document_number(lines: Column) -> Column:
    """From one line (Số: 12/AB), or from three: "Số:", the digits, the code; of the first 20 lines the first that has either."""
    at = F.slice(lines, 1, 20)
    nth = lambda i: F.coalesce(F.try_element_at(lines, i), F.lit(""))

    def of(x: Column, i: Column) -> Column:
        digits, code = extract(nth(i + 2), rf"{U}(\d{{1,6}})", 1), extract(nth(i + 3), rf"{UI}/?\s*([A-ZĐ\-]{{3,}})", 1)
        return F.when(x.rlike(NUMBER), F.concat_ws("/", extract(x, NUMBER, 1), extract(x, NUMBER, 2))).when(x.rlike(rf"{UI}^số\s*:?$") & (digits != "") & (code != ""), F.concat_ws("/", digits, code))

    return F.coalesce(F.try_element_at(F.filter(F.transform(at, of), lambda x: x.isNotNull()), F.lit(1)), F.lit(""))


def issue_date(text: Column) -> Column:
    return extract(text, DATE)


def title(lines: Column) -> Column:
    """From the first of the 12 lines after the number or date that starts "V/v" or "Về", up to a stop line or 140 characters."""
    last = F.array_max(F.transform(F.slice(lines, 1, 12), lambda x, i: F.when(x.rlike(NUMBER_LINE) | x.rlike(DATE), i + 1)))
    start = F.coalesce(last, first_match(lines, rf"{UI}^(?:V/v|Về)", 20) - 1)
    window = F.slice(lines, start + 1, F.lit(12))
    begin = first_match(window, rf"{UI}^(?:V/v|Về)")
    rest = F.slice(window, begin, F.lit(12))
    stop = F.coalesce(first_match(rest, TITLE_STOP) - 1, F.size(rest))
    kept = F.aggregate(F.slice(rest, F.lit(1), stop), F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.length(acc) + 1 + F.length(x) <= 140, F.concat_ws(" ", acc, x)).otherwise(acc))
    return F.coalesce(kept, F.lit(""))


def legal_basis(lines: Column) -> Column:
    """From the first line that starts "Căn cứ" to the line before the next stop line."""
    start = first_match(lines, rf"{UI}^căn\s+cứ\b")
    rest = F.slice(lines, start + 1, F.size(lines))
    stop = F.coalesce(first_match(rest, BASIS_STOP) - 1, F.size(rest))
    return F.coalesce(one_space(F.trim(F.concat_ws(" ", F.try_element_at(lines, start), F.array_join(F.slice(rest, F.lit(1), stop), " ")))), F.lit(""))


def body(text: Column, safe: bool = False) -> Column:
    """The text without its header, and without blank lines.

    It starts at the first heading (#) that isn't empty or the motto's last line; without headings, at the line of the first match of the
    first chunk pattern, in their order, that matches at all: so a late chapter comes before an early article. Without either, only the
    last line is left ('' if the text ends with a line end). With `safe` it starts at the earliest match of any pattern, and all stays without one.
    """
    lines = F.split(text, "\n", -1)
    heading = first_match(F.transform(lines, lambda x: F.when(x.startswith("#"), F.lower(strip(F.ltrim(x, F.lit("#"))))).otherwise("")), r"\A(?!độc lập - tự do - hạnh phúc\z).")
    starts = []
    for _, pattern, fold in PATTERNS:
        p = (UI if fold else U) + "(?m)" + pattern
        before = F.substring_index(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), p, MARK), MARK, 1)
        starts.append(F.when(text.rlike(p), F.size(F.split(before, "\n", -1))))
    at = F.coalesce(heading, F.least(*starts), F.lit(1)) if safe else F.coalesce(heading, *starts, F.size(lines))
    return strip(F.array_join(F.filter(F.slice(lines, at, F.greatest(F.size(lines), F.lit(1))), lambda x: strip(x) != ""), "\n"))


def extract_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, issuer, so_van_ban, ngay_ban_hanh, tieu_de, can_cu, clean_text, body_text) of each document; '' for what is missing. One pass, no shuffle."""
    clean = without_motto(F.coalesce(F.col(text_col), F.lit("")))
    plain = without_motto(strip_markdown(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.col(id_col), clean.alias("clean_text"), plain.alias("plain")).withColumn("lines", normalized_lines(F.col("plain")))
    lines = F.col("lines")
    header = {"issuer": issuer(lines), "so_van_ban": document_number(lines), "ngay_ban_hanh": issue_date(F.col("plain")), "tieu_de": title(lines), "can_cu": legal_basis(lines)}
    return rows.select(id_col, *[c.alias(n) for n, c in header.items()], "clean_text", body(F.col("clean_text")).alias("body_text"))
