"""Text helpers as column expressions. Patterns carry the flags that give them Unicode classes and \\n as the only line end."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

U = "(?Ud)"
UI = "(?iuUd)"
UNKNOWN = "không nói rõ"
MARK = "\u0001"


def let(c: Column, use) -> Column:
    """use(c) with c computed once, however often use (or a lambda in it) names it."""
    return F.transform(F.array(c), use)[0]


@cache
def by_rows(f: Callable, kind: str) -> Callable[..., Column]:
    """f of one value of each column, as a function of columns that gives `kind`; what f gets is what Arrow makes of it (arrays are lists, structs are dicts)."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def rows(*columns: pa.Array) -> pa.Array:
        # Only some rows at a time are Python objects: batches of long texts are large.
        parts = [pa.array(list(map(f, *(c.slice(i, 256).to_pylist() for c in columns))), arrow) for i in range(0, len(columns[0]), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return rows


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?Ud)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?Ud)\s+", " ")


def normalized_lines(c: Column) -> Column:
    """The lines with single spaces, trimmed; blank ones are dropped."""
    return F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(one_space(x))), lambda x: x != "")


def strip_markdown(c: Column) -> Column:
    """Without the quote and heading marks of lines, and without asterisks."""
    quoted = F.regexp_replace(c, r"(?md)^>[\s&&[^\n]]*", "")
    return F.replace(F.regexp_replace(quoted, r"(?md)^#{1,6}[\s&&[^\n]]*", ""), F.lit("*"), F.lit(""))


def first_match(lines: Column, pattern: str, upto: int | None = None) -> Column:
    """The number from 1 of the first line (of the first `upto`) with the pattern; null if none."""
    some = F.slice(lines, 1, upto) if upto else lines
    return F.try_element_at(F.filter(F.transform(some, lambda x, i: F.when(x.rlike(pattern), i + 1)), lambda x: x.isNotNull()), F.lit(1)).cast("int")


def extract(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def title_head(c: Column) -> Column:
    """Of the first five lines those of 4 to 99 characters, each after a space."""
    lines = F.filter(F.transform(F.slice(F.split(strip(c), "\n", -1), 1, 5), strip), lambda x: (F.length(x) > 3) & (F.length(x) < 100))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(" "), x)), "")


#: Beginnings of lines that repeat a prompt.
ECHOES = ("ví dụ", "input:", "output:", "kết quả tốt", "kết quả:", "các ý đầu vào", "các ý cần gộp")


def without_echoes(c: Column) -> Column:
    """A reply in one line, without lines and labels that repeat the prompt, arrows before lines and [TAGS]."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r]", -1), strip), lambda x: (x != "") & ~F.lower(x).rlike(rf"\A(?:{'|'.join(ECHOES)})"))
    text = F.array_join(F.transform(lines, lambda x: strip(F.ltrim(x, F.lit("→")))), " ")
    bare = F.regexp_replace(F.regexp_replace(text, rf"{UI}\b(?:Kết quả tốt|Kết quả|Ví dụ|Input|Output)\s*:\s*", ""), r"\[[A-Z_]+\]", "")
    return strip(one_space(bare))
