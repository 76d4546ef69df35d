"""Predicates on chunks and documents, and small projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions.text import UI, U, strip

#: Words that mark an answer as English.
ENGLISH = ("the", "and", "this", "that", "is", "are", "activity", "funded", "from", "for", "with", "summary")
UNTITLED = "Văn bản không rõ tiêu đề"


#: The shapes of chunks. Patterns are read by Spark's and Python's regular expressions alike; those that end in _ANY ignore case.
CONTINUED = r"^(?:và |hoặc |, |; |\. |: |\))"
SMALL = r"^[a-zà-ỹđ]"
LISTED = r"^[a-z]\d*[).]\s+"
DECORATION = r"^[>#*\s]+"
REFERRING_ANY = r"\b(?:mẫu số|phụ lục|biểu số)\s*:\s*$"
OPEN_ENDS = (":", "(", "-", "/")
SECTION_ANY = r"^(?:Phần|Chương)\s+(?:[IVXLC]+|\d+)\b|^Điều\s+\d+\b"
SECTION = r"^(?:#{1,6}\s+\S|[IVXLC]+[.)]\s+|\d+\.\d+\b|\d+\.\s+|[a-z]\d*[).]\s+|[A-Z][.):\-]\s+)"
SHORTEST, BAREST = 24, 10


def contains_english(c: Column) -> Column:
    return c.rlike(rf"{UI}\b(?:{'|'.join(ENGLISH)})\b")


def is_weak(c: Column) -> Column:
    """A broken, cut or very short chunk. The range à-ỹ has capitals too, such as Đ."""
    t = strip(F.coalesce(c, F.lit("")))
    return (F.length(t) < SHORTEST) | t.rlike(U + CONTINUED) | (t.rlike(U + SMALL) & ~t.rlike(U + LISTED)) | (F.length(F.regexp_replace(t, U + DECORATION, "")) < BAREST)


def ends_with_connector(c: Column) -> Column:
    bare = F.regexp_replace(c, rf"{U}\s+$", "")
    return c.rlike(UI + REFERRING_ANY) | F.right(bare, F.lit(1)).isin(*OPEN_ENDS)


def starts_section(c: Column) -> Column:
    t = strip(c)
    return t.rlike(UI + SECTION_ANY) | t.rlike(U + SECTION)


def article_tag(c: Column) -> Column:
    return F.regexp_extract(c, rf"{UI}(Điều\s+\d+)", 1)


def source_label(number: Column, title: Column, issuer: Column) -> Column:
    """Number and the title's first 80 characters, as far as present; else the issuer; else a constant."""
    parts = F.concat_ws(" — ", F.nullif(number, F.lit("")), F.nullif(F.substring(title, 1, 80), F.lit("")))
    return F.when(parts != "", parts).when(issuer != "", F.substring(issuer, 1, 80)).otherwise(UNTITLED)
