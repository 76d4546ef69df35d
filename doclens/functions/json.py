"""Fields out of model replies that hold JSON, maybe fenced or amid prose. No user code: variants say what is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions.text import UNKNOWN, strip

MARKS = "[*#>`_~]+"


def plain(c: Column) -> Column:
    """Without Markdown's marks, trimmed."""
    return strip(F.regexp_replace(c, MARKS, ""))


def _parsed(reply: Column, around: str) -> Column:
    bare = strip(reply)
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"\A```(?:json)?\s*", ""), r"\s*```\z", "")).otherwise(bare)
    whole = F.try_parse_json(bare)
    part = F.try_parse_json(F.nullif(F.regexp_extract(bare, f"(?s){around}", 0), F.lit("")))
    return F.coalesce(whole, part)


def json_object(reply: Column) -> Column:
    """The reply's object as a variant: all of it, else from its first { to its last }. Null if that is no JSON object."""
    v = _parsed(reply, r"\{.*\}")
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def json_array(reply: Column) -> Column:
    """The reply's array as array<variant>: all of it, else from its first [ to its last ]. Null if that is no JSON array."""
    bare = F.try_variant_get(_parsed(reply, r"\[.*\]"), "$", "array<variant>")
    inner = F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")))
    return F.coalesce(bare, F.try_variant_get(inner, "$", "array<variant>"))


def string(v: Column, field: str) -> Column:
    """A field as trimmed text; '' for one that is missing, null or nested."""
    return strip(F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("")))


def text_value(v: Column, field: str) -> Column:
    """A field, a list's items joined by "; ", without Markdown's marks; the constant for unknown if nothing is left."""
    items = F.try_variant_get(v, f"$.{field}", "array<string>")
    listed = F.array_join(F.filter(F.transform(items, strip), lambda x: x != ""), "; ")
    found = plain(F.coalesce(listed, string(v, field)))
    return F.when(found == "", UNKNOWN).otherwise(found)
