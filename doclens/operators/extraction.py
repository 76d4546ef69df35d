"""Rule-based fields of administrative texts, as column expressions.

Deadlines and tasks go over the matches of a text one after the other, each against those before it: they are small Python functions over Arrow batches, as Spark
interprets such steps (lambdas in lambdas, with a regular expression each) at milliseconds a text. One match and its clean-up are Spark's own functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions.text import MARK, UI, U, UNKNOWN, by_rows, extract, one_space, strip

DATE = r"\d{1,2}/\d{1,2}/\d{4}"
#: The shapes of deadlines, in order.
DEADLINES = (
    rf"báo\s*cáo[^.;\n]{{0,80}}?trước\s+(?:ngày\s+)?{DATE}",
    rf"gửi[^.;\n]{{0,80}}?trước\s+(?:ngày\s+)?{DATE}",
    rf"tổng\s*hợp[^.;\n]{{0,80}}?trước\s+(?:ngày\s+)?{DATE}",
    r"trong\s+thời\s+hạn\s+\d+\s*(?:ngày|tháng)[^.;\n]*",
    r"sau\s+\d+\s*(?:ngày|tháng)[^.;\n]*",
    r"\d+\s*(?:ngày|tháng)\s+kể\s+từ[^.;\n]*",
    rf"trước\s+(?:ngày\s+)?{DATE}",
    rf"(?:muộn\s+nhất|chậm\s+nhất)\s+là\s+ngày\s+{DATE}",
    rf"thời\s+điểm\s+{DATE}",
)
#: What a text must have, in small letters, for each of these to match at all.
DEADLINE_WORDS = ("trước", "gửi", "hợp", "thời", "au", "kể", "trước", "nhất", "điểm")
REPORTS = rf"{UI}\b(?:báo cáo|tổng hợp|gửi)\b"
#: The role of each verb, the role of others, and words of which one is in a unit's name.
ROLE_VERBS = {"chủ trì": "chủ trì", "phối hợp": "phối hợp", "thực hiện": "thực hiện", "chịu trách nhiệm": "chủ trì", "có trách nhiệm": "thực hiện", "hỗ trợ": "hỗ trợ"}
ROLE = "thực hiện"
ORGANISATIONS = ("BHXH", "Bảo hiểm", "UBND", "Sở", "Phòng", "Bộ phận", "Bộ", "Cục", "Ban", "Tổ", "Đội", "Chi cục", "Trung tâm", "Tổng cục", "Hội đồng", "Công an", "Liên đoàn", "Tòa", "Viện", "cơ quan")
BUDGET = r"(kinh phí[^.;\n]*|nguồn chi[^.;\n]*|ngân sách[^.;\n]*)"
PLACE = r"(?:trên địa bàn|tại|trên phạm vi)\s+([^.;\n]{3,140})"
START = rf"(?:từ ngày|bắt đầu từ ngày)\s*({DATE})"
#: What a place can't begin with.
JUNK = rf"{UI}^(?:điểm \d|tiết [a-z]|khoản \d|mục \d|phần mềm|đường dẫn|mẫu số|báo cáo tình|hội nghị đảm bảo|từ báo cáo)"


def or_unknown(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\z", UNKNOWN)


def start_date(c: Column) -> Column:
    return F.regexp_replace(extract(c, UI + START, 1), r"\A(?=.)", "từ ")


def budget(c: Column) -> Column:
    return or_unknown(F.trim(extract(c, UI + BUDGET, 1)))


def place(c: Column) -> Column:
    return or_unknown(F.btrim(extract(c, UI + PLACE, 1), F.lit(" ,")))


_SHAPES = tuple((w, re.compile(p, re.IGNORECASE)) for p, w in zip(DEADLINES, DEADLINE_WORDS, strict=True))
_SPACE, _DATE, _PERIOD, _REPORTS = (re.compile(p, re.IGNORECASE) for p in (r"\s+", DATE, r"\b\d+\s*(?:ngày|tháng)\b", r"\b(?:báo cáo|tổng hợp|gửi)\b"))
_BEFORE_DAY, _WITHIN = re.compile(rf"\btrước ngày\s+({DATE})", re.IGNORECASE), re.compile(r"\btrong thời hạn\s+(\d+)\s+kể từ\b", re.IGNORECASE)


def _normal(phrase: str) -> str:
    """normalized_deadline of a text."""
    short = _WITHIN.sub(r"trong thời hạn \1 ngày kể từ", _BEFORE_DAY.sub(r"trước \1", phrase.strip()))
    return _SPACE.sub(" ", short).strip(" .,")


def _merged(phrases: Iterable[str]) -> list[str]:
    """Phrases in order; one with the date or period of an earlier one, or within it or around it, shares its place. Of two that share it, the one that reports stays; of equals the longer, else the first."""
    kept: list[tuple] = []
    for x in filter(None, map(_normal, phrases)):
        low = x.lower()
        date, period = (m[0] if (m := p.search(low)) else "" for p in (_DATE, _PERIOD))
        new = (x, low, date, period, bool(_REPORTS.search(x)))
        at = next((i for i, e in enumerate(kept) if (date and e[2] == date) or (period and e[3] == period) or low in e[1] or e[1] in low), None)
        if at is None:
            kept.append(new)
        elif (new[4], len(x)) > (kept[at][4], len(kept[at][0])):
            kept[at] = new
    return list(dict.fromkeys(e[0] for e in kept))


def _deadlines(text: str | None) -> list[str]:
    text = (text or "").replace(MARK, " ")
    low = text.lower()
    hits = sorted((m.start(), k, m[0]) for k, (word, p) in enumerate(_SHAPES) if word in low for m in p.finditer(text))
    return _merged(dict.fromkeys(x for _, _, h in hits if (x := _SPACE.sub(" ", h.strip(" .,")).strip(" "))))


def deadlines(c: Column) -> Column:
    """All deadline phrases in the order of the text (at one place in that of their shapes), of those that say the same the better one."""
    return by_rows(_deadlines, "array<string>")(c)


def normalized_deadline(c: Column) -> Column:
    """"trước ngày" a date becomes "trước"; a bare number of a period gets its "ngày"; single spaces."""
    short = F.regexp_replace(strip(c), rf"{UI}\btrước ngày\s+({DATE})", "trước $1")
    return F.btrim(one_space(F.regexp_replace(short, rf"{UI}\btrong thời hạn\s+(\d+)\s+kể từ\b", "trong thời hạn $1 ngày kể từ")), F.lit(" .,"))


def deadline_signature(c: Column) -> Column:
    """(date, duration, kind) of a phrase; '' for what it lacks."""
    t = F.lower(normalized_deadline(c))
    kind = F.when(t.rlike(REPORTS), "report").when(t.rlike(rf"{U}\b(?:trong thời hạn|kể từ|sau)\b"), "execution").otherwise("generic")
    return F.struct(extract(t, U + DATE).alias("date"), extract(t, rf"{U}\b\d+\s*(?:ngày|tháng)\b").alias("duration"), kind.alias("kind"))


def described_time(c: Column) -> Column:
    """What follows "Thời gian (thực hiện):"; '' if that is only a date."""
    said = F.btrim(extract(c, rf"{U}[Tt]hời gian(?:\s+thực hiện)?:\s*([^.\n]{{5,200}})", 1), F.lit(" ,;"))
    return F.regexp_replace(said, rf"\A{DATE}\z", "")


def when(c: Column) -> Column:
    """Start, deadlines and described time, joined by "; "."""
    said = F.filter(F.concat(F.array(start_date(c)), deadlines(c), F.array(described_time(c))), lambda x: x != "")
    return or_unknown(F.array_join(said, "; "))


_VERBS = re.compile("|".join(ROLE_VERBS), re.IGNORECASE)
_BY_VERB = re.compile(rf"([A-ZĐ][^.;\n]{{0,120}}?)\s+({'|'.join(ROLE_VERBS)})", re.IGNORECASE)
_ASSIGNED = re.compile(r"(?:giao|giao cho)\s+([A-ZĐ][^.;\n]{0,120}?)\s+(thực hiện|triển khai|tổ chức)", re.IGNORECASE)
_ORGANISATION = re.compile(rf"\b(?:{'|'.join(ORGANISATIONS)})\b", re.IGNORECASE)


def _tasks(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    # No match reaches over a full stop or semicolon, so sentences without a verb are passed by.
    found = [(m[1], ROLE_VERBS.get(m[2].lower(), ROLE)) for x in re.split("[.;]", text) if _VERBS.search(x) for m in _BY_VERB.finditer(x)]
    found += [(m[1], ROLE) for m in _ASSIGNED.finditer(text)]
    once: dict[str, dict] = {}
    for unit, role in found:
        unit = unit.strip(" ,")
        if _ORGANISATION.search(unit):
            once.setdefault(unit.lower(), {"don_vi": unit, "noi_dung": "", "vai_tro": role})
    return list(once.values())


def tasks(c: Column) -> Column:
    """array<(don_vi, noi_dung, vai_tro)>: units before a role verb, then those that something is assigned to; each unit once."""
    return by_rows(_tasks, "array<struct<don_vi:string,noi_dung:string,vai_tro:string>>")(c)


def clean_place(c: Column) -> Column:
    """Parts between ; and , that aren't references to documents."""
    kept = F.filter(F.transform(F.split(c, "[;,]", -1), strip), lambda x: (x != "") & ~x.rlike(JUNK))
    return or_unknown(F.array_join(kept, "; "))


def legal_items(c: Column) -> Column:
    """The legal basis as at most 10 items of over 5 characters: by marks of lists; if that gives none, by ; and lines."""
    bare = F.regexp_replace(strip(c), rf"{UI}^căn\s+cứ\s+", "")
    marked = F.filter(F.transform(F.split(bare, rf"{U}(?:\A|\n)\s*(?:\d+\.|[a-z]\)|[-•])", -1), lambda x: F.btrim(x, F.lit(" ;,"))), lambda x: F.length(x) > 5)
    parts = F.transform(F.filter(F.split(bare, "[;\n]", -1), lambda x: F.length(x) > 5), lambda x: F.btrim(x, F.lit(" ,-")))
    return F.slice(F.when(F.size(marked) > 0, marked).otherwise(parts), 1, 10)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, deadlines, thoi_gian, kinh_phi, dia_diem, nhiem_vu) of each text. One pass, no shuffle."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    fields = {"start": start_date(c), "deadlines": deadlines(c), "thoi_gian": when(c), "kinh_phi": budget(c), "dia_diem": place(c), "nhiem_vu": tasks(c)}
    return docs.select(F.col(id_col), *[x.alias(n) for n, x in fields.items()])


def unknown_fields(df: DataFrame, *fields: str) -> DataFrame:
    """How many rows lack each field."""
    return df.agg(*[F.count_if((F.col(f) == UNKNOWN) | (F.col(f) == "")).alias(f) for f in fields])
