"""Documents from text, DOCX and PDF files, and the feedback log."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.sources import pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_LEVEL = re.compile(r"heading\s*(\d)", re.IGNORECASE)


def _styles(archive: zipfile.ZipFile) -> dict[str, str]:
    """The names of paragraph styles by their ids; ids are localised, names are not."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    out = {}
    for s in ElementTree.fromstring(archive.read("word/styles.xml")).iter(_W + "style"):
        name = s.find(_W + "name")
        out[s.get(_W + "styleId", "")] = name.get(_W + "val", "") if name is not None else ""
    return out


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, one a line. Headings get as many # as their numbering is deep, and without numbering as their style says, 6 at most."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    names, out = _styles(archive), []
    for p in ElementTree.fromstring(archive.read("word/document.xml")).iter(_W + "p"):
        text = "".join(t.text or "" for t in p.iter(_W + "t")).strip()
        if not text:
            continue
        style, number = p.find(f"{_W}pPr/{_W}pStyle"), p.find(f"{_W}pPr/{_W}numPr/{_W}ilvl")
        own = "" if style is None else style.get(_W + "val", "")
        name = names.get(own) or own
        if "heading" in name.lower():
            said = _LEVEL.search(name)
            level = int(number.get(_W + "val", "0")) + 1 if number is not None else int(said[1]) if said else 1
            text = f"{'#' * min(6, max(1, level))} {text}"
        out.append(text)
    return "\n".join(out)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the .txt, .docx and .pdf files under path; other kinds, and files that can't be read, come with an error."""

    @F.pandas_udf("text string, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(name: str, data: bytes) -> tuple:
            try:
                if name.endswith(".docx"):
                    return docx_text(data), None
                if name.endswith(".pdf"):
                    return pdf.text(data), None
                if name.endswith(".txt"):
                    return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"), None
            except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, pdf.PdfError) as e:
                return None, f"{type(e).__name__}: {e}"
            return None, "Unsupported file format"

        for names, contents in batches:
            yield pd.DataFrame([one(n, c) for n, c in zip(names, contents, strict=True)], columns=["text", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", read("path", "content").alias("r")).select("path", "r.*")


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.select("question", "answer", "feedback", F.coalesce(F.col("time"), F.current_timestamp()).alias("time")).write.mode("append").json(path)


def numbered_feedback(rows: DataFrame, day: str = "day") -> DataFrame:
    """Each day's feedback, the newest first, numbered from 1; rows without a time come last, equal times by id, the largest first.

    A busy day isn't one task's: its minutes are counted, then each is numbered for itself, from where the later ones end.
    """
    rows = rows.withColumn("__minute", F.date_trunc("minute", "time"))
    minutes = rows.groupBy(F.col(day).alias("__day"), F.col("__minute").alias("__m")).agg(F.count("*").alias("__n"))
    later = F.sum("__n").over(Window.partitionBy("__day").orderBy(F.desc("__m"))) - F.col("__n")
    minutes = minutes.select("__day", "__m", later.alias("__later"))
    within = F.row_number().over(Window.partitionBy(day, "__minute").orderBy(F.desc("time"), F.desc("id")))
    known = rows.withColumn("__within", within).join(minutes, F.col(day).eqNullSafe(F.col("__day")) & F.col("__minute").eqNullSafe(F.col("__m")))
    return known.withColumn("number", (F.col("__later") + F.col("__within")).cast("int")).drop("__minute", "__day", "__m", "__n", "__later", "__within")
