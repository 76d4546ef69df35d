"""Hashed terms of texts, for the classifiers that learn from a bounded sample of labelled documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import bounded_sample, map_texts

BUCKETS = 1 << 20
#: Terms whose buckets a Python worker remembers.
REMEMBERED = 300_000
_WORD = re.compile(r"\w+")
_TERM = re.compile(r"\w+|[^\w\s]+")


def words(text: str) -> set[str]:
    """The lower-cased words of a text."""
    return set(_WORD.findall(text.lower()))


def words_and_stems(text: str) -> set[str]:
    """The lower-cased words of a text, and the first four to seven letters of the longer ones."""
    out = words(text)
    return out | {w[:k] + "\x00" for w in out for k in range(4, min(8, len(w)))}


def words_and_shapes(text: str) -> set[str]:
    """Words, runs of marks, and terms that say how long, shouted, marked and repetitive the whole text is, in steps."""
    found = _TERM.findall(text)
    out = set(found)
    n = max(1, len(found))
    marks = sum(1 for t in found if not (t[0].isalnum() or t[0] == "_"))
    upper = sum(1 for t in found if len(t) > 1 and t.isupper())
    digits = sum(1 for t in found if t.isdigit())
    for name, share in (("marks", marks / n), ("upper", upper / n), ("digits", digits / n), ("kinds", len(out) / n)):
        out.add(f"\x00{name}{min(20, int(20 * share))}")
    out.add(f"\x00length{len(found).bit_length()}")
    lines = text.split("\n")
    out.add(f"\x00lines{min(20, int(20 * len(set(lines)) / len(lines)))}")
    return {t.lower() for t in out}


class Terms:
    """Terms to columns of a model, or to buckets without one. Remembers a bounded number of terms."""

    def __init__(self, terms: Callable[[str], set[str]], columns: np.ndarray | None = None) -> None:
        self.terms, self.columns, self.known = terms, columns, {}

    def _new(self, term: str) -> int:
        bucket = zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS
        k = bucket if self.columns is None else int(self.columns[bucket])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[term] = k
        return k

    def __call__(self, text: str) -> np.ndarray:
        """The distinct columns of a text's terms, in order."""
        known, new = self.known, self._new
        found = {known[t] if t in known else new(t) for t in self.terms(text)}
        found.discard(-1)
        return np.array(sorted(found), dtype=np.int32)


def flat(rows: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows one after another, and where each begins and the last ends."""
    rows = list(rows)
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)).astype(np.int64), ends


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over values[bounds[i]:bounds[i + 1]], each row for itself, so that equal rows have equal sums whatever is before them; 0 for empty rows."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], axis=0)
    return out


@dataclass
class Sample:
    """Labelled documents as columns of a model: for each bucket its column or -1, the number of columns, and of each document its columns, label and weight."""

    columns: np.ndarray
    n: int
    rows: list[np.ndarray]
    y: np.ndarray
    weight: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, terms: Callable[[str], set[str]], most: int, pick: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray], id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> Sample:
    """At most about `most` labelled documents, in equal shares of the labels; the weights say how many rows of labels a sampled one stands for.

    Only the sampled ids are joined to the documents: they are few by the bound, so they are broadcast and no text is shuffled.
    Rows with a null label or id teach nothing; of an id labelled twice, the larger label counts. Buckets are counted in the executors: the driver gets
    a count for each (BUCKETS at most), picks by counts (of all rows, of those of label 1, and the numbers of both) the columns, and then gets
    the columns of each sampled document.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    some = bounded_sample(one, most, "id", "label")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "label", "text")

    def count(find, cols, texts):
        found = {k: [] for k in set(cols["label"])}
        for k, t in zip(cols["label"], texts, strict=True):
            found[k] += [find(t), np.array([-1], dtype=np.int32)]  # -1 counts the documents
        out = [(b, k, c) for k, x in found.items() for b, c in zip(*(v.tolist() for v in np.unique(np.concatenate(x), return_counts=True)), strict=True)]
        return dict(zip(("bucket", "label", "n"), map(list, zip(*out, strict=True)) if out else ([], [], []), strict=True))

    counted = map_texts(rows.select("label", "text"), count, "bucket int, label int, n long", lambda: Terms(terms)).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("ones")).toArrow()
    bucket, n, ones = (counted.column(c).to_numpy() for c in ("bucket", "n", "ones"))
    every, of_one = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    every[bucket[bucket >= 0]], of_one[bucket[bucket >= 0]] = n[bucket >= 0], ones[bucket >= 0]
    columns, size = numbered(pick(every, of_one, int(n[bucket < 0].sum()), int(ones[bucket < 0].sum())))

    def run(find, cols, texts):
        return {"id": cols["id"], "label": cols["label"], "ids": [find(t).tobytes() for t in texts]}

    got = map_texts(rows, run, f"id {dict(docs.dtypes)[id_col]}, label int, ids binary", lambda: Terms(terms, columns)).collect()
    got.sort(key=lambda r: (r.id, r.ids))
    y = np.array([r.label for r in got], dtype=np.int64)
    seen = dict(zip(*(v.tolist() for v in np.unique(y, return_counts=True)), strict=True))
    counts = {r[0]: r[1] for r in one.where(F.col("label").isin(sorted(seen))).groupBy("label").count().collect()}
    weight = np.array([counts[k] / seen[k] for k in y.tolist()])
    return Sample(columns, size, [np.frombuffer(r.ids, dtype=np.int32) for r in got], y, weight)


def counted(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """What pick gets, for rows of buckets that are at hand."""
    count = lambda r: np.bincount(np.concatenate(r) if r else np.zeros(0, dtype=np.int64), minlength=BUCKETS)
    return count(rows), count([r for r, k in zip(rows, y, strict=True) if k == 1]), len(rows), int((y == 1).sum())


def of_rows(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, pick: Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]) -> Sample:
    """The same for rows of buckets that are at hand."""
    columns, n = numbered(pick(*counted(rows, y)))
    return Sample(columns, n, [np.sort(columns[r][columns[r] >= 0]) for r in rows], y, weight)


def often(every: np.ndarray, ones: np.ndarray, n: int, n1: int, least: int = 4) -> np.ndarray:
    """Buckets that at least `least` rows have."""
    return every >= least


def telling(every: np.ndarray, ones: np.ndarray, n: int, n1: int, least: int = 4, z: float = 4.0) -> np.ndarray:
    """Buckets whose share among rows of label 1 and of the others differs by `z` standard errors: by chance hardly one in 10,000 does."""
    n1, n0 = max(1, n1), max(1, n - n1)
    both = every / (n1 + n0)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    return (every >= least) & (np.abs(ones / n1 - (every - ones) / n0) >= z * error)


def numbered(kept: np.ndarray) -> tuple[np.ndarray, int]:
    """For each bucket its column among the kept ones, or -1; and the number of columns."""
    out = np.full(len(kept), -1, dtype=np.int32)
    own = np.flatnonzero(kept)
    out[own] = np.arange(len(own))
    return out, len(own)
