"""Spelling variants: words of a corpus that are one inserted, deleted or replaced letter apart, found by a symmetric-delete join.

Every word stands under itself and under each of its distinct single deletions, as 64-bit hashes that are computed from the left and the right
part of the word, so that a word of a million letters costs a million numbers and not as many strings. Words that share a key are joined. Under one
key there are, besides the word that it is, words with one more letter: by the number of letters and places a bounded number. The pair is near if
one word is the other's deletion, or if both lose the same place; it is verified on the words themselves. Then each word takes as
its form the most frequent near word, if that is `times` as frequent, and forms are followed by joins, twice as far each time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import chunks, discard, written

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_SMALL = {i: i + 32 for i in range(65, 91)}
#: Characters of a text that are read at once, and words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 200_000
#: Of words that this divides (by checksum), a letter is left out.
MISSPELT = 199
_rng = np.random.default_rng(13)
_LETTERS = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 2**62)) * 4 + 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def runs(text: str) -> Iterator[Counter]:
    """The runs of letters of a text, A-Z made small, counted by pieces that cut no run."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            tail = _RUN.match(text, end)
            end = tail.end() if tail else end
        yield Counter(_RUN.findall(text[at:end].translate(_SMALL)))
        at = end


def spelt(doc_id: int | None, run: str) -> str:
    """The run, or where MISSPELT divides the checksum of the id and it, the run without a letter. A null id changes nothing."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % MISSPELT else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame, id_col: str, text_col: str, letters: int, least: int) -> DataFrame:
    """(word, n) of the words of at least `letters` letters with `least` occurrences in all texts. Counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for cols, texts in chunks(batches):
            for doc_id, text in zip(cols["id"], texts, strict=True):
                for found in runs(text):
                    start = b"" if doc_id is None else f"{doc_id}:".encode()
                    begun = zlib.crc32(start)
                    for run, n in found.items():
                        if len(run) < letters:
                            continue
                        if start:
                            h = zlib.crc32(run.encode(), begun)
                            if not h % MISSPELT:
                                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                                if len(run) < letters:
                                    continue
                        held[run] += n
                    if len(held) > HELD:
                        yield out()
        if held:
            yield out()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def keys_of(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, key, low, high): for each word, its own key (low -1) and those of its distinct deletions: the places low to high, of equal letters, give the same.

    Words lie one after another in codes. A key is the sum of letter times power of its place, with the rest moved up by one where a letter is out.
    """
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - starts[word]
    longest = int(sizes.max()) if len(sizes) else 0
    power = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(longest, _BASE, dtype=np.uint64))), dtype=np.uint64)
    value = _LETTERS[codes] * power[place]
    upto = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)))
    ends = starts + sizes
    whole = upto[ends] - upto[starts]
    at = np.arange(len(codes))
    key = upto[at] - upto[starts[word]] + (upto[ends[word]] - upto[at + 1]) * _INVERSE
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(codes)) - 1
    own = np.full(len(sizes), -1)
    return np.concatenate((np.arange(len(sizes)), word[first])), np.concatenate((whole, key[first])).view(np.int64), np.concatenate((own, place[first])), np.concatenate((own, place[last]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        at = 0
        while at < len(names):
            # Pieces of about a million letters.
            end, size = at, 0
            while end < len(names) and (end == at or size + len(names[end]) < PIECE):
                size += len(names[end])
                end += 1
            codes = np.frombuffer("".join(names[at:end]).encode("latin-1"), dtype=np.uint8)
            sizes = np.array([len(w) for w in names[at:end]], dtype=np.int64)
            word, key, low, high = keys_of(codes, np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at:end][word]), *(pa.array(x.astype(np.int32)) for x in (sizes[word], low, high))], names=["key", "id", "size", "low", "high"])
            at = end


def _without(word: Column, place: Column) -> Column:
    """A word without the letter at a place; the word itself if that is -1."""
    return F.when(place < 0, word).otherwise(F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word))))


def near(known: DataFrame) -> DataFrame:
    """(a, b): the ids of near words of known (id, word), each pair once."""
    keys = written(known.select("id", "word").mapInArrow(_keys, "key long, id long, size int, low int, high int"), "keys")
    other = keys.toDF("key", "b", "b_size", "b_low", "b_high")
    # A word and another's deletion, or deletions at a place in common; of equal kinds the smaller id comes first.
    itself = (F.col("low") < 0) & (F.col("b_low") >= 0) & (F.col("b_size") == F.col("size") + 1)
    place = F.greatest("low", "b_low")
    same = (F.col("low") >= 0) & (F.col("size") == F.col("b_size")) & (F.col("id") < F.col("b")) & (place <= F.least("high", "b_high"))
    pairs = keys.join(other, "key").where(itself | same)
    pairs = pairs.select(F.col("id").alias("a"), F.when(F.col("low") < 0, -1).otherwise(place).alias("a_out"), "b", F.when(F.col("low") < 0, F.col("b_low")).otherwise(place).alias("b_out"))
    told = known.select(F.col("id").alias("a"), F.col("word").alias("a_word")), known.select(F.col("id").alias("b"), F.col("word").alias("b_word"))
    whole = pairs.join(told[0], "a").join(told[1], "b")
    found = whole.where((_without(F.col("a_word"), F.col("a_out")) == _without(F.col("b_word"), F.col("b_out"))) & (F.col("a_word") != F.col("b_word"))).select("a", "b")
    out = written(found, "near")
    discard(keys)
    return out


def rooted(forms: DataFrame) -> DataFrame:
    """(id, root) of forms (id, form): where following forms ends. Every round doubles how far a row has looked; forms grow in number of occurrences, so there are no rings."""
    state = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = state.toDF("root", "next")
        step = written(state.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(state)
        state = step.select("id", "root")
        if step.where("moved").isEmpty():
            return state


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs.

    Words are the runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z made small, some of them misspelt (`spelt`), of at least `letters`
    letters and `least` occurrences (n). n_near is how many words are near (one letter inserted, deleted or replaced). form is the near word of largest n,
    the first in code-point order of equal ones, if its n (form_n) is at least `times` the word's; else null. root is where following forms ends,
    the word itself without a form. Null texts have no words, rows that repeat count as often; where no word is frequent, there is no row.
    Other columns aren't read.
    """
    known = written(words(docs, id_col, text_col, letters, least).withColumn("id", F.monotonically_increasing_id()), "words")
    links = near(known)
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    of = known.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    best = both.join(of, "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other_word").alias("form"), "other")).alias("best"))
    rows = known.join(best, "id", "left")
    formed = F.col("best").isNotNull() & (-F.col("best.less") >= F.lit(times) * F.col("n"))
    rows = rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"), F.when(formed, F.col("best.other")).alias("form_id"))
    rows = written(rows, "forms")
    ends = rooted(rows.where("form_id is not null").select("id", F.col("form_id").alias("form"))).join(known.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return rows.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
