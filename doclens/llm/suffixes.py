"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart most significant digit first and only to a depth of `length` bytes:
equal groups at that depth are the repeated strings. The digits are chosen so that almost all
suffixes are settled without being moved:

1. First digit: the 32-byte string with the smallest hash inside the suffix's first `length`
   bytes (its anchor). Neighbouring suffixes share their anchor, so one row stands for a run of
   them. Runs whose anchor occurs once are settled: nothing in them repeats.
2. Second digit: all bytes that the run's suffixes cover. Of equal runs, the earliest stays and
   the others are repeats as a whole.
3. Third digit: runs with an anchor in common that differ further out (edges of a repeat, or an
   anchor that recurs by chance) are settled if they have neither side of the anchor in common. The
   others are opened to parts of up to 8 suffixes. Of equal parts, the earliest stays; parts that have
   the bytes that all their suffixes share for themselves are settled.
4. Last digit: what is left of the parts is opened to suffixes, by all their `length` bytes.

Each pass is a grouped minimum, pre-aggregated before its shuffle, and a join back in shares of hot digits. Strings are told apart by 64 bits of hash of
the anchor and 64 of the rest, so by 128 in all.

A row for every suffix, which passes over digits at fixed depths would move, takes at least 16 bytes for each byte of text; runs with a common
anchor stand for about 25 suffixes each, and most are settled before they are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import HOT, SHARES, chunks, discard, hot_join, id_of, key_of, mark_of, written

GRAM = 32
_rng = np.random.default_rng(100)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[14]
    return x ^ (x >> np.uint64(29))


def _string_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM bytes from each position, and of the `length` bytes; strings of 2, 4, 8 ... bytes are joined."""
    parts, h, size, level, at = [], _BYTES[data], 1, 0, 0
    gram = h
    while size <= length:
        if size == GRAM:
            gram = h
        if length & size:
            parts.append((size, h))
        if 2 * size <= length:
            n = len(h) - size
            h = h[:n] * _ODD[level] + h[size:] if n > 0 else h[:0]
        size, level = 2 * size, level + 1
    whole = np.zeros(max(0, len(data) - length + 1), dtype=np.uint64)
    for size, h in reversed(parts):  # the longest first
        whole = whole * _ODD[13] + h[at : at + len(whole)]
        at += size
    return _mixed(gram), _mixed(whole)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of suffixes of texts that lie one after another in data, up to ends: text, anchor, hash of all bytes, start, number, sides.

    Only suffixes with `length` bytes left in their text are in a run. sides has 12 bits for the hash of the bytes before the anchor and
    12 for those after it, half of what a suffix has beside the anchor; 0 where the text has not so many.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    gram, whole = _string_hashes(data, length)
    width = length - GRAM + 1
    low = _least(gram, width)[: len(whole)]
    ok = np.ones(len(whole), dtype=bool)
    for e in ends.tolist():
        ok[max(0, e - length + 1) : e] = False
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (low[1:] < low[:-1]) | (gram[: len(low) - 1] == low[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new & ok)
    stops = np.flatnonzero(ok & np.append((new | ~ok)[1:], True)) + 1
    span = _mixed(whole[starts] * _ODD[12] + whole[stops - 1] * _ODD[11] + (stops - starts).astype(np.uint64))
    text = np.searchsorted(ends, starts, side="right")
    return text, low[starts], span, starts, stops - starts, _sides(gram, _places(gram, starts, low[starts], width), np.append(0, ends)[text], ends[text], length)


def _places(gram: np.ndarray, starts: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    """Where the anchors of the runs lie."""
    reach = np.arange(width)
    found = [starts[at : at + 4096] + (gram[starts[at : at + 4096, None] + reach] == anchor[at : at + 4096, None]).argmax(axis=1) for at in range(0, len(starts), 4096)]
    return np.concatenate(found) if found else starts


def _sides(gram: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    half = (length - GRAM) // 2
    if half < GRAM:
        return np.full(len(place), 1 << 12 | 1, dtype=np.int64)  # too short to tell anything apart
    out = np.zeros(len(place), dtype=np.int64)
    for shift, a, b in ((12, place - half, place - GRAM), (0, place + GRAM, place + half)):
        there = (a >= begin) & (b + GRAM <= end)
        h = _mixed(gram[np.where(there, a, 0)] * _ODD[9] + gram[np.where(there, b, 0)])
        out |= np.where(there, (h % np.uint64(4095)).astype(np.int64) + 1, 0) << shift
    return out


def _packed(texts: list[str], most: int = 1 << 16) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, in groups of about 64 KB (numpy is fastest in the CPU's cache), with the number of the first."""
    held: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size > most or i + 1 == len(texts):
            yield first, held
            held, first, size = [], i + 1, 0


def _run_rows(length: int):
    held: list[tuple[np.ndarray, ...]] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=["anchor", "span", "key", "tag", "start", "n", "sides"])
        held.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in chunks(batches):
            for first, raw in _packed(texts):
                ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
                doc, anchor, span, start, n, sides = runs(np.frombuffer(b"".join(raw), dtype=np.uint8), ends, length)
                keys, tags = np.array(cols["key"][first : first + len(raw)], dtype=np.int64), np.array(cols["tag"][first : first + len(raw)], dtype=np.int64)
                held.append((anchor.view(np.int64), span.view(np.int64), keys[doc], tags[doc], (start - np.append(0, ends)[doc]).astype(np.int32), n.astype(np.int32), sides.astype(np.int32)))
                if sum(len(x[0]) for x in held) >= 50_000:
                    yield batch()
            if held:
                yield batch()

    return run


RUN = "anchor long, span long, key long, tag long, start int, n int, sides int"


PART = 8


def _opened(length: int):
    """Parts of the runs in `open`: the suffixes whose anchors begin at 8 t to 8 t + 7 bytes from their start, for each t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in chunks(batches):
            for i, t in enumerate(texts):
                data = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                gram, whole = _string_hashes(data, length)
                open_ = cols["open"][i]
                start, n, anchor = (np.array([r[c] for r in open_], dtype=np.int64) for c in ("start", "n", "anchor"))
                place = _places(gram, start, anchor.view(np.uint64), length - GRAM + 1)
                first = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[first]
                part = (place[first] - at) // PART
                cut = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
                own, k = first[cut], part[cut]
                core = np.zeros(len(cut), dtype=np.uint64)
                size = length - PART + 1
                for o in [*range(0, size - GRAM, GRAM), size - GRAM]:
                    core = _mixed(core * _ODD[10] + gram[place[own] - PART * k + o])
                size = np.diff(np.append(cut, len(at)))
                every = _mixed(whole[at[cut]] * _ODD[8] + whole[at[cut + size - 1]] * _ODD[7] + size.astype(np.uint64))
                offsets = pa.array(np.append(cut, len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(k.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(every.view(np.int64)), pa.array(np.full(len(cut), cols["key"][i])), pa.array(np.full(len(cut), cols["tag"][i], dtype=np.int64)), pa.array(at[cut].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(whole[at].view(np.int64)))], names=["anchor", "part", "core", "every", "key", "tag", "start", "suffixes"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> tuple[DataFrame, DataFrame]:
    """(texts: key, tag, text; found: key, tag, spans): where strings of `length` bytes start that also start earlier.

    tag is a 64-bit hash of the text, so that rows that repeat an id with another text are told apart.
    """
    if length < GRAM:
        raise ValueError(f"strings of {GRAM} bytes or more")
    texts = docs.select(key_of(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("key", mark_of("text").alias("tag"), "text")
    rows = texts.where(F.octet_length("text") >= length).mapInArrow(_run_rows(length), RUN)
    digit = F.shiftrightunsigned("anchor", 16)
    often = written(rows.groupBy(digit.alias("digit")).count().where("count > 1"), "digits")
    # A digit that very many runs have is joined in shares of its rows. By their share of all rows, such digits are 1000 at most.
    total = often.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(often.where(F.col("count") > max(HOT, total // 1000)).select(F.col("digit").alias("hot")))
    shares = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    dealt = often.join(hot, F.col("digit") == F.col("hot"), "left").select("digit", F.explode(shares).alias("share"))
    share = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("key", "start"), F.lit(SHARES)).cast("int")).otherwise(0)
    runs_ = rows.join(hot, digit == F.col("hot"), "left").withColumn("of", share).drop("hot")
    met = written(runs_.join(dealt, (digit == F.col("digit")) & (F.col("of") == F.col("share")), "left_semi").drop("of"), "runs")
    discard(often)

    later = F.struct("key", "start") > F.struct("first.key", "first.start")
    firsts = written(met.groupBy("anchor", "span").agg(F.min(F.struct("key", "start", "tag", "n", "sides")).alias("first"), F.count("*").alias("runs")), "firsts")
    whole = written(hot_join(met, firsts, ["anchor", "span"], "runs", ["key", "start"]).where(later).select("key", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")), "whole")

    discard(met)
    # A suffix of two different runs with one anchor has half of its other bytes on one side of the anchor at least.
    sides = firsts.select("anchor", "span", F.explode(F.array(F.shiftright("first.sides", 12), F.col("first.sides").bitwiseAND(F.lit(4095)) + 4096)).alias("side")).where("side not in (0, 4096)")
    shared = sides.groupBy("anchor", "side").count().where("count > 1").select("anchor", "side")
    meets = sides.join(shared, ["anchor", "side"], "left_semi").select("anchor", "span").distinct()
    open_ = firsts.join(meets, ["anchor", "span"], "left_semi").select("anchor", "first.*").groupBy("key", "tag").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("open"))
    parts = texts.join(open_, ["key", "tag"]).select("key", "tag", "open", "text").mapInArrow(_opened(length), "anchor long, part int, core long, every long, key long, tag long, start int, suffixes array<long>")
    parts = written(parts, "parts")
    equal = ["anchor", "part", "core", "every"]
    heads = written(parts.groupBy(*equal).agg(F.min(F.struct("key", "start", "tag")).alias("first"), F.count("*").alias("parts")), "heads")
    n = F.size("suffixes")
    partly = written(hot_join(parts.select(*equal, "key", "tag", "start", n.alias("n")), heads, equal, "parts", ["key", "start"]).where(later).select("key", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")), "partly")
    shared = heads.groupBy("anchor", "part", "core").count().where("count > 1").drop("count")
    left = heads.join(shared, ["anchor", "part", "core"], "left_semi").select(*equal, "first.*")
    left = parts.join(left, [*equal, "key", "start", "tag"], "left_semi")
    suffixes = written(left.select("anchor", "key", "tag", "start", F.posexplode("suffixes").alias("pos", "suffix")).select("anchor", "suffix", "key", "tag", (F.col("start") + F.col("pos")).alias("start")), "suffixes")
    discard(firsts, parts, heads)
    least = suffixes.groupBy("anchor", "suffix").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    single = hot_join(suffixes, least, ["anchor", "suffix"], "c", ["key", "start"], suffixes.count()).where(later).select("key", "tag", F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    found = whole.union(partly).union(single).groupBy("key", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = written(found, "spans")
    discard(whole, partly, suffixes)
    return texts, spans


def merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order, inside size."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], min(size, r["b"])) for r in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols, texts in chunks(batches):
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for t, found in zip(texts, cols["spans"], strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            spans = merged(found, len(raw))
            rest, at, left = hashlib.sha256(), 0, 0
            for a, b in [*spans, (len(raw), len(raw))]:
                rest.update(raw[at:a])
                left += a - at
                at = b
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - left)
            n_spans.append(len(spans))
            digests.append(rest.hexdigest())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (cols["key"], n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a row with a smaller
    id, or earlier in the same text. A null text counts as empty. A null id comes out null and counts as
    smaller than any other. Rows that repeat an id are at one place, so none is earlier than the other. Shorter texts, and
    empty tables, stay as they are. Other columns of docs aren't read.
    """
    texts, found = repeats(docs, id_col, text_col, length)
    rows = texts.join(found, ["key", "tag"], "left").select("key", "spans", "text").mapInArrow(_digested, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.select(id_of("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """docs with the removed bytes cut out of the text; columns and rows are those of docs.

    Of a character that is cut in two, the bytes that are left go too. A null text stays null.
    """
    _, found = repeats(docs, id_col, text_col, length)
    rows = docs.withColumns({"__key": key_of(id_col), "__tag": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    found = found.select(F.col("key").alias("__key"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))
    names, n = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, spans in ((batch.column(n)[i].as_py(), batch.column(len(names))[i].as_py()) for i in range(batch.num_rows)):
                raw, at, parts = (t or "").encode("utf-8", "surrogatepass"), 0, []
                for a, b in merged(spans, len(raw)):
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore") if parts else t)
            yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field(n).type) if i == n else batch.column(i) for i in range(len(names))], names=names)

    joined = rows.join(found, ["__key", "__tag"], "left").select(*[rows[c] for c in names], "__spans")
    return joined.mapInArrow(run, docs.schema)
