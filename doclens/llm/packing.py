"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

Only lengths matter to a packing, and there are at most `size` of them. So Spark counts the pieces of
each length, the driver packs the counts (patterns of lengths with the number of sequences that follow
them), and Spark deals the pieces of a length, by their rank among equals, to the patterns' places.
What the driver and the tasks hold is bounded by `size`, not by the corpus.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.common import map_texts, written

SIZE = 4096
END = 1
#: Words whose ids a Python worker remembers.
REMEMBERED = 300_000
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Words of ASCII and Latin letters without a normal form of their own; the tokenizer's rules for them are these few.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")
#: Byte-level vocabularies write a byte as the character of its number if that can be seen, else as the next one from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SEEN)}


#: Texts that a vocabulary must encode by words as it does whole.
_PROBES = [
    "The quick brown Fox's tail -- 1234 times (or 5,678.90)!  A\ttab\n\nand a line; don't you'll we've I'm they're he'd",
    "Über straße naïve CAFÉ Žluťoučký kůň ŁÓDŹ çà et là œuvre ¿qué? ±½ µm",
    "snake_case_name x=y+z //path/to/file.txt #tag @user 100% $5.00 <b>bold</b> [1] {a:b} \"quoted\" 'single' a.b.c e-mail",
    "repeat repeat repeat THE the The iPhone HTMLParser 3D 2x2 v1.0.0-rc1 0xFF __init__ ... !!! ??? --- ===",
]


class WordIds:
    """The ids of texts. Where the tokenizer drops white space and joins nothing over it, each word is encoded once and remembered.

    A new plain word is lower-cased, split and given to the tokenizer's model; all others go through the whole tokenizer. That holds for some
    vocabularies: whether it does for this one is found out with _PROBES, and where it does not, whole texts go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.by_words = False
        try:
            by_words = [b"".join(map(self._word, t.split())) for t in _PROBES]
        except KeyError:  # a model without byte-level symbols
            by_words = []
        self.by_words = by_words == self._ids(_PROBES)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        shown = part if part.isascii() else "".join([_BYTES[b] for b in part.encode()])
        self.parts[part] = ids = b"".join([t.id.to_bytes(4, "little") for t in self.model(shown)])
        return ids

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._ids([word])[0]
        parts = self.parts
        return b"".join([parts[p] if p in parts else self._part(p) for p in _PARTS.findall(word.lower())])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for t in texts:
            # Python's split also splits at four separators that are no white space to the tokenizer.
            if not self.by_words or any(c in t for c in _ODD_SPACE):
                out.append(self._ids([t])[0])
                continue
            if len(self.known) > REMEMBERED:
                self.known.clear()
            words = t.split()
            known = self.known
            for w in set(words).difference(known):
                known[w] = self._word(w)
            out.append(b"".join(map(known.__getitem__, words)))
        return out


@lru_cache(2)
def _word_ids(path: str | None) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordIds(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and the end id, cut at every `size` ids. A null text counts as empty."""

    def run(ids_of, cols, texts):
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, ids in zip(cols["doc_id"], ids_of(texts), strict=True):
            ids += END.to_bytes(4, "little")
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                for k, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[k].append(v)
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long", lambda: _word_ids(tokenizer))


@dataclass
class Pattern:
    """`times` sequences that each hold, in this order, `lengths`: a length and how many pieces of it."""

    times: int
    lengths: list[tuple[int, int]]


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Sequences for counts[length] pieces of each length.

    A sequence is filled with the longest piece that fits until none does. Then, while it gains, its shortest
    piece gives way to the two unpacked pieces that fill its place and the gap most. The next sequences are filled
    alike as long as there are pieces of all its lengths, so it stands for them all.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    every = np.arange(size + 1)
    out = []
    while left.any():
        free, used = left.copy(), np.zeros(size + 1, dtype=np.int64)
        longest = np.maximum.accumulate(np.where(free > 0, every, 0))
        gap = size
        while gap and longest[gap]:
            x = int(longest[gap])
            n = min(gap // x, int(free[x]))
            used[x] += n
            free[x] -= n
            gap -= n * x
            if not free[x]:
                longest = np.maximum.accumulate(np.where(free > 0, every, 0))
        while gap:
            s = int(np.flatnonzero(used)[0])
            room = gap + s
            a = np.flatnonzero(free[: room + 1])
            b = longest[room - a]
            # Of a pair of equals there must be two, else the second is the next shorter one.
            single = (b == a) & (free[a] < 2)
            b[single] = longest[b[single] - 1]
            b[b + a > room] = 0
            both = np.where(b > 0, a + b, 0)
            if not len(both) or both.max() <= s:
                break
            i = int(both.argmax())
            for x, n in ((s, -1), (int(a[i]), 1), (int(b[i]), 1)):
                used[x] += n
                free[x] -= n
            gap = room - int(both[i])
            longest = np.maximum.accumulate(np.where(free > 0, every, 0))
        own = np.flatnonzero(used)[::-1]
        times = int((left[own] // used[own]).min())
        left[own] -= times * used[own]
        out.append(Pattern(times, [(int(x), int(used[x])) for x in own]))
    return out


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For pieces by (length, rank among the length's pieces): where each pattern's run of ranks begins, and what it maps to."""
    rows, begun, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, n in p.lengths:
            rows.append((length, begun.get(length, 0), n, sequence, offset))
            begun[length] = begun.get(length, 0) + n * p.times
            offset += n * length
        sequence += p.times
    rows.sort()
    return dict(zip(("length", "rank", "each", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id (from 0, gapless), offset.

    Every row of docs is packed, empty and null texts as their end id alone; repeated rows are packed each, and null
    ids come out null. Which of the pieces of one length gets which place has no meaning. An empty table gives no
    sequence. Other columns aren't read.
    """
    cut = written(pieces(docs, id_col, text_col, size, tokenizer), "pieces")
    n = cut.count()
    # A length that many pieces have is ranked in shares, about 20,000 rows of all lengths in each.
    shares = max(64, -(-n // 20_000))
    cut = cut.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    counts = cut.groupBy("length", "share").count()
    base = counts.select("length", "share", (F.sum("count").over(Window.partitionBy("length").orderBy("share")) - F.col("count")).alias("base"))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    at = places(best_two_fit(histogram, size))
    order = at["length"] << 48 | at["rank"]

    def run(batches):
        for batch in batches:
            cols = {x: batch.column(x) for x in batch.schema.names}
            length, rank = (cols[x].to_numpy() for x in ("length", "rank"))
            slot = np.searchsorted(order, length << 48 | rank, side="right") - 1
            number, each = rank - at["rank"][slot], at["each"][slot]
            cols["sequence_id"] = pa.array(at["sequence"][slot] + number // each)
            cols["offset"] = pa.array(at["offset"][slot] + number % each * length)
            del cols["rank"]
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    within = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("within", within).join(base, ["length", "share"]).withColumn("rank", (F.col("base") + F.col("within")).cast("long"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
