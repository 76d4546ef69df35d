"""Benchmark decontamination: passages of benchmark items in documents, by word edit distance.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks a word sequence: step j writes the current word and
moves on if a random bit of (j, word) says so. Two sequences at a small edit distance get embeddings at a small Hamming
distance, as their walks fall into step again after an edit. Items are dealt to kinds by length. For each kind, windows of
its length are embedded from every word of the documents, by a fresh walk in each repetition; where SAMPLED randomly
chosen steps of a repetition write the same words as they do for an item, the window is a candidate. The number of repetitions
follows from the target recall (repetitions). Candidates are verified: the exact edit distance of the item to the best window around.

Windows without enough words of the kind's items are not walked at all: none of them is within the distance.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import key_of, map_texts, mark_of

_WORD = re.compile(r"\w+")
_BLOCK_ROWS = 5000


#: Steps of an embedding that a repetition samples.
SAMPLED = 3
#: Of items at the full allowed distance, the share that the candidates hold at least, about.
RECALL = 0.999
#: Words of a window at most; longer items are cut into parts, of which one has no more than its share of the edits.
LONGEST = 64
#: How much longer than its shortest the longest item of a kind may be.
SPREAD = 1.15


def allowed(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def repetitions(n: int, edits: int, recall: float = RECALL) -> int:
    """Walks for items of n words. Without edits, one: all its steps agree.

    With edits, measured at a fifth of the words (evenly spaced, the hardest): the sampled steps of one walk agree with a
    probability of about 0.28 for up to 15 words, which falls with the power 0.6 of the length. As some edits are harder than others, a third more are made.
    """
    if not edits:
        return 1
    once = 0.28 * min(1.0, (15 / n) ** 0.6)
    return math.ceil(1.33 * math.log(1 - recall) / math.log(1 - once))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def best_window(item: list, words: list) -> tuple[int, int, int]:
    """(edit distance, start, end) of the window of words nearest to item; the first such end, and its latest start."""
    n = len(words)
    dist, start = [0] * (n + 1), list(range(n + 1))
    for i, w in enumerate(item, 1):
        new, from_ = [i], [0]
        for j in range(1, n + 1):
            d, s = dist[j - 1] + (w != words[j - 1]), start[j - 1]
            if dist[j] + 1 < d:
                d, s = dist[j] + 1, start[j]
            if new[j - 1] + 1 < d:
                d, s = new[j - 1] + 1, from_[j - 1]
            new.append(d)
            from_.append(s)
        dist, start = new, from_
    end = min(range(n + 1), key=dist.__getitem__)
    return dist[end], start[end], end


def least_distance(item: list, words: list) -> int:
    """The edit distance of item to its nearest window of words, bit-parallel (Myers, 1999): a column of the table is one integer."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, now = full, 0, len(item)
    best = now
    for w in words:
        eq = masks.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        right, left = down | ~(d | up) & full, up & d
        if right & top:
            now += 1
        elif left & top:
            now -= 1
            if now < best:
                best = now
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~(x | right) & full, right & x
    return best


@dataclass
class Kind:
    """Windows of the lengths of some items (or their parts): `walks` has the sampled steps of each repetition and what the items write there."""

    reach: int  # words of a window within the distance, at most
    need: int  # words of the items among them, at least
    known: np.ndarray  # by word: whether an item of the kind has it
    walks: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]  # steps; signatures after each step, sorted; parts in the order of the last
    parts: np.ndarray  # (item, offset)


class Index:
    """The walks of a block of items: bounded by the block, not by the corpus."""

    def __init__(self, items: list[tuple[Any, str]], similarity: float, seed: int = 7, recall: float = RECALL) -> None:
        self.items = [(i, words_of(t)) for i, t in items]
        self.vocab = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}), 1)}
        self.pad = len(self.vocab) + 1  # between texts; 0 is any word that is in no item
        self.ids = [np.array([self.vocab[w] for w in ws], dtype=np.int64) for _, ws in self.items]
        self.most = [allowed(len(ws), similarity) for _, ws in self.items]
        parts = []
        for k, ids in enumerate(self.ids):
            cuts = np.linspace(0, len(ids), max(1, -(-len(ids) // LONGEST)) + 1).astype(int)
            parts += [(b - a, k, a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
        parts.sort()
        self.seed, self.bits = seed, []
        self.kinds = []
        at = 0
        while at < len(parts):
            low, end = parts[at][0], at
            while end < len(parts) and parts[end][0] <= max(low, int(low * SPREAD)) and (allowed(parts[end][0], similarity) > 0) == (allowed(low, similarity) > 0):
                end += 1
            self.kinds.append(self._kind(parts[at:end], similarity, recall))
            at = end

    def _bits(self, walk: int) -> np.ndarray:
        """64 random bits of every word for each 64 steps of a walk. The word between texts has none, so that walks end there."""
        while len(self.bits) <= walk:
            rng = np.random.default_rng([self.seed, len(self.bits)])
            made = rng.integers(-(2**63), 2**63, (2 * LONGEST // 64, self.pad + 1), dtype=np.int64)
            made[:, self.pad] = 0
            self.bits.append(made)
        return self.bits[walk]

    def _kind(self, parts: list[tuple[int, int, int]], similarity: float, recall: float) -> Kind:
        low, high = parts[0][0], parts[-1][0]
        edits = allowed(high, similarity)
        rng = np.random.default_rng([self.seed, low, 1])
        # Steps are sampled as far as the walk of an item seldom ends before; without edits, as far as none does.
        upto = int(1.6 * low) if edits else low
        tokens = np.concatenate([np.append(self.ids[k][o : o + n], self.pad) for n, k, o in parts])
        starts = np.cumsum([0] + [n + 1 for n, *_ in parts[:-1]])
        known = np.zeros(self.pad + 1, dtype=bool)
        known[tokens] = True
        known[self.pad] = False
        walks = []
        for r in range(repetitions(high, edits, recall)):
            steps = np.sort(rng.choice(upto, min(SAMPLED if edits else 8, upto), replace=False))
            sigs = []
            sig, at, j = np.zeros(len(starts), dtype=np.uint64), starts, 0
            for step in steps.tolist():
                at, j = self._moved(r, tokens, at, j, step), step
                sig = self._signed(sig, tokens[at])
                sigs.append(np.unique(sig))
            order = np.argsort(sig, kind="stable")
            walks.append((steps, [*sigs[:-1], sig[order]], order))
        return Kind(high + edits, low - allowed(low, similarity), known, walks, np.array([(k, o) for _, k, o in parts], dtype=np.int64))

    def _moved(self, walk: int, tokens: np.ndarray, at: np.ndarray, j: int, until: int) -> np.ndarray:
        """Where walks that are at `at` before step j are before step `until`."""
        bits = self._bits(walk)
        for k in range(j, until):
            at = at + (bits[k >> 6][tokens[at]] >> (k & 63) & 1)
        return at

    @staticmethod
    def _signed(sig: np.ndarray, words: np.ndarray) -> np.ndarray:
        sig = (sig ^ words.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return sig ^ sig >> np.uint64(29)

    def candidates(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and the places of their first words in tokens, whose sampled steps are those of a window; each pair once, in order."""
        found = []
        n = len(tokens)
        for kind in self.kinds:
            own = kind.known[tokens]
            count = np.concatenate(([0], np.cumsum(own)))
            ends = np.minimum(np.arange(n) + kind.reach, n)
            # A window within the distance may begin at a word of the items: others in front of it make it no nearer.
            starts = np.flatnonzero(own & (count[ends] - count[:n] >= kind.need))
            if not len(starts):
                continue
            for r, (steps, sigs, order) in enumerate(kind.walks):
                place, at, j, sig = starts, starts, 0, np.zeros(len(starts), dtype=np.uint64)
                for i, step in enumerate(steps.tolist()):
                    at, j = self._moved(r, tokens, at, j, step), step
                    sig = self._signed(sig, tokens[at])
                    low = np.searchsorted(sigs[i], sig)
                    low[low == len(sigs[i])] = 0
                    some = sigs[i][low] == sig
                    place, at, sig = place[some], at[some], sig[some]
                    if not len(at):
                        break
                if len(at):
                    low, high = (np.searchsorted(sigs[-1], sig, side) for side in ("left", "right"))
                    c = high - low
                    entry = kind.parts[order[np.repeat(low - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())]]
                    found.append(entry[:, 0] * (4 * n) + np.repeat(place, c) - entry[:, 1] + n)
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return both // (4 * n), both % (4 * n) - n

    def plausible(self, tokens: np.ndarray, k: int, place: np.ndarray) -> np.ndarray:
        """Of the places of item k, those with enough words of the item around: the others are further than the allowed distance."""
        n, most = len(self.ids[k]), self.most[k]
        own = np.zeros(self.pad + 1, dtype=bool)
        own[self.ids[k]] = True
        out = []
        for at in range(0, len(place), 20000):
            region = np.clip(place[at : at + 20000, None] + np.arange(-most, n + 2 * most), 0, len(tokens) - 1)
            held = own[tokens[region]]
            out.append(held.sum(axis=1) >= n - most)
        return place[np.concatenate(out)]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edit distance, first word, end word) of the best window of every item that is near enough to a text's window."""
        get = self.vocab.get
        per = [[get(w, 0) for w in words_of(t)] for t in texts]
        tokens = np.array([x for ids in per for x in (*ids, self.pad)], dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum([len(ids) + 1 for ids in per])))
        spots = defaultdict(list)
        item, place = self.candidates(tokens)
        bounds = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            k = int(item[low])
            for p in self.plausible(tokens, k, place[low:high]).tolist():
                # The texts whose words the item's place touches; one may begin before its text, where the passage has lost its front.
                first = max(0, int(np.searchsorted(begins, p, side="right")) - 1)
                for d in range(first, len(texts)):
                    if begins[d] >= p + len(self.ids[k]):
                        break
                    spots[d, k].append(int(p - begins[d]))
        out = []
        for (d, k), starts in sorted(spots.items()):
            ids, item, most = per[d], self.ids[k].tolist(), self.most[k]
            n, have, best = len(item), Counter(item), None
            last = -(1 << 60)
            for p in sorted(starts):
                if p <= last + most // 2:
                    continue  # the region around the last start holds this one's
                last = p
                if ids[max(0, p) : max(0, p) + n] == item:
                    best = (0, p, None)
                    break
                a, b = max(0, p - most), min(len(ids), p + n + 2 * most + most // 2)
                if (have & Counter(ids[a:b])).total() < n - most:
                    continue
                dist = least_distance(item, ids[a:b])
                if dist <= most and (best is None or dist < best[0]):
                    best = (dist, a, b)
            if best is not None:
                dist, a, b = best
                s, e = (max(0, a), max(0, a) + n) if b is None else (a + x for x in best_window(item, ids[a:b])[1:])
                out.append((d, k, dist, s, e))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item of which the document has a passage.

    Columns: doc_id, item_id, n_words (of the item), edit_distance, similarity (1 - edit_distance / n_words, at least the
    parameter), word_start, word_end: the nearest window in the document, the first of equal ones. Words are runs of letters,
    digits and underscores, lower-cased. Items without words (null, empty) match nothing, nor do texts without. Null ids
    come out null; repeated rows give repeated rows. Other columns aren't read. Items are read in blocks of about 5000,
    each a pass over the documents, so what a task holds of them is bounded. Of passages at the full allowed distance about RECALL are found, of exact ones all.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(rows, {"doc_id": "long"}, benchmark, item_col, item_text, similarity)


def _found(rows: DataFrame, carry: dict[str, str], benchmark: DataFrame, item_col: str, item_text: str, similarity: float) -> DataFrame:
    """What contaminated gives, with the columns (and their types) of rows in carry in the place of doc_id."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.trim("text") != "")
    blocks = max(1, -(-items.count() // _BLOCK_ROWS))
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = Index(sorted(map(tuple, own.collect()), key=str), similarity)
        index.items = [(i, len(w)) for i, w in index.items]

        def run(state, cols, texts, index=index):
            found = index.matches(texts)
            n = [index.items[k][1] for _, k, *_ in found]
            return {c: [cols[c][d] for d, *_ in found] for c in carry} | {
                "item_id": [index.items[k][0] for _, k, *_ in found],
                "n_words": n,
                "edit_distance": [e for _, _, e, *_ in found],
                "similarity": [1 - x[2] / m for x, m in zip(found, n, strict=True)],
                "word_start": [x[3] for x in found],
                "word_end": [x[4] for x in found],
            }

        part = map_texts(rows, run, "".join(f"{c} {kind}, " for c, kind in carry.items()) + "item_id long, n_words int, edit_distance int, similarity double, word_start int, word_end int", most=4 << 20)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of docs without a passage of the benchmark; rows and columns are otherwise those of docs.

    A row is known by its id and its text's 64-bit hash, so of rows that share an id (or have none) only those with a passage go.
    """
    marked = docs.select(key_of(id_col).alias("__key"), mark_of(text_col).alias("__mark"), F.col(text_col).alias("text"))
    bad = _found(marked, {"__key": "long", "__mark": "long"}, benchmark, item_col, item_text, similarity).select("__key", "__mark").distinct()
    rows = docs.withColumns({"__key": key_of(id_col), "__mark": mark_of(text_col)})
    return rows.join(bad, ["__key", "__mark"], "left_anti").select(docs.columns)
