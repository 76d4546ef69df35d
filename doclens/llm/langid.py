"""Language identification with hyperdimensional profiles.

A letter (any code point that is one) has a random vector of +1 and -1 of its own. A letter trigram abc is bound as
roll(V[a], 2) * roll(V[b], 1) * V[c], a text is the sum (bundle) of its trigrams, and a
language is the sum of its learned texts, each scaled to length one. A text's language is
the one whose sum has the largest cosine with it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import bounded_sample, map_texts, remainder_of

DIM = 512
#: Above all code points: trigrams are numbers in this base. 0 is the gap between words.
BASE = 0x110000
#: Letters whose vectors a Python worker remembers.
REMEMBERED = 20_000
#: Languages that are learned at the most, which bounds the profiles.
LANGUAGES = 256
#: Bytes of text that are encoded at a time: the arrays of a piece are some 50 times as large.
_PIECE = 1 << 18


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(BASE)), dtype=bool, count=BASE)


@lru_cache(REMEMBERED)
def letter(code: int, dim: int = DIM) -> np.ndarray:
    """The vector of a code point, or of the gap (0)."""
    return np.random.default_rng([20, code]).choice(np.array([-1, 1], dtype=np.int8), size=dim)


def trigram_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bound vectors of trigram codes (a * BASE + b) * BASE + c, as float32."""
    abc = np.stack((codes // (BASE * BASE), codes // BASE % BASE, codes % BASE))
    used, place = np.unique(abc, return_inverse=True)
    v = np.stack([letter(int(c), dim) for c in used])
    a, b, c = place.reshape(abc.shape)
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def encode(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The bundles of texts (len(texts) x dim), and whether each has a letter.

    Case is folded; a run of other characters is one gap, which has a slot of its own, and a text is
    bounded by gaps, so that a text of one letter has a trigram too.
    """
    out, has = np.zeros((len(texts), dim), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    whole = np.frombuffer("\n\n".join(["", *(t.lower().replace("\n", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.where(_is_letter()[whole], whole, 0).astype(np.int64)
    ends = np.flatnonzero(whole == 10)[1::2]  # the second of each pair of line feeds: where texts begin
    doc = np.zeros(len(whole), dtype=np.int64)
    doc[ends[1:]] = 1
    doc = np.cumsum(doc)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    if len(s) < 3:
        return out, has
    codes = (s[:-2] * BASE + s[1:-1]) * BASE + s[2:]
    mid = doc[1:-1]
    inside = s[1:-1] > 0
    used, place = np.unique(codes[inside], return_inverse=True)
    if not len(used):
        return out, has
    pairs, counts = np.unique(mid[inside] * len(used) + place, return_counts=True)
    vectors = trigram_vectors(used, dim)
    d, g = pairs // len(used), pairs % len(used)
    starts = np.flatnonzero(np.diff(d, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(d)], strict=True):
        out[d[a]] = counts[a:b].astype(np.float32) @ vectors[g[a:b]]
        has[d[a]] = True
    return out, has


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 12000, dim: int = DIM, languages: int = LANGUAGES) -> dict[str, np.ndarray]:
    """The profile of each language of the labelled rows, from `most` of them at the most (null languages teach nothing).

    Of more than `languages` values of lang_col the most frequent ones are learned (ties: the first by name), so neither the sample nor
    the profiles grow with the values of a column that isn't clean. Each task sums its own texts; the driver gets one vector for each language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usual = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rows = bounded_sample(rows.where(F.col("lang").isin(usual)), most, "id", "lang")

    def sums(_, cols, texts):
        got, has = encode(texts, dim)
        total: dict[str, np.ndarray] = {}
        for lang, v, h in zip(cols["lang"], got, has, strict=True):
            if h:
                total[lang] = total.get(lang, 0) + v.astype(np.float64) / (np.linalg.norm(v) or 1)
        return {"lang": list(total), "v": [v.tolist() for v in total.values()]}

    parts = map_texts(rows.select("text", "lang"), sums, "lang string, v array<double>", most=_PIECE)
    sums_of = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    profiles = sums_of.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))  # dim numbers each
    out = {r.lang: np.array([x.x for x in r.v]) for r in profiles.collect()}
    return {k: out[k] / (np.linalg.norm(out[k]) or 1) for k in sorted(out)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), dim: int = DIM) -> DataFrame:
    """docs with lang_pred and score: id_col and the carried columns of docs, then these two.

    score is the cosine with the predicted language's profile, at least 0. A null or empty text and one
    without a letter is `und` with score 0, and so is every text when nothing was learned. Equal cosines:
    the first language by name. Every row, repeated ones and those with a null id too, gives one row;
    other columns of docs aren't read.
    """
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names]).T if names else np.zeros((dim, 0))
    kinds = dict(docs.dtypes)
    cols = [id_col, *carry]

    def run(_, others, texts):
        got, has = encode(texts, dim)
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if names:
            norms = np.linalg.norm(got, axis=1)
            # Row by row: a product of all rows at once would give equal texts cosines that differ in the last digit.
            cos = np.stack([row @ matrix for row in got.astype(np.float64)]) / np.where(norms > 0, norms, 1)[:, None]
            best = cos.argmax(axis=1)
            for i in np.flatnonzero(has):
                pred[i], score[i] = names[best[i]], float(min(1.0, max(0.0, cos[i, best[i]])))
        return {**others, "lang_pred": pred, "score": score}

    ordered = docs.select(*cols, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "lang_pred string", "score double"])
    return map_texts(ordered, run, schema, text="__text", most=_PIECE)


def predict(docs: DataFrame, most: int = 12000) -> DataFrame:
    """The op10 result: learned from the rows of docs that aren't held out, for every row of docs."""
    held = F.coalesce(remainder_of("doc_id", 4) == 2, F.lit(False))
    profiles = learn(docs.where(~held), most=most)
    return identify(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
