"""Toxicity by a factorization machine over hashed words and word beginnings.

score = sigmoid(b + sum of w of the text's words + sum over pairs of words of <v_i, v_j>): the pairs let a
word weigh more, or less, beside another (an insult beside a group's name), which no sum of weights can say.

Columns are the terms that tell the labels apart for themselves, and of the FREQUENT most frequent ones those that do beside another: terms of pairs that come
with label 1 more or less often than what each of the two adds. Others would let the machine learn its sample by heart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import map_texts, remainder_of
from doclens.llm.hashed import Sample, Terms, flat, numbered, row_sums, sample, telling, words_and_stems

#: Of how many of the most frequent terms all pairs are looked at.
FREQUENT = 2048


@dataclass
class Model:
    columns: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        ids, bounds = flat(rows)
        return forward(self.bias, self.w, self.v, ids, bounds)[0]


def forward(bias: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = v[ids]
    total = row_sums(own, bounds)
    pairs = 0.5 * ((total**2).sum(axis=1) - row_sums((own**2).sum(axis=1), bounds))
    return bias + row_sums(w[ids], bounds) + pairs, total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def pick(every: np.ndarray, ones: np.ndarray, n: int, n1: int, least: int = 8) -> np.ndarray:
    """The telling buckets, and the FREQUENT most frequent others that at least `least` rows have and lack."""
    usual = np.where((every >= least) & (every <= n - least), every, 0)
    top = np.argsort(-usual, kind="stable")[:FREQUENT]
    kept = telling(every, ones, n, n1)
    kept[top[usual[top] > 0]] = True
    return kept


def of_telling_pairs(rows: list[np.ndarray], y: np.ndarray, columns: np.ndarray, least: int = 8, z: float = 5.5) -> np.ndarray:
    """Of some columns, those of a pair whose share of label 1 differs by `z` standard errors from what the two columns add up to.

    With the shares p of rows with both, one, or none of the two, that is p11 - p10 - p01 + p00. Among two million pairs, chance hardly gives one.
    """
    place = np.full(int(columns.max()) + 1 if len(columns) else 1, -1)
    place[columns] = np.arange(len(columns))
    x = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for i, r in enumerate(rows):
        k = place[r[r < len(place)]]
        x[i, k[k >= 0]] = 1
    one = x[y == 1]
    n, k, usual, tells = x.sum(axis=0), one.sum(axis=0), y.mean(), np.zeros(len(columns), dtype=bool)
    for at in range(0, len(columns), 256):  # the tables of all pairs at once would be large
        own = slice(at, at + 256)
        n11, k11 = x[:, own].T @ x, one[:, own].T @ one
        n10, k10, n01, k01 = n[own, None] - n11, k[own, None] - k11, n[None, :] - n11, k[None, :] - k11
        n00, k00 = len(rows) - n11 - n10 - n01, y.sum() - k11 - k10 - k01
        differs, variance, seen = np.zeros_like(n11), np.full_like(n11, 1e-9), np.ones(n11.shape, dtype=bool)
        for m, ones, sign in ((n11, k11, 1), (n10, k10, -1), (n01, k01, -1), (n00, k00, 1)):
            p = (ones + usual) / (m + 1)
            differs += sign * p
            variance += p * (1 - p) / (m + 1)
            seen &= m >= least
        tells[own] = (seen & (np.abs(differs) >= z * np.sqrt(variance))).any(axis=1)
    return columns[tells]


def narrowed(found: Sample) -> Sample:
    """The sample with the telling columns alone, for themselves or in pairs."""
    every = np.bincount(np.concatenate(found.rows) if found.rows else np.zeros(0, dtype=np.int64), minlength=found.n)
    ones = np.bincount(np.concatenate([r for r, k in zip(found.rows, found.y, strict=True) if k == 1] or [np.zeros(0, dtype=np.int64)]), minlength=found.n)
    kept = telling(every, ones, len(found.rows), int((found.y == 1).sum()))
    if len(set(found.y.tolist())) == 2:
        top = np.argsort(-every, kind="stable")[:FREQUENT]
        kept[of_telling_pairs(found.rows, (found.y == 1).astype(np.int64), np.sort(top))] = True
    new, n = numbered(kept)
    columns = found.columns.copy()
    columns[columns >= 0] = new[columns[columns >= 0]]
    return Sample(columns, n, [new[r][new[r] >= 0] for r in found.rows], found.y, found.weight)


def fit(found: Sample, factors: int = 4, rounds: int = 20, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the logistic loss. Rows are sampled in equal shares of the labels, and scores are those of equal shares: how often a label is says nothing of a text.

    Without rows of both labels, the score is the smoothed share of label 1 for any text.
    """
    found = narrowed(found)
    columns, n, y, weight = found.columns, found.n, found.y, found.weight
    share = (weight[y == 1].sum() + 1) / (weight.sum() + 2) if len(y) else 0.0
    odds = float(np.log(share / (1 - share))) if share else -6.0
    if len(set(y.tolist())) < 2:
        return Model(columns, odds, np.zeros(n), np.zeros((n, factors)))
    rng = np.random.default_rng(seed)
    kept = found.rows
    params = [np.zeros(1), np.zeros(n), rng.normal(0, 0.05, (n, factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    rounds = max(rounds, 400 * batch // len(y))  # with few rows, 400 steps at least
    for k in range(rounds):
        now = rate if k < 0.7 * rounds else rate / 5
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            ids, bounds = flat([kept[i] for i in own])
            score, total = forward(float(params[0][0]), params[1], params[2], ids, bounds)
            g = (_sigmoid(score) - y[own]) / len(own)
            each = np.repeat(g, np.diff(bounds))
            sums = np.repeat(total, np.diff(bounds), axis=0)
            dv = (sums - params[2][ids]) * each[:, None]
            grads = [np.array([g.sum()]), np.bincount(ids, each, n) + decay * params[1] / 10, np.stack([np.bincount(ids, dv[:, f], n) for f in range(factors)], axis=1) + decay * params[2]]
            step += 1
            for p, d, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
    balanced = (y == 1).sum() / (y == 0).sum()
    return Model(columns, float(params[0][0]) - float(np.log(balanced)), params[1], params[2])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 12000) -> Model:
    """A model of labels.label_col (0 or 1) by id, from at most about `most` labelled documents."""
    return fit(sample(docs, labels.select(id_col, F.col(label_col).alias("label")), words_and_stems, most, pick, id_col, text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs: the probability of label 1 where both labels are equally frequent. A null text counts as empty; an empty one, or one without known words, gets the
    bias alone. Repeated rows and null ids stay. Other columns aren't read."""
    kind = dict(docs.dtypes)[id_col]

    def run(find, cols, texts):
        return {"doc_id": cols["doc_id"], "score": _sigmoid(model.logits([find(t) for t in texts]))}

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double", lambda: Terms(words_and_stems, model.columns))


def predict(docs: DataFrame, labels: DataFrame, most: int = 12000, threshold: float = 0.7) -> DataFrame:
    """The op7 result: learned from labels of ids that aren't held out, for every row of docs.

    A row without an id isn't held out; equal texts get equal scores; nulls, repeats and very long texts as in score.
    """
    held = F.coalesce(remainder_of("doc_id", 3) == 1, F.lit(False))
    model = learn(docs.where(~held), labels.where(~held), most=most)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
