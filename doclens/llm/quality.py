"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(f(text) - t_k): all grades share one weight for each hashed term, and have
thresholds t_1 <= t_2 <= ... of their own. From these come the expected grade and the tail probability
P(grade >= wanted) that selection goes by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import map_texts
from doclens.llm.hashed import Sample, Terms, flat, often, row_sums, sample, words_and_shapes


@dataclass
class Model:
    columns: np.ndarray
    grades: np.ndarray
    thresholds: np.ndarray
    w: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= grades[k]) of each row for each k from 1."""
        ids, bounds = flat(rows)
        f = row_sums(self.w[ids], bounds) / np.sqrt(np.maximum(1, np.diff(bounds)))
        return _sigmoid(f[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(params: list[np.ndarray], ids: np.ndarray, bounds: np.ndarray, level: np.ndarray, scale: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The negative log-likelihood of rows (columns ids[bounds[i]:bounds[i + 1]]) at their levels, each counted by scale, and its gradients.

    params are the weights, the first threshold, and the logarithms of the gaps between thresholds.
    """
    size = np.sqrt(np.maximum(1, np.diff(bounds)))
    f = row_sums(params[0][ids], bounds) / size
    gaps = np.exp(params[2])
    t = np.concatenate((params[1], params[1] + np.cumsum(gaps)))
    n, k = len(level), len(t)
    up = np.concatenate((np.ones((n, 1)), _sigmoid(f[:, None] - t), np.zeros((n, 1))), axis=1)  # P(level >= j)
    here, above = up[np.arange(n), level], up[np.arange(n), level + 1]
    p = np.maximum(here - above, 1e-9)
    d_here, d_above = here * (1 - here) / p, above * (1 - above) / p
    df = -(d_here - d_above) * scale
    dt = np.zeros(k + 2)
    np.add.at(dt, level, d_here * scale)
    np.add.at(dt, level + 1, -d_above * scale)
    dt = dt[1 : k + 1]
    return float(-(np.log(p) * scale).sum()), [np.bincount(ids, np.repeat(df / size, np.diff(bounds)), len(params[0])), np.array([dt.sum()]), np.array([dt[i + 1 :].sum() for i in range(k - 1)]) * gaps]


def fit(found: Sample, rounds: int = 15, batch: int = 500, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam on the cumulative-link log-likelihood; each row counts by its weight, so grades have the shares of all ratings.

    The gaps between thresholds are learned as exponentials, so they stay in order. With one grade, all texts get it.
    """
    columns, n, y, weight = found.columns, found.n, found.y, found.weight
    grades = np.unique(y)
    k = len(grades) - 1
    if k < 1:
        return Model(columns, grades if len(grades) else np.array([0]), np.zeros(0), np.zeros(n))
    level = np.searchsorted(grades, y)
    rng = np.random.default_rng(seed)
    kept = found.rows
    weight = weight / weight.mean()
    params = [np.zeros(n), np.zeros(1), np.zeros(k - 1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(rounds, 400 * batch // len(y))):  # with few rows, 400 steps at least
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            ids, bounds = flat([kept[i] for i in own])
            grads = gradients(params, ids, bounds, level[own], weight[own] / len(own))[1]
            grads[0] += decay * params[0]
            step += 1
            for q, d, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                s += 0.001 * (d * d - s)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
    return Model(columns, grades, np.concatenate((params[1], params[1] + np.cumsum(np.exp(params[2])))), params[0])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 12000) -> Model:
    """A model of the grades labels.label_col (integers) by id, from at most about `most` rated documents."""
    return fit(sample(docs, labels.select(id_col, F.col(label_col).alias("label")), words_and_shapes, most, often, id_col, text_col))


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", wanted: int | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) of every row of docs.

    tail_probability is P(grade >= wanted), wanted being the highest learned grade unless given; keep says that it is at least `least`.
    A null text counts as empty. Repeated rows and null ids stay. Other columns aren't read.
    """
    kind = dict(docs.dtypes)[id_col]
    wanted = int(model.grades[-1]) if wanted is None else wanted

    def run(find, cols, texts):
        tails = model.tails([find(t) for t in texts])
        k = int(np.searchsorted(model.grades, wanted))
        expected = model.grades[0] + tails @ np.diff(model.grades)
        tail = np.ones(len(texts)) if k == 0 else np.zeros(len(texts)) if k == len(model.grades) else tails[:, k - 1]
        return {"doc_id": cols["doc_id"], "expected_grade": expected.astype(float), "tail_probability": tail, "keep": tail >= least}

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, expected_grade double, tail_probability double, keep boolean", lambda: Terms(words_and_shapes, model.columns))


def graded(docs: DataFrame, labels: DataFrame, most: int = 12000) -> DataFrame:
    """The op9 result: learned from the rated documents, for every row of docs. Equal texts get equal grades; nulls, repeats and very long texts as in rate."""
    return rate(docs, learn(docs, labels, most=most))
