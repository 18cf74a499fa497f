"""Quality scores by a generalised additive model with pairwise interactions (operator 8).

Features of a text are cut into bins. Shallow trees, one feature after the other in turn, are boosted on the logistic loss,
each adding its leaves to its feature's lookup table; afterwards the pairs of features that explain most of what is left
get tables of their own in the same way. A score is the sum of the looked-up values through the logistic function,
for whole batches at once.

Null texts count as empty; empty texts have features like any other and so a score. Equal texts get equal scores. Without
labelled rows of both classes the tables stay empty and every score is the training share of label 1, or one half. Rows that
share a doc_id are rows of their own; of several labels of an id the least counts. Further columns, whatever their names, are
of no account. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_text, settle
from quern.llm.labels import held_out, sample

FEATURES = ["log_words", "mean_word", "upper", "symbols", "bangs", "pipes", "digits", "stops", "commas", "distinct", "repeats", "marked", "capital_words", "line_words"]
#: Labelled rows of each class that training may see.
MOST_ROWS = 10_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8

_CLASS = np.zeros((256, 6), np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^~+=<>\\/_{}[]", b"!", b"|", b"0123456789", b".?")):
    _CLASS[list(_chars), _k] = 1


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, symbols, bangs, pipes, digits, stops = (by_byte @ _CLASS).tolist()
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    alnum = sum(map(bytes.isalpha, words))
    titles = sum(map(bytes.isupper, words))
    return [math.log1p(len(words)), len(raw) / n, upper / size, symbols / size, bangs / size, pipes / size, digits / size, stops / n, int(by_byte[44]) / n, distinct / n, repeats / n, 1 - alnum / n, titles / n, math.log(n / (1 + int(by_byte[10])))]


class Gam:
    """Lookup tables for binned features and pairs of them."""

    def __init__(self, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1, least: int = 20):
        self.rounds, self.pair_rounds, self.rate, self.least = rounds, pair_rounds, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n, width = x.shape if len(x) else (0, len(FEATURES))
        share = float(y.mean()) if n else 0.5
        share = min(max(share, 1e-4), 1 - 1e-4)
        self.bias = math.log(share / (1 - share)) if n else 0.0
        self.edges = [self._edges(x[:, k], BINS) for k in range(width)]
        self.coarse = [self._edges(x[:, k], PAIR_BINS) for k in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not n or len(set(y.tolist())) < 2:
            return self
        bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]
        margin = np.full(n, self.bias)
        for _ in range(self.rounds):
            for k in range(width):
                p = 1 / (1 + np.exp(-margin))
                step = self._tree(bins[k], y - p, p * (1 - p), len(self.tables[k]))
                self.tables[k] += step
                margin += step[bins[k]]
        coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.coarse)]
        p = 1 / (1 + np.exp(-margin))
        gains = []
        for a, b in combinations(range(width), 2):
            m = len(self.coarse[b]) + 1
            cell = coarse[a] * m + coarse[b]
            g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            gains.append((float((g * g / (h + 5)).sum()), a, b))
        for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((a, b))
            self.pair_tables.append(np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)))
        for _ in range(self.pair_rounds):
            for t, (a, b) in zip(self.pair_tables, self.pairs, strict=True):
                p = 1 / (1 + np.exp(-margin))
                step = self._pair_tree(coarse[a], coarse[b], y - p, p * (1 - p), t.shape)
                t += step
                margin += step[coarse[a], coarse[b]]
        return self

    @staticmethod
    def _edges(values: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)

    def _cut(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int:
        """The bin before which to cut for the most gain, 0 if nowhere."""
        cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        if not len(cg):
            return 0
        gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(cn < self.least) | (n.sum() - cn < self.least)] = 0
        return int(gain.argmax()) + 1 if gain.max() > 1e-9 else 0

    def _tree(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
        """A tree with up to four leaves over the bins of one feature, as a table."""
        g, h, n = np.bincount(bins, g, size), np.bincount(bins, h, size), np.bincount(bins, minlength=size)
        parts = [(0, size)]
        for _ in range(2):
            parts = [q for a, z in parts for c in [self._cut(g[a:z], h[a:z], n[a:z])] for q in ([(a, a + c), (a + c, z)] if c else [(a, z)])]
        out = np.zeros(size)
        for a, z in parts:
            out[a:z] = self.rate * g[a:z].sum() / (h[a:z].sum() + 1)
        return out

    def _pair_tree(self, a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, shape: tuple) -> np.ndarray:
        """Cuts the first feature, then each side along the second."""
        cell, size = a * shape[1] + b, shape[0] * shape[1]
        g, h, n = (np.bincount(cell, w, size).reshape(shape) for w in (g, h, np.ones(len(a))))
        out, c = np.zeros(shape), self._cut(g.sum(1), h.sum(1), n.sum(1))
        for x, z in [(0, c), (c, shape[0])] if c else [(0, shape[0])]:
            d = self._cut(g[x:z].sum(0), h[x:z].sum(0), n[x:z].sum(0))
            for u, w in [(0, d), (d, shape[1])] if d else [(0, shape[1])]:
                out[x:z, u:w] = self.rate * g[x:z, u:w].sum() / (h[x:z, u:w].sum() + 1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            margin += t[np.searchsorted(e, x[:, k], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            margin += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-margin))


def train(docs: DataFrame, labels: DataFrame, unseen=None, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """A model from at most 2 * most labelled rows; what reaches the driver is their features, a few MB at most."""
    unseen = held_out("doc_id", 5, 0) if unseen is None else unseen
    rows = sample(docs, labels, "quality", unseen, most, id_col, text_col)

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        settle()
        return texts.map(features)

    got = sorted((r[0], r[1], r[2]) for r in rows.select("doc_id", "label", of("text")).collect())
    return Gam().fit(np.array([f for _, _, f in got]).reshape(-1, len(FEATURES)), np.array([label for _, label, _ in got], float))


def scorer(model: Gam):
    """A column function that scores texts."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        settle()
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

    return score


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; scoring takes no shuffle."""
    rows = id_text(docs, id_col, text_col)
    scored = rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), scorer(train(docs, labels, None, MOST_ROWS, id_col, text_col))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
