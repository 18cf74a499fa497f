"""Toxicity scores of texts restored by noisy-channel decoding (operator 5).

What looks disguised, that is leetspeak (1d10t), spelling with gaps (i d i o t, i.d.i.o.t) or repetition (idiooot), becomes a
lattice: each place offers letters at the cost of the disguise, gaps may vanish, runs of a letter may shrink to one or two.
The best path under a character trigram model of all texts' plain words, found by the Viterbi algorithm, replaces it. The restored text is scored by its words and their beginnings: those that training rows show to be signs of toxicity
weigh in as in a noisy or, and a logistic curve turns the weights of the strongest three into a score.

Null texts count as empty; empty texts have no signs and get the score of those. Equal texts get equal scores. Without
labelled rows of both classes there are no signs, and every score is the same. Rows that share a doc_id are rows of their own;
of several labels of an id the least counts. Further columns, whatever their names, are of no account. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow, cut, id_text, settle, slices, tidy
from quern.llm.labels import held_out, sample

#: Labelled rows of each class that training may see, and signs kept.
MOST_ROWS, MOST_SIGNS = 5_000, 4_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: What letters a sign stands for in disguise.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
GAPS = set(".-_*~'`^:,")
_SIGNS = "".join(c for c in LEET if not c.isalnum())
_EDGE = re.compile(rf"^[^\w{re.escape(_SIGNS)}]+|[^\w{re.escape(_SIGNS)}]+$")
_PLAIN_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_ODD = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")


#: Latin letters lie below this; 0 for white space, 1 for such a letter, 2 for all else.
_LATIN = 0x250
_KIND = np.array([0 if chr(c).isspace() else 1 if c < _LATIN and chr(c).isalpha() else 2 for c in range(0x3001)] + [2], np.uint8)


class Letters:
    """Character trigrams with add-one smoothing over the letters seen; words begin and end with a blank."""

    def __init__(self, words: dict[str, int] | None = None, trigrams: dict[str, int] | None = None):
        self.three, self.two = Counter(trigrams or {}), Counter()
        for word, n in (words or {}).items():
            padded = f"  {word} "
            for k in range(2, len(padded)):
                self.three[padded[k - 2 : k + 1]] += n
        for t, n in self.three.items():
            self.two[t[:2]] += n
        self.size = max(2, len({t[2] for t in self.three}))

    def cost(self, a: str, b: str, c: str) -> float:
        return -math.log((self.three.get(a + b + c, 0) + 0.1) / (self.two.get(a + b, 0) + 0.1 * self.size))


def trigrams(texts: list[str]) -> Counter:
    """Trigrams of the plain words of texts: those of Latin letters alone, between white space."""
    code = np.frombuffer(" ".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = _KIND[np.minimum(code, len(_KIND) - 1)]
    word = np.cumsum(kind == 0)
    spoilt = np.bincount(word[kind == 2], minlength=int(word[-1]) + 1) > 0
    at = np.flatnonzero((kind == 1) & ~spoilt[word])
    # what stands before a letter; a blank wherever the word has not begun yet
    one = np.where(kind[at - 1] == 1, code[at - 1], 32)
    two = np.where((one != 32) & (kind[at - 2] == 1), code[at - 2], 32)
    last = kind[at + 1] == 0
    # the letters that occur, numbered
    letters = np.flatnonzero(np.bincount(np.append(code[at], 32)))
    n, number = len(letters), np.zeros(_LATIN, np.int64)
    number[letters] = np.arange(n)
    one, two, own, blank = number[one], number[two], number[code[at]], number[32]
    counts = np.bincount(np.concatenate([(two * n + one) * n + own, (one[last] * n + own[last]) * n + blank]))
    names = [chr(c) for c in letters.tolist()]
    return Counter({names[c // n**2] + names[c // n % n] + names[c % n]: int(counts[c]) for c in np.flatnonzero(counts).tolist()})


def letters_of(docs: DataFrame) -> Letters:
    """The trigram model of all texts. What reaches the driver is a row a trigram, bounded by the Latin alphabet."""
    schema = pa.schema([("t", pa.string()), ("n", pa.int64())])

    def run(batches):
        for batch in slices(batches, 1 << 20):
            yield arrow(schema, trigrams([t or "" for t in batch.column(0).to_pylist()]).items())

    counted = docs.select("text").mapInArrow(tidy(run), "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return Letters(trigrams={r[0]: r[1] for r in counted.collect()})


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it may stand for, and the cost of that. Signs at either end may be none."""
    out, k = [], 0
    first, last = len(token) - len(token.lstrip(_SIGNS)), len(token.rstrip(_SIGNS))
    while k < len(token):
        c, n = token[k], 1
        while k + n < len(token) and token[k + n] == c:
            n += 1
        k += n
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways = [(c, 0.0 if n == 1 else 1.0)] + [(c * 2, 0.0 if n == 2 else 1.0)] * (n > 1)
        for letter in LEET.get(c, ""):
            ways += [(letter, 0.5)] + [(letter * 2, 0.7)] * (n > 1)
        if c in GAPS or c == " ":
            ways.append(("", 0.3))
        elif c in _SIGNS and (k <= first or k > last):
            ways.append(("", 1.0))
        if not ways:
            ways = [("", 4.0)]
        out.append(ways)
    return out


def decode(token: str, letters: Letters) -> str:
    """The letters of the best path."""
    # texts as (text before, last letters), put together in the end
    paths: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for ways in lattice(token):
        new: dict[str, tuple[float, tuple]] = {}
        for (a, b), (cost, text) in paths.items():
            for way, extra in ways:
                x, y, total = a, b, cost + extra
                for c in way:
                    total += letters.cost(x, y, c)
                    x, y = y, c
                state = x + y
                if state not in new or total < new[state][0]:
                    new[state] = total, (text, way) if way else text
        paths = new

    def spelled(text: tuple) -> str:
        out = []
        while text:
            text, way = text
            out.append(way)
        return "".join(reversed(out))

    return min((cost + letters.cost(s[0], s[1], " "), spelled(text)) for s, (cost, text) in paths.items())[1]


def disguised(core: str) -> bool:
    return not core.isalpha() and bool(_ODD.search(core)) or bool(_RUN.search(core))


def units(text: str | None, longest: int = 16) -> set[str]:
    """A text's words, lower-cased, with those of single letters in a row (i d i o t) as one, blanks kept.

    Of a row its stretches of up to longest letters, and all of it.
    """
    words = text.lower().split() if text else []
    out = set(words)
    single = bytes([len(w) == 1 for w in words])
    k = single.find(b"\x01\x01\x01")
    while k >= 0:
        z = k
        while z < len(single) and single[z]:
            z += 1
        for a in range(k, z - 2):  # whatever stretch of them spells a word
            for b in range(a + 3, min(z, a + longest) + 1):
                out.add(" ".join(words[a:b]))
        out.add(" ".join(words[k:z]))
        k = single.find(b"\x01\x01\x01", z)
    return out


def restored(unit: str, letters: Letters) -> str:
    if unit.isalpha() and not _RUN.search(unit):
        return unit
    if " " in unit:
        return decode(unit, letters)
    core = _EDGE.sub("", unit)
    return decode(core, letters) if len(core) > 2 and disguised(core) else _PLAIN_EDGE.sub("", core)


def readings(unit: str, letters: Letters) -> set[str]:
    """The restored word, and the word without its edge signs if it is plain then: +idiot may be one or the other."""
    core = _PLAIN_EDGE.sub("", unit)
    return {restored(unit, letters), core} if core.isalpha() and not _RUN.search(core) else {restored(unit, letters)}


def signs(word: str) -> list[str]:
    """A word and its beginnings; a stem by itself is a word of its own, which may well be harmless."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if len(word) > 1 else []


class Model:
    """Signs with their weights, and the curve from the strongest ones to a score."""

    def __init__(self, letters: Letters, weights: dict[str, float], curve=(-4.0, 4.0, 1.0)):
        self.letters, self.weights, self.curve = letters, weights, curve
        self.seen: dict[str, tuple[str, float] | None] = {}
        # no longer stretch can spell a sign
        self.longest = max([16, *map(len, weights)])

    def of(self, unit: str) -> tuple[str, float] | None:
        """A unit's strongest sign."""
        found = (s for word in readings(unit, self.letters) for s in signs(word))
        return max(((s, self.weights[s]) for s in found if s in self.weights), key=lambda x: (x[1], x[0]), default=None)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Whether there is a sign, and the log odds that one of the three strongest different ones speaks true."""
        found, seen = {}, self.seen
        for u in units(text, self.longest):
            try:
                got = seen[u]
            except KeyError:
                got = self.of(u)
                if len(u) < 40:
                    if len(seen) > 400_000:
                        seen.clear()
                    seen[u] = got
            if got:
                found[got[0]] = got[1]
        top = sorted(found.values(), reverse=True)
        return (1.0, math.log(math.expm1(min(sum(top[:3]), 500.0)))) if top else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-(self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.evidence(text), strict=True)))))


def _fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, ...]:
    """Logistic regression by Newton steps; rows weighted so that label 1 has its true share."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.5
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * w)
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, unseen=None, most: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most 2 * most labelled rows; counts are summed over the executors, signs with few rows stay there."""
    unseen = held_out("doc_id", 3, 1) if unseen is None else unseen
    rows = sample(docs, labels, "toxic", unseen, most, id_col, text_col)
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(Letters({}), {})

    letters = letters_of(id_text(docs, id_col, text_col))

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        settle()
        return texts.map(lambda t: sorted({s for u in units(t) for w in readings(u, letters) for s in signs(w)}))

    half = F.xxhash64(F.lit("curve"), "doc_id") % 3 == 0
    counts = rows.where(~half).select("label", F.explode(of("text")).alias("s")).groupBy("s").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    m = {r[0]: r[1] for r in rows.where(~half).groupBy("label").count().collect()}
    odds = F.log((F.col("t") + 0.5) / (m.get(1, 0) + 1.0)) - F.log((F.col("c") + 0.5) / (m.get(0, 0) + 1.0))
    # twice the log likelihood ratio against no difference between the classes, over what so many candidates reach by chance
    share_of_1 = m.get(1, 0) / max(1, m.get(0, 0) + m.get(1, 0))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((F.col("t") + F.col("c")) * share))).otherwise(0.0)
    surprise = 2 * (part(F.col("t"), share_of_1) + part(F.col("c"), 1 - share_of_1))
    counts = cut(counts)
    least = 2 * math.log(max(1, counts.count()))
    strong = counts.where("t >= 4").withColumn("w", odds).where((F.col("w") >= 2.5) & (surprise >= least)).orderBy(F.desc("w"), F.desc("t"), "s").limit(MOST_SIGNS).select("s", "w").collect()
    # a sign's log odds with the true share of label 1 behind it, as what it adds to the log of a text being without fault
    share = float(labels.where(~unseen & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0])
    prior = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    model = Model(letters, {s: math.log1p(math.exp(w + prior)) for s, w in strong})

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        settle()
        return texts.map(lambda t: list(model.evidence(t)))

    got = sorted((r[0], r[1], *r[2]) for r in rows.where(half).select("doc_id", "label", evidence("text")).collect())
    y = np.array([r[1] for r in got], float)
    if 0 < y.sum() < len(y):
        model.curve = _fit_curve(np.array([r[2:] for r in got]), y, share)
    model.seen = {}
    return model


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; scoring takes no shuffle."""
    model = train(docs, labels, None, MOST_ROWS, id_col, text_col)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        settle()
        return texts.map(model.score)

    scored = id_text(docs, id_col, text_col).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
