"""URL verdicts by rules and by logistic regression on hashed character n-grams of host and path (operator 4).

Host, path and rule are columns of the JVM. A rule (host, path prefix) fits its host and all subdomains; the longest that
fits decides. Else the model does, trained here on seeds(), a small labelled table of made-up URLs of general words; its
weights (DIMS numbers) go to the tasks.

A null url, or one without ://, has an empty host and path; no rule fits it, and the model judges the empty strings. Equal
urls get equal verdicts; urls may be of any length; repeated rows each come back; further columns are of no account. An
empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 15
GRAMS = (3, 4, 5)
#: What a web crawl for text leaves out: gambling, drugs by mail, sex, advertising, easy money, pirated goods.
UNWANTED = (
    "casino poker slots jackpot roulette bets betting sportsbet lottery bingo blackjack gamble "
    "viagra cialis pills meds pharma steroids slimming botox "
    "porn xxx sex adult nude escort cams hookup milf erotic dating "
    "spam clickbait ads adserver adclick banner popup tracker pixel telemetry affiliate "
    "payday loans forex bitcoin-profit earn-money get-rich free-money prize giveaway sweepstakes cashback "
    "torrent warez crack keygen serials replica counterfeit followers backlinks essays linkfarm doorway"
).split()
#: What it keeps; some look like the others: essex, adulthood, betterment, specialist, loanwords, cracker.
WANTED = (
    "news library museum university school research science journal archive history weather climate garden cooking recipes "
    "travel maps railway health hospital clinic law court parliament books poetry music orchestra theatre film football "
    "cycling chess wiki docs manual forum blog notes photos birds forest ocean river mountain town council village farm "
    "essex adulthood betterment specialist loanwords cracker sextant address downloads headset winery pricing market "
    "academy engineering physics biology dictionary grammar language teacher student kitchen bakery gallery painting "
    "software compiler database networks hardware printing carpentry knitting sailing hiking skiing swimming athletics"
).split()
_HOSTS = ("{}.com", "www.{}.org", "{}-online.net", "best-{}.biz", "{}24.info", "my{}.co.uk", "{}.example.com", "the.{}.site.org", "{}-world.de", "shop.{}.fr")
#: Words that stand beside those of either kind in a host's name.
PARTNERS = "free best cheap top win farm track city open daily hub zone pro club land point room box link plus".split()
_JOINED = ("{a}-{b}.com", "{b}-{a}.org", "{a}{b}.info", "www.{b}{a}.co.uk")
_NEUTRAL = ("", "/", "/index.html", "/en/{}", "/de/{}", "/page/{}", "/{}", "/fr/{}/", "/a/b/{}.php", "/id/{}")
_PATHS = (("/news/article-{}", "/wiki/history_{}", "/docs/guide/{}", "/blog/post/{}", "/library/book/{}"), ("/play/bonus/{}", "/free/win/{}", "/cheap/buy-now/{}", "/click/ad/{}", "/xxx/video/{}"))

#: (rule, verdict): host, then the path that a url's must start with.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def seeds(partners=tuple(PARTNERS)) -> list[tuple[str, str, int]]:
    """(host, path, label), label 1: to block. Both kinds have the same hosts, partners and paths around their words, and
    some paths of their own."""
    out = [("", "", 0)]
    for label, words in ((0, WANTED), (1, UNWANTED)):
        for k, word in enumerate(words):
            for j in range(6):
                host = _HOSTS[(k + 3 * j) % len(_HOSTS)].format(word)
                paths = _PATHS[label] if j == 5 else _NEUTRAL
                out.append((host, paths[(7 * k + j) % len(paths)].format((k * 37 + j * 11) % 900), label))
            for j in range(6):
                host = _JOINED[(k + j) % len(_JOINED)].format(a=word, b=partners[(5 * k + 3 * j) % len(partners)])
                out.append((host, _NEUTRAL[(3 * k + j) % len(_NEUTRAL)].format((k * 53 + j * 7) % 900), label))
    return out


def grams(hosts, paths) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the different character n-grams of each host and path, each kind hashed apart."""
    found = []
    for kind, texts in enumerate((hosts, paths)):
        marked = [f"^{t}$" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(marked)), [len(t) for t in marked])
        for n in GRAMS:
            if len(code) < n:
                continue
            h = np.full(len(code) - n + 1, 2 * n + kind, np.uint64)
            for k in range(n):
                h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            whole = row[: len(h)] == row[n - 1 :]
            found.append(row[: len(h)][whole] * DIMS + (h[whole] % np.uint64(DIMS)).astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // DIMS, both % DIMS


def probabilities(hosts, paths, w: np.ndarray, b: float) -> np.ndarray:
    row, slot = grams(hosts, paths)
    size = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
    return 1 / (1 + np.exp(-(np.bincount(row, w[slot], len(hosts)) / size + b)))


def fit(rows: list[tuple[str, str, int]], steps: int = 800, rate: float = 80.0, decay: float = 5e-6) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent over all rows; both kinds weigh the same."""
    hosts, paths, labels = zip(*rows, strict=True)
    row, slot = grams(hosts, paths)
    y = np.array(labels, float)
    x = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))
    w, b, weight = np.zeros(DIMS), 0.0, np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-(np.bincount(row, w[slot], len(y)) * x + b))) - y)
        w -= rate * (np.bincount(slot, (g * x)[row], DIMS) + decay * w)
        b -= g.sum()
    return w, b


@lru_cache(1)
def model() -> tuple[np.ndarray, float]:
    return fit(seeds())


def host_path(url_col: str = "url"):
    """Host and path as columns."""
    url = F.col(url_col).cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), letters, letters.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules=tuple(RULES), threshold: float = 0.8, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and block_score, the model's probability; no shuffle."""
    w, b = model()

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series(probabilities(hosts.tolist(), paths.tolist(), w, b))

    host, path = host_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    fitting = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, _, start = rule.partition("/")
        fitting = F.when(((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{start}"), F.lit(rule)).otherwise(fitting)
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules:
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    scored = rows.select("page_id", "host", "path", fitting.alias("rule"), score("host", "path").alias("block_score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_score")
