"""Likeness of fingerprints at every length and for passages that little else shares."""

import random

import pytest

from quern.llm import fingerprint


def say(rng, n):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def near(a, b):
    return fingerprint.likeness(fingerprint.Prefixes(a), fingerprint.Prefixes(b))


def test_three_quarters_kept_are_seen_at_every_length():
    rng = random.Random(3)
    for n in range(4, 300):
        text, following = say(rng, n), say(rng, 400).upper()
        kept = n - n // 4
        assert kept / n <= near(text, fingerprint.edited(text, following)) <= kept / n + 0.2, n


def test_passages_shared_by_long_texts_are_seen():
    rng = random.Random(4)
    for _ in range(30):
        passage = say(rng, 300)
        a, b = (say(rng, 4000) + passage + say(rng, 4000) for _ in range(2))
        assert near(a, b) == pytest.approx(300 / 8300, abs=0.002)
