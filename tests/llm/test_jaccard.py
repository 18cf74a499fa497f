"""The pipeline's near-duplicates against all pairs."""

import random

import pytest

import corpus_pipeline
from quern.llm import jaccard, simhash
from quern.llm.components import components


def grams(text):
    w = (text or "").split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinrstlo") for _ in range(6))
    out = []
    for k in range(30):
        base = [word() for _ in range(rng.randint(120, 400))]
        out.append(" ".join(base))
        # every edit touches five shingles: similarities from about 0.7 to 0.95
        for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03)[k % 3 :: 2]:
            copy = list(base)
            for at in rng.sample(range(5, len(base) - 5), max(1, int(share * len(base)))):
                copy[at] = word()
            out.append(" ".join(copy))
    line = " ".join(word() for _ in range(60))
    out += [f"{line} {' '.join(word() for _ in range(60))}" for _ in range(40)]
    return [*out, out[0], None, "", " ", "a b", "a b", "a b c"]


def drifted():
    """Copies of copies: each differs a little from its neighbours and much from those further on; one text stands for many."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeinrstlo") for _ in range(6))
    now, out = [word() for _ in range(120)], []
    for _ in range(150):
        now = list(now)
        for _ in range(rng.choice([1, 1, 2, 4])):
            now[rng.randrange(120)] = word()
        out.append(" ".join(now))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("texts", "chunk", "rounds"), [(planted(), 16 << 20, 2), (drifted(), 4000, 0)])
def test_pairs_of_similarity_080_are_linked(spark, monkeypatch, texts, chunk, rounds):
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    sets = [grams(t) for t in texts]
    root, middling = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            alike = 1.0 if not union else len(sets[a] & sets[b]) / union
            middling += 0.8 <= alike < 0.9
            if alike >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert middling > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(root))
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert kept == set(root)


def test_fingerprints_are_linked_first(spark, monkeypatch):
    """Near copies within four bits of each other are joined by their fingerprints alone, with no list of min-hash values."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("aeinrstlo") for _ in range(6))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(400)] = word()
            texts.append(" ".join(copy))
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "_left", lambda mixed, sets: spark.createDataFrame([], "u long, v long"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    prints = [simhash.of_hashes(jaccard.shingles(t)) for t in texts]
    pairs = [(a, b) for a in range(120) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(pairs) > 60 and all(a // 4 == b // 4 for a, b in pairs)
    assert all(got[a] == got[b] for a, b in pairs)
    assert all(i // 4 == c // 4 for i, c in got.items()) and len(set(got.values())) > 30
    assert prints[0] == simhash.fingerprint(texts[0], 5) and simhash.of_hashes(jaccard.shingles("")) == 0


def test_few_links_are_joined_in_the_driver(spark, monkeypatch):
    rng = random.Random(14)
    nodes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    edges = [(a, b) for _ in range(300) for a, b in [rng.sample(nodes, 2)]] + [*zip(nodes[:60], nodes[1:61], strict=True), (5, 5), (None, 5)]
    table = spark.createDataFrame(edges, "u long, v long")
    want = sorted(components(table).collect())
    assert want and sorted(components(table, in_driver=1000).collect()) == want
    assert components(table.where("false"), in_driver=1000).collect() == []

    docs = spark.createDataFrame(list(enumerate(drifted()[:40])), "doc_id long, text string")

    def run():
        spark.sparkContext.setJobGroup(name := f"near-{rng.random()}", "")
        rows = sorted(jaccard.near_duplicates(docs).collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    rows, few = run()
    monkeypatch.setattr(jaccard, "IN_DRIVER", 0)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 4000)
    again, many = run()
    assert rows == again and few < 0.5 * many
