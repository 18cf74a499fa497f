"""Every operator against a brute-force version on a small fixture with nulls, empty and long texts, ties and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, components, decontamination, fingerprint, quality, sharding, simhash, substring_dedup, token_files, toxicity, url_filter
from quern.llm.simhash import signed

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, fingerprint string, component_id long, spans string, part int"


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = say(70)
    out = [say(rng.randint(3, 160)) for _ in range(30)]
    out += [out[0], out[0], out[1].upper(), out[2] + " end", f"{say(20)}\n{shared}\t{say(9)}", f"{shared} {say(30)}", shared[:200], f"x\x0by {shared}"]
    out += [None, "", "   ", "a", "a b c", "it's 12345 <|endoftext|> İ ΣΑΣ 日本 👍🏽", "!" * 5000, say(6000), "z" * 3000 + " " + say(60), "ab " * 120]
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(3 * k + 1, t, "odd", -1, "odd", 9) for k, t in enumerate(TEXTS)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


IDS = [3 * k + 1 for k in range(len(TEXTS))]


def test_bpe(docs, empty):
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, with_ids=True).collect()}
    for i, text in zip(IDS, TEXTS, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, PATH, with_ids=True), PATH).collect()}
    assert back[1] == t.decode(t.encode(TEXTS[0], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode(empty, PATH).count() == 0


def test_bpe_automaton_on_random_words():
    b, t, rng = bpe.load(PATH), Tokenizer.from_file(PATH), random.Random(3)
    words = ["".join(rng.choice("aeithnosrl'1!.é☃") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for w, (ids, label) in zip(words, b.texts(pa.array(words)), strict=True):
        want = t.encode(w, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and bytes(label).decode() == t.decode(want, skip_special_tokens=False)


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def test_simhash(docs, empty):
    fps = [brute_fingerprint(t) for t in TEXTS]
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()}
    for k, i in enumerate(IDS):
        assert (got[i].f, got[i].component_id) == (f"{fps[k]:016x}", IDS[want[k]])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("long", "bits"), [(3, 4), (4096, 4), (3, 3), (4096, 3), (2, 1), (3, 0)])
def test_simhash_links_join_what_all_pairs_join(spark, long, bits):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)} | {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}, key=signed)
    want = roots(len(values), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= bits])
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(frame, bits, long)).collect()}
    for k, v in enumerate(values):
        assert got.get(signed(v), signed(v)) == signed(values[want[k]])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 201)}


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 6).collect()
    assert sorted(r.doc_id for r in rows) == IDS and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    by_id, shards = {r.doc_id: r for r in rows}, {}
    for i, t in zip(IDS, TEXTS, strict=True):
        b = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(b) + 16, zlib.crc32(b))
        shards.setdefault(by_id[i].shard, []).append(by_id[i].slot)
    assert set(shards) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert len({by_id[i].shard for i, t in zip(IDS, TEXTS, strict=True) if t == TEXTS[0]}) == 1
    assert sharding.shard(empty, 6).count() == 0


def test_sharding_capacity_is_least(spark):
    rng = random.Random(1)
    sizes = [(a, rng.randint(1, 90)) for a in range(120)]
    plan = {r.atom: r.shard for r in sharding._plan(spark.createDataFrame(sizes, "atom int, bytes long"), 7).collect()}
    loads = [sum(s for a, s in sizes if plan[a] == k) for k in range(7)]

    def needed(capacity):
        used, load = 1, 0
        for _, s in sizes:
            used, load = (used, load + s) if load + s <= capacity else (used + 1, s)
        return used

    assert needed(max(loads)) <= 7 < needed(max(loads) - 1)
    assert [plan[a] for a, _ in sizes] == sorted(plan.values())
    giant = {r.atom: r.shard for r in sharding._plan(spark.createDataFrame([(0, 5), (1, 9000), (2, 5), (3, 6)], "atom int, bytes long"), 3).collect()}
    assert sum(s == giant[1] for s in giant.values()) == 1


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://", "http://A.NET", "http://a.NET/x", "https://m.example.net/en/1?q", "https://badexample.net/en/", "http://www.example.com/de/7#t", "http://example.org/fr/", "ftp://example.org/fr?x", "http://www.casino-bets.example.com/en/1", "http://library.example.com/en/1", "http://" + "a" * 50000 + ".org/x"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    got = [(r.host, r.path, r.rule) for r in rows]
    assert got[:11] == [("", "", None)] * 4 + [("a.net", "", None), ("a.net", "/x", "net/"), ("m.example.net", "/en/1", "example.net/en/"), ("badexample.net", "/en/", "net/"), ("www.example.com", "/de/7", "example.com/de/"), ("example.org", "/fr/", "org/fr/"), ("example.org", "/fr", None)]
    assert [r.verdict for r in rows[5:10]] == ["block", "allow", "block", "block", "allow"]
    assert (rows[11].verdict, rows[12].verdict) == ("block", "allow")


def labelled(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdehilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for k in range(900):
        toxic, good = k % 4 == 0, k % 3 != 0
        w = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgle", "zorglish", "zorgly", "quaxo"]))
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        docs.append((k, text))
        labels.append((k, int(good), int(toxic)))
    labels += [(None, 1, 1), (0, None, None), (1, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality(spark, docs, empty):
    d, labels = labelled(spark)
    rows = quality.judge(d, labels).collect()
    held = [(r.score, r.doc_id % 3 != 0) for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc(held) > 0.98 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.judge(docs, labels.where("false")).count() == len(TEXTS) and quality.judge(empty, labels).count() == 0


def test_toxicity(spark, docs, empty):
    d, labels = labelled(spark)
    model = toxicity.train(d, labels)
    plain = " ".join(["the"] * 5)
    assert min(model.score(f"{plain} {w}") for w in ("zorgle quaxo zorgly", "z0rgle qu4xo", "zorgleee quaxoooo", "z o r g l e and quaxo", "z.o.r.g.l.e quaxo")) > model.score(plain)
    rows = toxicity.judge(d, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert auc([(r.score, r.doc_id % 4 == 0) for r in rows if r.held_out]) > 0.98
    assert toxicity.judge(docs, labels.where("false")).count() == len(TEXTS) and toxicity.judge(empty, labels).count() == 0


def test_viterbi():
    letters = toxicity.Letters({"idiot": 50, "stupid": 40, "the": 100, "clown": 30, "loser": 33, "people": 20})
    for seen, want in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("l0$er", "loser"), ("i.d.i.o.t", "idiot"), ("peeeople", "people")):
        assert toxicity.decode(seen, letters) == want


def brute_hits(text, items):
    words = decontamination.split(text)
    hit, found = set(), set()
    for item, other in items:
        w = decontamination.split(other)
        for k in range(max(1, len(w) - 12)) if w else ():
            window = w[k : k + 13]
            for a in range(len(words) - len(window) + 1):
                if words[a : a + len(window)] == window:
                    hit.update(range(a, a + len(window)))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("most_bytes", [150, 1 << 20])
def test_decontamination(spark, docs, empty, most_bytes):
    items = [(1, " ".join(TEXTS[3].split()[:15])), (2, TEXTS[4]), (3, None), (4, ""), (5, "ab ab"), (6, " ".join(TEXTS[3].split()[:15])), (7, "  A, B. c!"), (8, "nowhere to be found " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.scan(docs, bench, most_bytes=most_bytes).collect()}
    for i, t in zip(IDS, TEXTS, strict=True):
        assert (got[i].n_words, sum(z - a for a, z in got[i].spans), list(got[i].items)) == brute_hits(t, [x for x in items if x[1]])
    cleaned = {r.doc_id: r.text for r in decontamination.clean(docs, bench).collect()}
    for i, t in cleaned.items():
        n, hit, _ = brute_hits(TEXTS[IDS.index(i)], [x for x in items if x[1]])
        assert (t == TEXTS[IDS.index(i)]) == (not hit) and not (hit and 20 * hit >= n)
    assert decontamination.scan(empty, bench).count() == 0 and decontamination.scan(docs, empty, item_col="doc_id").count() == len(TEXTS)


def test_fm_index():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5, 400)
    index = decontamination.FmIndex(text)
    phrases = np.array([text[a : a + 4] for a in range(0, 396, 7) if (text[a : a + 4] > 0).all()] + [[9, 9, 9, 9], [1, 1, 1, 1]])
    low, high = index.search(phrases, np.full(len(phrases), 4))
    for p, a, z in zip(phrases, low, high, strict=True):
        want = [k for k in range(397) if (text[k : k + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, z)).tolist() if z > a else []) == want


def test_fingerprint(docs, empty):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True)):
        t, following = t or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        changed = fingerprint.edited(t, following)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (fingerprint.fingerprint(t), fingerprint.fingerprint(changed))
        assert got[i].near_next == pytest.approx(brute_likeness(t, following)) and got[i].near_edited == pytest.approx(brute_likeness(t, changed))
    assert got[1].fingerprint == got[IDS[30]].fingerprint != got[IDS[1]].fingerprint
    assert likeness("", "") == 1 and likeness("", "a") == 0 and fingerprint.fingerprints(empty).count() == 0


def likeness(a, b):
    return fingerprint.likeness(fingerprint.Prefixes(a), fingerprint.Prefixes(b))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    shorter, inside = min(len(a), len(b)), 0
    width = 24 if shorter >= 96 else 6 if shorter >= 16 else 2 if shorter >= 4 else 1
    for x, y in ((a, b), (b, a)):
        spans, hit = {y[k : k + width] for k in range(len(y) - width + 1)}, set()
        for k in range(len(x) - width + 1):
            if x[k : k + width] in spans:
                hit.update(range(k, k + width))
        inside += len(hit)
    return inside / (len(a) + len(b))


def test_likeness_of_random_texts():
    rng = random.Random(12)
    for _ in range(400):
        say = lambda n: "".join(rng.choice("ab c👍") for _ in range(n))
        a, shared = say(rng.randint(0, 150)), say(rng.randint(0, 60))
        b = rng.choice([a[: len(a) * 3 // 4] + say(30), say(20) + a, shared + say(5) + a[10:], say(rng.randint(0, 150)), a])
        assert likeness(a + shared, b) == pytest.approx(brute_likeness(a + shared, b)), (a, b)


def test_fingerprint_spans():
    a, b = fingerprint.Prefixes("hello world, abc"), fingerprint.Prefixes("yellow hello world, abd")
    assert (a.extension(0, b, 7), a.extension(1, b, 1), a.extension(0, b, 0), a.ending(b)) == (15, 4, 0, 0)
    assert a.ending(fingerprint.Prefixes("llo world, abc")) == 14
    assert a.equal(4, b, 11, 3) and not a.equal(4, b, 12, 3) and not a.equal(14, b, 0, 9)


def test_fingerprint_single_document(spark):
    one = fingerprint.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1


def brute_dedup(rows, size):
    first, out = {}, {}
    for i, t in sorted(rows):
        w, gone = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), set()
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k : k + size]), i) < i:
                gone.update(range(k, k + size))
        out[i] = len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.mark.parametrize("size", [5, 50])
def test_substring_dedup(docs, empty, size):
    want = brute_dedup(list(zip(IDS, TEXTS, strict=True)), size)
    for r in substring_dedup.dedup(docs, size, with_text=True).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, kept.decode())
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert substring_dedup.dedup(empty, size).count() == 0
    texts_left = {r.doc_id: r.text for r in substring_dedup.dedup_texts(docs, size).collect()}
    for i, t in zip(IDS, TEXTS, strict=True):
        n, gone, kept = want[i]
        assert texts_left.get(i, "dropped") == ("dropped" if gone and gone == n else kept.decode() if gone else t)


def test_substring_index_in_batches(spark, docs, tmp_path):
    index = substring_dedup.WindowIndex(spark, str(tmp_path), 50)
    got = {}
    for low, high in ((0, 60), (60, 110), (110, 10_000)):
        batch = docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        got |= {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(batch, 50, index).collect()}
        index.add(batch)
        if low:
            index.compact()
            assert len(index.runs) == 1
    assert got == {i: (gone, hashlib.sha256(kept).hexdigest()) for i, (_, gone, kept) in brute_dedup(list(zip(IDS, TEXTS, strict=True)), 50).items()}


def test_simple8b():
    rng = np.random.default_rng(1)
    for k in range(60):
        ids = rng.integers(0, 1 << int(rng.integers(1, 63)), int(rng.integers(0, 400))).astype(np.uint64)
        words, offsets, escapes = token_files.pack(ids)
        assert (token_files.unpack(words, len(ids), offsets, escapes) == ids).all() and len(offsets) == -(-len(ids) // token_files.EVERY)
    ids = np.arange(20_000).astype(np.uint64)
    words, offsets, escapes = token_files.pack(ids)
    assert int((words[offsets[1] : offsets[1] + 1] & np.uint64(15))[0]) == 10


def test_token_files(spark, docs, empty, tmp_path):
    t, start = Tokenizer.from_file(PATH), 0
    token_files.write(docs, str(tmp_path / "a"), PATH, 1)
    got = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "a")).collect()}
    ids_back = {r.doc_id: r.ids for r in token_files.read_ids(spark, str(tmp_path / "a")).collect()}
    for i, text in zip(IDS, TEXTS, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert list(ids_back[i]) == ids
        start += len(ids)
    token_files.write(empty, str(tmp_path / "b"), PATH, 1)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "q"), (None, None)], "doc_id long, text string")
    assert sorted(r.component_id or -1 for r in simhash.near_duplicates(rows).collect()) == [-1, -1, 1, 1, 1]
    assert substring_dedup.dedup(rows, 3).count() == 5 and sharding.shard(rows, 2).count() == 5
    assert bpe.encode(rows, PATH).count() == 5 and fingerprint.fingerprints(rows).count() == 5
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup(rows, 3).collect()} == {(1, 0), (2, 5), (None, 0)}
