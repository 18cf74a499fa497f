"""URL rules against a plain version, and the model on hosts that it hasn't seen."""

import random

from quern.llm import url_filter as u

COLUMNS = "page_id long, url string, host string, rule int, block_score string"


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(r, v) for r, v in u.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    rng = random.Random(9)
    parts = ["http", "://", "/", "?", "#", ".", "net", "example", "EXAMPLE", "com", "org", "en", "de", "fr", "www", "\n", "É", "İ", " ", ":", "@", "bad"]
    urls = [None, "", "://", "http://", "http:///en/", "a://b://c/d"]
    urls += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    urls += [f"http://{rng.choice(['', 'm.', 'bad'])}{rng.choice(['example.net', 'net', 'example.com', 'org', 'x.org'])}/{rng.choice(['en/', 'de/', 'fr/', 'en', ''])}{rng.choice(['', 'x', '?q', '#t'])}" for _ in range(400)]
    urls += ["http://" + "a" * 300_000 + ".org/fr/" + "b" * 300_000, urls[10], urls[10]]
    frame = spark.createDataFrame([(k, x, "odd", 3, "odd") for k, x in enumerate(urls)], COLUMNS)
    got = {r.page_id: r for r in u.judge(frame).collect()}
    w, b = u.model()
    for k, url in enumerate(urls):
        host, path, (rule, verdict) = plain(url)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == (verdict or ("block" if got[k].block_score >= 0.8 else "allow"))
        assert abs(got[k].block_score - u.probabilities([host], [path], w, b)[0]) < 1e-9
    assert u.judge(frame.where("false")).count() == 0


def test_hosts_not_seen_in_training():
    def joined(words, label):
        return [(f.format(a=x, b=p), "/en/7", label) for x in words for p in u.PARTNERS[1::2] for f in ("{a}-{b}.example.org", "{b}{a}.net")]

    w, b = u.fit(u.seeds(tuple(u.PARTNERS[::2])))
    rows = joined(u.UNWANTED, 1) + joined(u.WANTED, 0)
    blocked = u.probabilities([r[0] for r in rows], [r[1] for r in rows], w, b) >= 0.8
    caught = sum(x and r[2] for x, r in zip(blocked, rows, strict=True))
    assert caught / sum(r[2] for r in rows) > 0.9 and caught / blocked.sum() > 0.98


def test_grams_are_those_of_each_string():
    def slow(kind, text):
        return {(kind, f"^{text}$"[k : k + n]) for n in u.GRAMS for k in range(len(text) + 2 - n + 1)}

    hosts, paths = ["", "a.org", "ab", "a.org"], ["/x", "", "/é👍", "/x"]
    row, slot = u.grams(hosts, paths)
    for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        assert abs((row == k).sum() - len(slow(0, h) | slow(1, p))) <= 1
    assert set(slot[row == 1]) & set(slot[row == 3]) and len(u.grams([], [])[0]) == 0
