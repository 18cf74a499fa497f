"""Disguised words reach the decoder whatever their length and edges."""

from quern.llm import toxicity

WORDS = {"idiot": 50, "stupid": 40, "the": 100, "clown": 30, "loser": 33, "people": 20, "trash": 30, "ass": 30, "dumbass": 20, "moron": 30, "hello": 40}
LETTERS = toxicity.Letters(WORDS)


def restored(text):
    return {toxicity.restored(u, LETTERS) for u in toxicity.units(text)}


def test_signs_at_edges():
    for seen, want in (("!diot", "idiot"), ("(lown", "clown"), ("+rash", "trash"), ("a$$", "ass"), ("dumba$$", "dumbass"), ("hello!", "hello"), ("(hello)", "hello"), ("hello!!", "hello"), ("\"!diot\",", "idiot")):
        assert restored(seen) == {want}


def test_long_disguises():
    assert restored("m" + "0" * 50 + "r" * 20 + "0n") == {"moron"}
    assert restored("i" + "." * 30 + "d" + "." * 30 + "1.o.t") == {"idiot"}
    assert restored(".-".join("stupid") + "-." * 40 + "!") >= {"stupid"}
    word = "supercalifragilisticexpialidocious"
    assert word in {toxicity.restored(u, toxicity.Letters({word: 9})) for u in toxicity.units(" ".join(word))}


def test_scores():
    model = toxicity.Model(LETTERS, {w: 3.0 for w in ("idiot", "ass", "moron")})
    for seen in ("!diot", "+idiot", "a$$", "m" + "0" * 50 + "r0n"):
        assert model.score(f"the {seen} people") > model.score("the people")
