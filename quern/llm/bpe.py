"""BPE encoding and decoding by a deterministic automaton (operator 1).

The merges of a vocabulary are compiled, one after the other, into an automaton whose arcs are labelled with tokens.
A state is the token read last. The gadget of merge number r, u v -> t, adds the arc label t: t is entered the way u is
and left the way v is, for as long as these parts lived, that is until rank r. An arc from x to y is closed by a gadget
(u, v) if x ends in a living u, and y begins with a living v, at the time r when that merge would have joined them. In
what stays open, every word has one path, and its labels are the tokens that applying the merges would give. Encoding
runs a pre-split word through the transition table; decoding emits the labels of the arcs.

Nulls count as empty texts; empty texts have no tokens. Equal texts get equal tokens; texts may be of any length. Rows that
share a doc_id are rows of their own; further columns are of no account. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Memory, batch_rows, id_text, in_batches, pieces, settle, slices, spread, tidy

#: Bytes of text pieces and their tokens that a worker process remembers.
MOST_BYTES = 72 << 20
_FOREVER = 1 << 60
_SPACE = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]")


class Table:
    """Open-addressed map from 64-bit keys to 32-bit values, read for whole arrays at once; -1: absent."""

    _NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values, self.probes = np.full(1 << bits, self._NONE), np.full(1 << bits, -1, np.int32), 0
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == self._NONE
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at, self.probes = left[~won], (at[~won] + 1) & self.mask, self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != self._NONE))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != self._NONE)]
        return out


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)


class Automaton:
    """Transitions between tokens, compiled merge by merge, for words given as bytes.

    vocab maps token texts to ids; text is bytes, spelled by one character each of spell, and end marks a word's last
    token.
    """

    ARCS = 1 << 20

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], spell: dict[str, int], end: str):
        self.end = end
        made = {u + v for u, v in merges}
        letters = [i for t, i in vocab.items() if t not in made]
        #: token -> parts with which it is left (entered), outermost first, each with the rank that ends it
        exits: dict[int, tuple] = {i: ((i, _FOREVER),) for i in letters}
        entries: dict[int, tuple] = {i: ((i, _FOREVER),) for i in letters}
        rules: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v], exits, entries, rules)
        self._freeze({t: i for t, i in vocab.items() if i in exits}, spell, exits, entries, rules)

    @staticmethod
    def _gadget(rank: int, u: int, v: int, t: int, exits: dict, entries: dict, rules: dict) -> None:
        """Adds the arc label t to the automaton of the merges before it."""
        rules.setdefault((u, v), rank)
        if u not in exits or v not in exits or t in exits:
            return
        for x, until_x in exits[u]:
            for y, until_y in entries[v]:
                earlier = rules.get((x, y), rank)
                if earlier < rank and earlier < until_x and earlier <= until_y:
                    return  # an earlier merge joins across the seam, so that u v never stand side by side for this one
        exits[t] = ((t, _FOREVER), (v, rank), *exits[v][1:])
        entries[t] = ((t, _FOREVER), (u, rank), *entries[u][1:])

    def _freeze(self, ids: dict[str, int], spell: dict[str, int], exits: dict, entries: dict, rules: dict) -> None:
        """Arrays for the vectorised run: the spelling trie, the gadgets' parts and ranks, and the arcs seen so far."""
        nodes, inner, last = {}, [-1], [-1]
        for text, i in ids.items():
            final = bool(self.end) and text.endswith(self.end)
            node = 0
            for c in text.removesuffix(self.end) if final else text:
                key = node << 8 | spell[c]
                if key not in nodes:
                    nodes[key] = len(inner)
                    inner.append(-1)
                    last.append(-1)
                node = nodes[key]
            (last if final else inner)[node] = i
            if not self.end:
                last[node] = i
        self.trie = Table(np.array(list(nodes), np.uint64), np.array(list(nodes.values()), np.int32))
        self.inner, self.last = np.array(inner, np.int32), np.array(last, np.int32)
        self.rules = Table(_pair(*np.array(list(rules)).T), np.array(list(rules.values()), np.int32))
        size = max(exits) + 1

        def padded(parts: dict) -> tuple[list, list]:
            deep = max(map(len, parts.values()))
            who, until = np.full((deep, size), -1, np.int32), np.zeros((deep, size), np.int32)
            for i, chain in parts.items():
                for k, (p, r) in enumerate(chain):
                    who[k, i], until[k, i] = p, min(r, 1 << 30)
            return who, until

        self.exit, self.entry = padded(exits), padded(entries)
        self.arc_key, self.arc_open = np.full(self.ARCS, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(self.ARCS, bool)

    def _open(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether no gadget closes the arc y out of state x."""
        ok = np.ones(len(x), bool)
        for u, until_u in zip(*self.exit, strict=True):
            for v, until_v in zip(*self.entry, strict=True):
                at = np.flatnonzero(ok & (u[x] >= 0) & (v[y] >= 0))
                if not len(at):
                    break
                a, b = x[at], y[at]
                rank = self.rules.get(_pair(u[a], v[b]))
                ok[at[(rank >= 0) & (rank < until_u[a]) & (rank <= until_v[b])]] = False
        return ok

    def step(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The transition table: whether the arc y leaves state x. Rows are filled in as words ask for them."""
        key = _pair(x, y)
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.arc_key[at] != key)
        out = self.arc_open[at]
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            rows = new[first]
            known = self._open(x[rows], y[rows])
            self.arc_key[at[rows]], self.arc_open[at[rows]] = key[rows], known
            # of rows that share a slot the last stays, with its own answer
            self.arc_open[at[rows]] = np.where(self.arc_key[at[rows]] == key[rows], known, self.arc_open[at[rows]])
            out[new] = known[back]
        return out

    def encode(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words, one after the other, and their number for each word.

        symbols: the bytes of all words; ends: where each word ends in them. All words take their steps side by side.
        """
        n, starts = len(symbols), np.concatenate([[0], ends[:-1]])
        stop, begin = np.repeat(ends, ends - starts), np.repeat(starts, ends - starts)
        at, node, found, depth = np.arange(n), np.zeros(n, np.int64), [], 0
        while len(at):
            node = self.trie.get((node.astype(np.uint64) << np.uint64(8)) | symbols[at + depth]).astype(np.int64)
            alive = node >= 0
            at, node, depth = at[alive], node[alive], depth + 1
            final = at + depth == stop[at]
            label = np.where(final, self.last[node], self.inner[node])
            some = label >= 0
            found.append((at[some], np.full(int(some.sum()), depth), label[some]))
            at, node = at[~final], node[~final]
        source, length, label = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        target = source + length
        # state[p]: the token that ends before place p of its word; came[p]: where that token begins
        state, came, order = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64), np.argsort(target - begin[target - 1], kind="stable")
        source, target, label = source[order], target[order], label[order]
        cuts = np.flatnonzero(np.diff(target - begin[target - 1], prepend=-1))
        ends_at = stop[target - 1] == target
        # a word's end is the place where the next one begins, so that ends have arrays of their own
        final_state, final_came = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(target)], strict=True):
            s, t, y = source[a:b], target[a:b], label[a:b].astype(np.int64)
            initial = s == begin[s]
            ok, x = initial.copy(), state[s]
            ask = np.flatnonzero(~initial & (x >= 0))
            ok[ask] = self.step(x[ask], y[ask])
            last = ends_at[a:b]
            state[t[ok & ~last]], final_state[t[ok & last]] = y[ok & ~last], y[ok & last]
            came[t[ok & ~last]] = s[ok & ~last]
            final_came[t[ok & last]] = s[ok & last]
        if (final_state[ends] < 0).any():
            raise ValueError("a word has letters that the vocabulary lacks")
        picked, place, word = [], ends.astype(np.int64), np.arange(len(ends))
        tokens, came_from = final_state[ends], final_came[ends]
        while len(word):
            picked.append((word, tokens))
            go = came_from > starts[word]
            word, place = word[go], came_from[go]
            tokens, came_from = state[place], came[place]
        who, what = (np.concatenate(c) for c in zip(*picked, strict=True)) if picked else (np.zeros(0, np.int64),) * 2
        back = np.argsort(-np.arange(len(who)), kind="stable")  # last tokens came first
        who, what = who[back], what[back]
        order = np.argsort(who, kind="stable")
        return what[order], np.bincount(who, minlength=len(ends))


class Bpe:
    """Encoder and decoder for a tokenizer file of the tokenizers library with a byte-level BPE model and word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("decoder") or spec.get("post_processor") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE files without decoder and post-processor are supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.spell = byte_letters()
        self.automaton = Automaton(model["vocab"], merges, self.spell, model.get("end_of_word_suffix") or "")
        # texts go through the library's own normaliser and splitter only; the merges are the automaton's
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        if "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError("only files whose normaliser lower-cases are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        labels = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        # every arc's label and a blank, one after the other, and where each begins
        parts = [f"{labels[i]} ".encode() if i in labels else b"" for i in range(max(labels) + 1)]
        self.labels, self.label_at = b"".join(parts), np.cumsum([0, *map(len, parts)]).astype(np.int32)
        self.to_byte = np.zeros(max(map(ord, self.spell)) + 1, np.uint8)
        self.to_byte[[ord(c) for c in self.spell]] = list(self.spell.values())
        self.memory = Memory(self.learn, lambda v: 130 + len(v[0]) + len(v[1]), MOST_BYTES)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.memory = Memory(self.learn, lambda v: 130 + len(v[0]) + len(v[1]), MOST_BYTES)

    def _words(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        norm = self.normalizer.normalize_str(text) if self.normalizer else text
        return self.splitter.pre_tokenize_str(norm) if norm else []

    def _blanked(self, ids: list[int]) -> list[bytes]:
        at, labels = self.label_at, self.labels
        return [labels[at[i] : at[i + 1]] for i in ids]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte-level words and, for each word, where they end."""
        symbols = self.to_byte[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        ids, counts = self.automaton.encode(symbols, np.cumsum([len(w) for w in words]))
        return ids.astype("<u4"), np.cumsum(counts)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif words := [w for w, _ in self._words(part)]:
                out.extend(self._ids(words)[0].tolist())
        return out

    def decode(self, ids) -> str:
        return b"".join(self._blanked(ids))[:-1].decode()

    def learn(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Little-endian ids, and labels with a blank after each, of pieces of text without ASCII white space.

        No normalisation, split or special token of the file reaches across white space, so that a text's tokens are
        those of its pieces, one after the other.
        """
        got, plain = {}, []
        for b in pieces:
            text = b.decode("utf-8", "surrogatepass")
            # white space of any kind inside, or what a splitter may take for it, has such a piece split by itself
            if text and len(b) < 1000 and not _SPACE.search(text) and not (self.marks and self.marks.search(text)):
                plain.append((b, text))
            else:
                got[b] = self._alone(text)
        if plain:
            words = self._words(" ".join([t for _, t in plain]))
            # a gap between two words is the blank between two pieces
            spans = np.array([s for _, s in words], np.int64).reshape(-1, 2)
            last = np.flatnonzero(np.append(spans[1:, 0] > spans[:-1, 1], True)) if len(spans) else spans
            if len(last) != len(plain):  # the splitter dropped or parted a piece
                return got | {b: self._alone(t) for b, t in plain}
            ids, ends = self._ids([w for w, _ in words])
            cuts, raw, labels, a = ends[last].tolist(), ids.tobytes(), self._blanked(ids.tolist()), 0
            for (b, _), z in zip(plain, cuts, strict=True):
                got[b] = raw[4 * a : 4 * z], b"".join(labels[a:z])
                a = z
        return got

    def _alone(self, text: str) -> tuple[bytes, bytes]:
        ids = self.encode(text)
        return np.array(ids, "<u4").tobytes(), b"".join(self._blanked(ids))

    def texts(self, texts: pa.Array) -> Iterator[tuple[memoryview, memoryview]]:
        """Each text's little-endian ids and its decoded text in UTF-8; a null counts as empty."""
        different, numbers, ends = pieces(texts)
        got = self.memory.of(different, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        ids, id_ends = spread([v[0] for v in got], numbers)
        labels, label_ends = spread([v[1] for v in got], numbers)
        at = label_at = 0
        for z, label_z in zip(id_ends[ends].tolist(), label_ends[ends].tolist(), strict=True):
            yield ids[at:z], labels[label_at : max(label_at, label_z - 1)]  # but for the blank after the last label
            at, label_at = z, label_z


def byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(2)
def load(path: str) -> Bpe:
    """The compiled file, in the driver."""
    return Bpe(path)


_kept: dict[int, Bpe] = {}
_broadcast: dict[tuple[str, str], tuple] = {}


def _received(number: int, sent) -> Bpe:
    """What a worker process keeps of a broadcast."""
    if number not in _kept:
        _kept.clear()
        _kept[number] = sent.value
        settle("bpe", _kept.clear)
    return _kept[number]


def _sent(spark: SparkSession, path: str):
    """A function that gives a task the automaton: compiled once in the driver, sent as arrays of a fixed size."""
    context = spark.sparkContext
    key = context.applicationId, path
    if key not in _broadcast:
        _broadcast.clear()
        sent = context.broadcast(load(path))
        _broadcast[key] = sent._jbroadcast.id(), sent
    return partial(_received, *_broadcast[key])


TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
IDS = pa.schema([*list(TOKENS), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text and, on request, the ids; no shuffle."""
    schema, get = IDS if with_ids else TOKENS, _sent(docs.sparkSession, path)

    def run(batches):
        bpe = get()

        def rows():
            for batch in slices(batches):
                for doc_id, (ids, label) in zip(batch.column(0).to_pylist(), bpe.texts(batch.column(1)), strict=True):
                    row = doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(label).hexdigest()
                    yield (*row, np.frombuffer(ids, "<u4").astype("i4")) if with_ids else row

        yield from in_batches(rows(), schema, weight=(lambda r: 4 * r[1]) if with_ids else None)

    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_text(docs, id_col, text_col).mapInArrow(tidy(run, "bpe"), sql)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded text of id arrays, by the labels of the arcs; a null array gives an empty text."""
    get = _sent(tokens.sparkSession, path)

    def run(batches):
        bpe = get()
        for batch in batches:
            yield from in_batches(((i, bpe.decode(ids or [])) for i, ids in batch_rows(batch)), pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())]))

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run, "bpe"), "doc_id long, decoded string")
