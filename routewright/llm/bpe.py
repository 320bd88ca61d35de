"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its BPE encoding. Candidates for it are the vocabulary entries that
end there, which a suffix automaton over the vocabulary lists from long to short. A candidate is the right one when it is
compatible with the last token of the prefix before it, that is, when the merges inside the two tokens finish before any
merge across their border could happen. Following back-pointers from the end of the word gives the exact ids.

Words are cut out of a text as the library does it: what is beyond ASCII is normalised and split by the library's own
normalizer and pre-tokenizer, whose tables of letters, numbers and capitals are those of another Unicode version than Python's.

Nulls are empty texts; an empty text has no ids and decodes to an empty text. Repeated rows give repeated results, rows
without a doc_id too; other columns are not read, whatever their names. Very long texts are encoded whole, chunk by chunk
between white space. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries after which a worker's caches start anew; they only save work.
CACHE_WORDS = 120_000
#: Words up to this many bytes are encoded side by side, longer ones one at a time; both ways give the same ids.
SIDE_BY_SIDE_BYTES = 48
#: Words encoded side by side at a time.
LANES = 5_000
_PAIR_SLOTS = 1 << 21
_NO_LIMIT = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    letters = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class SuffixAutomaton:
    """Of a set of strings: reading a text, it lists the strings that end at the current place, longest first."""

    def __init__(self, strings: dict[str, int]):
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = {}
        for text, number in strings.items():
            last = 0
            for symbol in text:
                last = self._extend(last, symbol)
            ends[last] = number
        self.number = [-1] * len(self.link)
        for state, number in ends.items():
            self.number[state] = number
        self.up = [0] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.link[state]
            self.up[state] = above if self.number[above] >= 0 else self.up[above]

    def _new(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.edges.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, symbol: str) -> int:
        """The state of exactly the longest string of ``state`` and ``symbol``."""
        target = self.edges[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.edges[target]))
        self.link[target] = clone
        while state >= 0 and self.edges[state].get(symbol) == target:
            self.edges[state][symbol] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, symbol: str) -> int:
        if symbol in self.edges[last]:
            return self._split(last, symbol)
        new = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and symbol not in self.edges[last]:
            self.edges[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, symbol)
        return new


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary with word ends, read from the text of its JSON file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find_words = regex.compile(pattern.replace("\\s", "\\p{White_Space}")).findall
        self._normalizer, self._splitter = self._library_parts(spec)
        self.split_spaces = regex.compile(r"\p{White_Space}+").split
        self.surface = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        letters = byte_letters()
        self._inner = {letter: chr(b) for b, letter in enumerate(letters)}
        self._strings = {self._symbols(t): i for t, i in model["vocab"].items()}
        vocab = model["vocab"]
        self._merge: dict[int, int] = {}
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self._merge[a << 32 | b] = rank
            self._made.setdefault(vocab[left + right], (rank, a, b))
        self._automaton = SuffixAutomaton(self._strings)
        self._fits: dict[int, bool] = {}
        #: (ids as text, decoded text) of chunks met before.
        self.ids_text: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self._id_text = {i: str(i) for i in self.surface}
        self._arrays()

    @staticmethod
    def _library_parts(spec: dict):
        """The library's normalizer, and its pre-tokenizer without the step that spells bytes as letters."""
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        split = spec["pre_tokenizer"]["pretokenizers"][0]
        plain = {**spec, "added_tokens": [], "pre_tokenizer": None, "post_processor": None, "decoder": None,
                 "model": {**spec["model"], "vocab": {}, "merges": []}}
        splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        return Tokenizer.from_str(json.dumps(plain)).normalizer, splitter

    def _symbols(self, token: str) -> str:
        """One character for each byte of a vocabulary entry; the last byte of a word has its own 256 characters."""
        closed = bool(self.end) and token.endswith(self.end) and token != self.end
        inner = [self._inner.get(c, c) for c in (token[: -len(self.end)] if closed else token)]
        if closed:
            inner[-1] = chr(ord(inner[-1]) + 256)
        return "".join(inner)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one border of a token while it is built, from whole to byte, each with the rank that ends it."""
        out, ends = [], _NO_LIMIT
        while True:
            out.append((token, ends))
            if token not in self._made:
                return out
            ends, token = self._made[token][0], self._made[token][side]

    def fits(self, left: int, right: int) -> bool:
        """True if the two tokens stay two when their joined text is encoded."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > CACHE_WORDS:
                self._fits.clear()
            ends, begins = self._edge(left, 2), self._edge(right, 1)
            known = self._fits[key] = not any(
                (rank := self._merge.get(a << 32 | b)) is not None and rank < a_ends and rank <= b_ends
                for a, a_ends in ends for b, b_ends in begins
            )
        return known

    def _raw(self, word: str) -> str:
        raw = word.encode("utf-8").decode("latin-1")
        return raw[:-1] + chr(ord(raw[-1]) + 256) if self.end else raw

    def _encode_long(self, word: str) -> list[int]:
        """Ids of one word, symbol by symbol."""
        symbols, machine = self._raw(word), self._automaton
        edges, length, number, up, link = machine.edges, machine.length, machine.number, machine.up, machine.link
        state = matched = 0
        last, begin = [-1], [0]
        for place, symbol in enumerate(symbols, 1):
            while symbol not in edges[state]:
                state = link[state]
                matched = length[state]
            state = edges[state][symbol]
            matched += 1
            at = state if number[state] >= 0 and length[state] <= matched else up[state]
            while (before := place - length[at]) and not self.fits(last[before], number[at]):
                at = up[at]
            last.append(number[at])
            begin.append(before)
        ids, place = [], len(symbols)
        while place:
            ids.append(last[place])
            place = begin[place]
        return ids[::-1]

    def _arrays(self) -> None:
        """The automaton as arrays, and a direct-mapped store of pair tests."""
        machine = self._automaton
        pairs = sorted((state << 9 | ord(symbol), to) for state, edges in enumerate(machine.edges) for symbol, to in edges.items())
        self._keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self._to = np.array([t for _, t in pairs] + [0], np.int32)
        self._link, self._length, self._number, self._up = (
            np.array(x, np.int32) for x in (machine.link, machine.length, machine.number, machine.up))
        self._pair_key = np.full(_PAIR_SLOTS, -1, np.int64)
        self._pair_fits = np.zeros(_PAIR_SLOTS, bool)

    def _fit_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = (key ^ (key >> 17)) * 0x9E3779B1 >> 7 & (_PAIR_SLOTS - 1)
        known = self._pair_key[slot] == key
        out = self._pair_fits[slot]
        for n in np.flatnonzero(~known).tolist():
            fits = self.fits(int(left[n]), int(right[n]))
            self._pair_key[slot[n]], self._pair_fits[slot[n]], out[n] = key[n], fits, fits
        return out

    def _encode_side_by_side(self, words: list[str]) -> list[list[int]]:
        """Ids of short words; place by place, all words at once, longest words first."""
        raws = [self._raw(w) for w in words]
        sizes = np.array([len(r) for r in raws], np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max())
        symbols = np.zeros((len(raws), longest), np.int64)
        flat = np.frombuffer("".join(raws).encode("utf-16-le"), np.uint16)
        symbols[np.arange(longest) < sizes[:, None]] = flat
        symbols = symbols[order].T.copy()
        active_at = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), side="right")
        last = np.full((longest + 1, len(raws)), -1, np.int32)
        begin = np.zeros((longest + 1, len(raws)), np.int32)
        state = np.zeros(len(raws), np.int32)
        matched = np.zeros(len(raws), np.int32)
        for place in range(1, longest + 1):
            n = int(active_at[place - 1])
            todo, symbol = np.arange(n), symbols[place - 1]
            while len(todo):
                key = state[todo].astype(np.int64) << 9 | symbol[todo]
                found = np.searchsorted(self._keys, key)
                hit = self._keys[found] == key
                good = todo[hit]
                state[good] = self._to[found[hit]]
                matched[good] += 1
                todo = todo[~hit]
                state[todo] = self._link[state[todo]]
                matched[todo] = self._length[state[todo]]
            here = state[:n]
            at = np.where((self._number[here] >= 0) & (self._length[here] <= matched[:n]), here, self._up[here])
            todo = np.arange(n)
            while len(todo):
                now = at[todo]
                before, token = place - self._length[now], self._number[now]
                fits = before == 0
                test = np.flatnonzero(~fits)
                fits[test] = self._fit_many(last[before[test], todo[test]], token[test])
                good = todo[fits]
                last[place, good], begin[place, good] = token[fits], before[fits]
                todo = todo[~fits]
                at[todo] = self._up[at[todo]]
        place, lane, steps = sizes[order].copy(), np.arange(len(raws)), []
        while place.any():
            steps.append(np.where(place > 0, last[place, lane], -1))
            place = begin[place, lane]
        back = np.argsort(order)
        return [[i for i in row if i >= 0] for row in np.stack(steps[::-1], 1)[back].tolist()]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words of the pre-tokenizer."""
        short = [w for w in words if len(w) * 4 <= SIDE_BY_SIDE_BYTES or len(w.encode()) <= SIDE_BY_SIDE_BYTES]
        out = {w: self._encode_long(w) for w in set(words).difference(short)}
        short.sort(key=len)
        for n in range(0, len(short), LANES):
            part = short[n:n + LANES]
            out.update(zip(part, self._encode_side_by_side(part)))
        return out

    def chunks(self, text: str) -> list[str]:
        """Pieces between white space, over which no word reaches."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, but not to Unicode
            return [c for c in self.split_spaces(text) if c]
        return text.split()

    def _parts(self, chunk: str) -> list[str | int]:
        """Words of a chunk, and ids of the special tokens written out in it."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[str | int] = []
        for n, part in enumerate(self.special_split.split(chunk) if "<" in chunk and self.special_split else [chunk]):
            if n % 2:
                out.append(self.specials[part])
            elif part.isascii():
                out += self.find_words(part.lower())
            else:
                out += [word for word, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(part))]
        return out

    def encode_chunks(self, chunks) -> dict[str, list[int]]:
        """Ids of distinct chunks."""
        parts = {c: self._parts(c) for c in chunks}
        ids = self.encode_words(list({w for p in parts.values() for w in p if w.__class__ is str}))
        return {c: ids[p[0]] if len(p) == 1 and p[0] in ids else [i for w in p for i in (ids[w] if w.__class__ is str else (w,))]
                for c, p in parts.items()}

    def learn(self, chunks: set[str]) -> None:
        """Afterwards ``ids_text`` and ``decoded`` hold all these chunks."""
        if len(self.ids_text) > CACHE_WORDS:
            self.ids_text, self.decoded = {}, {}
        ids_text, decoded, id_text, surface = self.ids_text, self.decoded, self._id_text, self.surface
        single, several = {}, {}
        for chunk in chunks.difference(ids_text):
            parts = self._parts(chunk)
            if len(parts) == 1 and parts[0].__class__ is str:
                single[chunk] = parts[0]
            else:
                several[chunk] = parts
        words = {*single.values(), *(w for p in several.values() for w in p if w.__class__ is str)}
        for word, ids in self.encode_words(list(words.difference(ids_text))).items():
            ids_text[word] = " ".join([id_text[i] for i in ids])
            decoded[word] = " ".join([surface[i] for i in ids])
        for chunk, word in single.items():
            ids_text[chunk], decoded[chunk] = ids_text[word], decoded[word]
        for chunk, parts in several.items():
            ids_text[chunk] = " ".join([ids_text[w] if w.__class__ is str else id_text[w] for w in parts])
            decoded[chunk] = " ".join([decoded[w] if w.__class__ is str else surface[w] for w in parts])

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        ids = self.encode_chunks(set(chunks))
        return [i for chunk in chunks for i in ids[chunk]]

    def decode(self, ids: list[int]) -> str:
        """Surface forms joined by one space, as a vocabulary without a decoder of its own is decoded."""
        return " ".join(self.surface[i] for i in ids if i in self.surface)


@lru_cache(maxsize=2)
def word_bpe(content: str) -> WordBpe:
    return WordBpe(content)


def shared_vocabulary(spark, path: str):
    """The vocabulary file as a broadcast text, so that executors need not have the file; its size is that of the file."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def runs_of_text(column: pa.Array, limit: int = 1 << 19):
    """Consecutive texts, about ``limit`` characters at a time; a longer text is a run of its own."""
    run, size = [], 0
    for scalar in column:
        text = scalar.as_py()
        if run and size + len(text or "") > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text or "")
    if run:
        yield run


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every whole text."""
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = word_bpe(shared.value)
        for batch in batches:
            ids = [bpe.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())],
                ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, without moving ids or texts out of the worker."""
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(batches):
        bpe = word_bpe(shared.value)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for texts in runs_of_text(batch.column(1)):
                split = [bpe.chunks(t or "") for t in texts]
                bpe.learn(set().union(*split))
                ids_of, decoded_of = bpe.ids_text.__getitem__, bpe.decoded.__getitem__
                for chunks in split:
                    ids = " ".join(filter(None, map(ids_of, chunks)))
                    decoded = " ".join(filter(None, map(decoded_of, chunks)))
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
