"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over
all ways to cut it into pieces, of the products of their probabilities; a forward pass over its letters computes it. A
text's score is the sum of its words' logarithms. Piece probabilities are learned by expectation and maximisation, with
the same passes forward and backward over word counts of labelled documents.

Words are runs of letters and the marks that combine with them, lower-cased, with a mark for their beginning; digits and
other numbers are no letters. Words of more than 64 letters are scored in
parts of 64. A letter that no piece fits costs the same in every language. A null text or one without letters is ``und``
with score 0, and so is every text if nothing was learned. Ties go to the smaller language name. Rows that repeat come out
repeated; labels that are null teach nothing. Other columns are not read. An empty table gives an empty result.

The fit reads a bounded sample: for each language ``fit_docs`` documents at most, the ones with the smallest hashes of
their ids in a stretch of hashes that holds about twice as many. What reaches the driver is the model, languages times vocabulary, whose size does not follow the number of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routewright.llm.bpe import runs_of_text
from routewright.session import cut_lineage

UNKNOWN = "und"
CACHE_WORDS = 150_000
_ASCII_WORDS = re.compile(r"[a-z]+").findall
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_PART = 64
#: Forward sums are scaled by this for each letter, which keeps those of usual words near 1.
_LETTER_SCALE = 16.0
_NO_PIECE = 1e-9
#: Sums that fall below the limit everywhere ahead are lifted by this power of two, which is counted.
_LIFT_UNDER, _LIFT = 1e-100, 2.0**332


@dataclass(frozen=True)
class LanguageFit:
    fit_docs: int = 1500
    rounds: int = 3
    #: Added to the expected count of every piece.
    prior: float = 0.01
    #: Words of evidence at most in a score; longer texts count as so many average words.
    evidence_words: float = 20.0


def vocabulary_pieces(path: str) -> list[str]:
    """Distinct lower-case pieces of a sentencepiece vocabulary file, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    usual = (model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return list(dict.fromkeys(p for p in usual if p == p.lower() and re.fullmatch(r"▁?[^\W\d_]*", p) and p))


class Pieces:
    """A trie over the vocabulary as arrays, walked for many words at once."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self._width = len(letters) + 1
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(pieces):
            node = 0
            for letter in piece:
                node = edges.setdefault((node, int(self.code[ord(letter)])), len(edges) + 1)
            ends[node] = number
        keys = sorted((node * self._width + letter, to) for (node, letter), to in edges.items())
        self._keys = np.array([k for k, _ in keys] + [1 << 62], np.int64)
        self._to = np.array([t for _, t in keys] + [0], np.int64)
        self._piece = np.full(len(edges) + 1, -1, np.int64)
        self._piece[list(ends)] = list(ends.values())
        self.count = len(pieces)
        self.lengths = np.array([len(p) for p in pieces])
        self.longest = max(1, int(self.lengths.max(initial=1)))

    def matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letter codes by place and word, longest word first; how many words have a letter at each place)."""
        sizes = np.array([len(w) for w in words])
        codes = np.zeros((int(sizes.max()), len(words)), np.int64)
        flat = self.code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        codes.T[np.arange(len(codes)) < sizes[:, None]] = flat
        return codes, np.searchsorted(-sizes, -np.arange(1, len(codes) + 1), side="right")

    def matches(self, codes: np.ndarray, active: np.ndarray):
        """(place, next place, words, pieces) of every piece in words that are sorted by falling length."""
        for place in range(len(codes)):
            words = np.arange(active[place])
            node = np.zeros(len(words), np.int64)
            for after in range(place, len(codes)):
                inside = int(np.searchsorted(words, active[after]))
                words, node = words[:inside], node[:inside]
                key = node * self._width + codes[after, words]
                found = np.searchsorted(self._keys, key)
                good = self._keys[found] == key
                words, node = words[good], self._to[found[good]]
                if not len(words):
                    break
                piece = self._piece[node]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    yield place, after + 1, words[ends], piece[ends]


def text_words(text: str) -> list[str]:
    """Marked lower-case words, parts of long ones."""
    text = text.lower()
    words = (_ASCII_WORDS if text.isascii() else _WORDS)(text)
    if words and max(map(len, words)) > _PART:
        words = [w[n:n + _PART] for w in words for n in range(0, len(w), _PART)]
    return words


def _lift(columns: np.ndarray, lifts: np.ndarray) -> None:
    """Lift the sums (place x word, ...) of which all places that are still in use are nearly 0, and count it in ``lifts``."""
    low = np.nonzero(columns[0] < _LIFT_UNDER)
    if len(low[0]):
        ahead = columns[(slice(None), *low)]
        lifted = ahead.max(0) < _LIFT_UNDER
        which = tuple(x[lifted] for x in low)
        columns[(slice(None), *which)] = ahead[:, lifted] * _LIFT
        lifts[which] += 1


def word_scores(pieces: Pieces, scaled: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability (words x languages) of distinct words; ``scaled`` is pieces x languages, each times the letter scale."""
    out = np.empty((len(words), scaled.shape[1]))
    order = sorted(range(len(words)), key=lambda n: -len(words[n]))
    for begin in range(0, len(words), 20_000):
        part = order[begin:begin + 20_000]
        codes, active = pieces.matrix(["▁" + words[n] for n in part])
        sizes = np.array([len(words[n]) + 1 for n in part])
        forward = np.zeros((len(codes) + 1, len(part), scaled.shape[1]))
        lifts = np.zeros(forward.shape[1:])
        forward[0] = 1.0
        reached = 0

        def go_on(to):
            for at in range(reached, to):  # what no piece covers goes on at a fixed cost
                forward[at + 1] += forward[at] * (_NO_PIECE * _LETTER_SCALE)
                _lift(forward[at + 1:at + 1 + pieces.longest, :active[at]], lifts[:active[at]])

        for place, after, which, piece in pieces.matches(codes, active):
            go_on(place)
            reached = max(reached, place)
            forward[after, which] += forward[place, which] * scaled[piece]
        go_on(len(codes))
        out[part] = np.log(forward[sizes, np.arange(len(part))]) - lifts * np.log(_LIFT) - (sizes * np.log(_LETTER_SCALE))[:, None]
    return out


def expected_counts(pieces: Pieces, scaled: np.ndarray, words: list[str], language: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces x languages) of weighted words, each in its own language."""
    total = np.zeros(pieces.count * scaled.shape[1])
    order = sorted(range(len(words)), key=lambda n: -len(words[n]))
    for begin in range(0, len(words), 20_000):
        part = order[begin:begin + 20_000]
        codes, active = pieces.matrix(["▁" + words[n] for n in part])
        sizes = np.array([len(words[n]) + 1 for n in part])
        tongue, lanes = language[part], np.arange(len(part))
        forward, backward = np.zeros((2, len(codes) + 1, len(part)))
        # how often each column of sums was lifted when it was complete
        lifts, forward_lifts, backward_lifts = np.zeros(len(part)), np.zeros(forward.shape), np.zeros(forward.shape)
        forward[0] = 1.0
        backward[sizes, lanes] = 1.0
        found, reached = list(pieces.matches(codes, active)), 0

        def go_on(to):
            for at in range(reached, to):
                forward[at + 1] += forward[at] * (_NO_PIECE * _LETTER_SCALE)
                _lift(forward[at + 1:at + 1 + pieces.longest, :active[at]], lifts[:active[at]])
                forward_lifts[at + 1] = lifts

        for place, after, which, piece in found:
            go_on(place)
            reached = max(reached, place)
            forward[after, which] += forward[place, which] * scaled[piece, tongue[which]]
        go_on(len(codes))
        end, end_lifts, lifts = forward[sizes, lanes], lifts, np.zeros(len(part))
        left, lifted = len(codes), bool(end_lifts.any())
        scale = weight[part] / end

        def go_back(to):
            for at in range(left - 1, to, -1):
                backward[at] += backward[at + 1] * (_NO_PIECE * _LETTER_SCALE)
                column, count = backward[at, :active[at]], lifts[:active[at]]
                step = (column < _LIFT_UNDER) * 1.0 - (column > 1 / _LIFT_UNDER)
                if step.any():
                    column *= _LIFT ** step
                    count += step
                backward_lifts[at] = lifts

        for place, after, which, piece in reversed(found):
            go_back(place)
            left = min(left, place + 1)
            share = scaled[piece, tongue[which]] * backward[after, which]
            if lifted or lifts.any():
                with np.errstate(divide="ignore"):
                    logs = np.log(forward[place, which]) + np.log(share) - np.log(end[which])
                power = end_lifts[which] - forward_lifts[place, which] - backward_lifts[after, which]
                counts = weight[part][which] * np.exp(logs + power * np.log(_LIFT))
                share = share * _LIFT ** (lifts - backward_lifts[after])[which]
            else:
                counts = forward[place, which] * share * scale[which]
            total += np.bincount(piece * scaled.shape[1] + tongue[which], counts, len(total))
            backward[place, which] += share
    return total.reshape(pieces.count, -1)


def training_rows(docs: DataFrame) -> Column:
    """True for documents that may teach: crc32 of the id as text, modulo 4, is not 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def _sample(docs: DataFrame, fit: LanguageFit) -> DataFrame:
    """``lang, text`` of the sample."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").where(training_rows(rows))
    # a stretch of hashes that holds about twice as many as wanted; one row for each language comes to the driver
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("lang", "text")
    stretch = {lang: min(2**64 - 1, 2**64 * 2 * fit.fit_docs // n) - 2**63 for lang, n in counts.items()}
    ends = [F.lit(x) for pair in stretch.items() for x in pair]
    turn = F.xxhash64("doc_id", F.lit(4))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= F.create_map(*ends)[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("turn", "doc_id")
    ids = rows.select("doc_id", "lang", "turn").withColumn("n", F.row_number().over(first)).where(F.col("n") <= fit.fit_docs)
    return rows.join(ids.select("doc_id", "lang").distinct(), ["doc_id", "lang"], "left_semi").select("lang", "text")


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    #: Probabilities, pieces x languages.
    probabilities: np.ndarray


def fit_languages(docs: DataFrame, vocabulary: str, fit: LanguageFit = LanguageFit()) -> LanguageModel:
    spark = docs.sparkSession
    names = vocabulary_pieces(vocabulary)

    def count(batches):
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((lang, w) for w in text_words(text.as_py()))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "n"])

    words = _sample(docs, fit).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut_lineage(words)
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    probabilities = np.full((len(names), len(languages)), 1.0 / max(1, len(names)))
    if not languages:
        return LanguageModel([], names, probabilities)
    for _ in range(fit.rounds):
        shared = spark.sparkContext.broadcast((names, languages, probabilities))

        def expect(batches, shared=shared):
            names, languages, probabilities = shared.value
            pieces, total = Pieces(names), np.zeros(probabilities.shape)
            scaled = probabilities * _LETTER_SCALE ** pieces.lengths[:, None]
            place = {lang: n for n, lang in enumerate(languages)}
            for batch in batches:
                if batch.num_rows:
                    tongue = np.array([place[x] for x in batch.column(0).to_pylist()])
                    total += expected_counts(pieces, scaled, batch.column(1).to_pylist(), tongue, batch.column(2).to_numpy().astype(float))
            piece, tongue = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(tongue, pa.int32()), pa.array(total[piece, tongue])],
                                             ["piece", "tongue", "n"])

        sums = words.mapInArrow(expect, "piece int, tongue int, n double").groupBy("piece", "tongue").agg(F.sum("n").alias("n")).toArrow()
        expected = np.zeros(probabilities.shape)
        expected[sums.column("piece").to_numpy(), sums.column("tongue").to_numpy()] = sums.column("n").to_numpy()
        probabilities = (expected + fit.prior) / (expected.sum(0) + fit.prior * len(names))
        shared.unpersist()
    return LanguageModel(languages, names, probabilities)


def predict(docs: DataFrame, model: LanguageModel, fit: LanguageFit = LanguageFit(), carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, and its columns named by ``carry``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    if not model.languages:
        return docs.select(ids, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *carry)

    def run(batches):
        model = shared.value
        pieces = Pieces(model.pieces)
        scaled = model.probabilities * _LETTER_SCALE ** pieces.lengths[:, None]
        known: dict[str, int] = {}
        scores = np.zeros((0, len(model.languages)))
        for batch in batches:
            names, sure = [], []
            for texts in runs_of_text(batch.column(1)):
                split = [text_words(t or "") for t in texts]
                new = list(set().union(*split).difference(known))
                if new:
                    if len(known) > CACHE_WORDS:
                        known, scores, new = {}, scores[:0], list(set().union(*split))
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    scores = np.concatenate((scores, word_scores(pieces, scaled, new)))
                for words in split:
                    if not words:
                        names.append(UNKNOWN)
                        sure.append(0.0)
                        continue
                    total = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    sure.append(float(1 / np.exp((total - total[best]) * min(1.0, fit.evidence_words / len(words))).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64()), *batch.columns[2:]],
                ["doc_id", "lang_pred", "score", *carry])

    rows = docs.select(ids, F.col("text").cast("string").alias("text"), *carry)
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + (kept and f", {kept}"))


def identify(docs: DataFrame, vocabulary: str, fit: LanguageFit = LanguageFit()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; held-out documents teach nothing."""
    found = predict(docs, fit_languages(docs, vocabulary, fit), fit)
    return found.select("doc_id", F.coalesce(~training_rows(found), F.lit(False)).alias("held_out"), "lang_pred", "score")
