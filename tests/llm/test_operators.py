"""Each operator against brute force or known answers on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routewright.llm import (
    bpe, decontamination, graph, html_text, language_id, licenses, near_duplicates, quality_classifier, quality_rules, sharding, token_files)
from routewright.llm.queries import PIECES, WORD_BPE

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, node long, component_id long, key long, shard string"
EN = "the of and to in that was for with this from they have been which were their said would there".split()
DE = "der die und das ist nicht mit von sich auf eine dem werden auch als nach wird über für können".split()


def frame(spark, rows):
    """(doc_id, text, lang, source) rows with more columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, la, s, len(t or ""), "h", -1, -2, -3, "x") for d, t, la, s in rows], SCHEMA)


def texts(spark, *values):
    return frame(spark, [(n, t, "en", "s") for n, t in enumerate(values)])


def prose(seed, n, words=EN):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "x", "ing", "el"]) * r.randint(0, 3) for _ in range(n))


def empty(spark):
    return frame(spark, [])


# --- BPE and token files ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(WORD_BPE)


ODD = [None, "", "  \n", "Hello, world!! <|endoftext|>x<|startoftext|>", "ΑΣ σας İstanbul Straße", "\x1c a\x1db \x85 c　d", "don't I'LL 12½ ①",
       "漢字かな 🙂👍🏽 é", "thetheinginging" * 40, "a" * 700, prose(1, 3000)]


def test_bpe_matches_the_library(spark, tokenizer):
    rows = {r.doc_id: r for r in bpe.encode_decode(texts(spark, *ODD), WORD_BPE).collect()}
    short = {r.doc_id: r for r in bpe.digests(texts(spark, *ODD), WORD_BPE).collect()}
    for n, text in enumerate(ODD):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (rows[n].ids, rows[n].decoded) == (ids, decoded)
        assert short[n].n_tokens == len(ids)
        assert short[n].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[n].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("form", ["a{}b", "{}", "É{0}1{0}"])
def test_bpe_matches_the_library_on_every_code_point(tokenizer, form):
    with open(WORD_BPE, encoding="utf-8") as file:
        coder = bpe.word_bpe(file.read())
    for begin in range(0, 0x110000, 4096):
        letters = [chr(c) for c in range(begin, begin + 4096) if not 0xD800 <= c < 0xE000]
        text = " ".join(map(form.format, letters))
        assert coder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, hex(begin)


def test_bpe_long_and_short_words_take_the_same_ids():
    coder = bpe.word_bpe(open(WORD_BPE, encoding="utf-8").read())
    r = random.Random(4)
    words = ["".join(r.choice("aeinrstholdé") for _ in range(r.randint(1, 30))) for _ in range(500)]
    together = coder.encode_words(list(dict.fromkeys(words)))
    assert all(together[w] == coder._encode_long(w) for w in words)


def test_bpe_repeats_and_empty(spark):
    twice = frame(spark, [(1, "one two", None, None), (1, "one two", None, None), (None, "x", None, None)])
    assert bpe.digests(twice, WORD_BPE).count() == 3
    assert bpe.digests(empty(spark), WORD_BPE).count() == 0


def test_token_files_round_trip(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RUN_IDS", 64)
    values = [*ODD, *(prose(n, n * 7) for n in range(20))]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(texts(spark, *values).repartition(4), WORD_BPE, 2, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path).collect()}
    start = 0
    for n, text in enumerate(values):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[n] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_null_ids_and_empty(spark, tmp_path):
    rows = frame(spark, [(None, "b", None, None), (5, None, None, None), (5, "a", None, None)])
    token_files.write_tokens(rows, WORD_BPE, 2, str(tmp_path / "a"))
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_documents(spark, str(tmp_path / "a")).collect())
    assert got == [(0, None, 2), (2, 5, 1), (3, 5, 2)]
    token_files.write_tokens(empty(spark), WORD_BPE, 2, str(tmp_path / "b"))
    assert token_files.read_documents(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_addressable_codes(n):
    r = np.random.default_rng(n)
    ids = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
    coded = token_files.Addressable.from_bytes(token_files.Addressable.encode(ids).to_bytes())
    places = r.integers(0, n, 200) if n else np.zeros(0, int)
    assert len(coded) == n and (coded.at(places) == ids[places]).all()
    for low, high in np.sort(r.integers(0, n + 1, (20, 2)), 1).tolist():
        assert (coded.range(low, high) == ids[low:high]).all()
    with pytest.raises(IndexError):
        coded.at([n])


# --- near duplicates --------------------------------------------------------------------------------------------

def classes(rows, percent=85):
    """{doc_id: (set size, smallest reachable id)} by comparing everything."""
    sets = collections.defaultdict(list)
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d].append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[a] < least[b] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    least[b], changed = least[a], True
    return {d: ([len(x) for x in sets[d]], least[d]) for d in sets}


def mutated(text, r, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_match_brute_force(spark, block):
    r = random.Random(7)
    base = prose(2, 160)
    family = [base]
    for _ in range(25):  # a chain whose ends are far apart
        family.append(mutated(family[-1], r, 2))
    rows = [*enumerate(family), (40, base.upper()), (41, base.replace(" ", "\n ")), (42, None), (43, ""), (44, " \t"), (45, "a b"), (46, "A  b"),
            (47, "a b c"), *((60 + n, prose(50 + n, 40 + n)) for n in range(15)), (90, prose(9, 6000)), (91, mutated(prose(9, 6000), r, 3)), (90, prose(9, 6000))]
    params = near_duplicates.SetSketch(block=block)
    got = near_duplicates.near_duplicates(frame(spark, [(d, t, None, None) for d, t in rows]), params).collect()
    want = classes(rows)
    assert len(got) == len(rows)
    for row in got:
        assert row.n_shingles in want[row.doc_id][0] and row.component_id == want[row.doc_id][1]
        assert row.kept == (row.doc_id == row.component_id)


def test_near_duplicates_ids_null_or_with_several_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    rows = frame(spark, [(1, a, None, None), (2, b, None, None), (2, a, None, None), (3, b, None, None), (None, a, None, None)])
    got = near_duplicates.near_duplicates(rows).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(5, 5), (None, 3)] + [(100 + n, 101 + n) for n in range(40)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = {n: n for pair in links if None not in pair for n in pair}
    for _ in range(100):
        for a, b in links:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low


# --- quality rules ----------------------------------------------------------------------------------------------

def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {k + o for k, w in enumerate(windows) if often[w] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark):
    values = [None, "", " \n\t", "a b c a b c", "x " * 500, prose(1, 60), prose(2, 49), "é# ü|\né# ü|\n\n\n  \né# ü|", prose(3, 4000), "a\x0bb\x0cc\rd", "a b c"]
    rows = quality_rules.judge_documents(texts(spark, *values)).collect()
    for row in rows:
        n, chars, symbols, lines, covered = measures(values[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, lines, covered)
        assert row.base_failed == (n < 50 or 100 * covered > 50 * n)


def test_repeats_in_a_very_long_text(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(1 << 60)}" for _ in range(1_000_000)]
    again = [words[100:104], words[7:9], words[100:103], words[200_000:200_003]]
    text = " ".join(words + [w for part in again for w in [*part, f"x{r.random()}"]])
    got = quality_rules.measure_text(frame(spark, [(1, text, "en", "s"), (2, "a b c d " * 3, "en", "s")])).orderBy("doc_id").collect()
    # the windows at 100 and 101, those at 200,000 and their copies; two words in a row are no window
    assert [(x.n_words, x.n_repeat_words) for x in got] == [(len(text.split()), 4 + 4 + 3 + 3 + 3), (12, 12)]


def test_hosts_take_their_documents_along(spark):
    good, bad = prose(1, 80), "short"
    rows = [(n, bad if n % 10 else good, None, "junk") for n in range(100)]
    rows += [(1000 + n, good if n % 10 else bad, None, "fine") for n in range(100)] + [(5000, good, None, None), (5001, good, None, None)]
    kept = {r.doc_id for r in quality_rules.judge_documents(frame(spark, rows)).where("kept").collect()}
    assert kept == {1000 + n for n in range(100) if n % 10} | {5000, 5001}
    assert quality_rules.judge_documents(empty(spark)).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------

def test_licenses(spark):
    values = ["text\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.\nreleased UNDER the mit license",
              "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", None, "", prose(1, 200),
              "They were licensed under no condition", "under the of and", prose(2, 3000) + "\nLicensed under CC BY-SA 4.0"]
    docs = texts(spark, *values)
    got = {(r.doc_id, r.license, r.n_segments) for r in licenses.scan(docs.union(docs)).collect()}
    assert got == {(0, "apache-2.0", 1), (1, "mit", 1), (2, "gpl-3.0", 1), (3, "cc-by-nc-4.0", 1), (9, "cc-by-sa-4.0", 1)}
    assert licenses.scan(empty(spark)).count() == 0


# --- decontamination --------------------------------------------------------------------------------------------

def distance(item, passage):
    last = [0] * (len(passage) + 1)
    for n, x in enumerate(item, 1):
        now = [n]
        for m, y in enumerate(passage, 1):
            now.append(min(last[m] + 1, now[-1] + 1, last[m - 1] + (x != y)))
        last = now
    return min(last)


def test_edit_distance():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(1, 12))] for _ in range(2))
        assert decontamination.edit_distance_within(a, b)[0] == distance(a, b)


def test_leaks_match_brute_force(spark):
    r = random.Random(11)
    items = [prose(100 + n, r.randint(9, 60)) for n in range(25)]
    rows, params = [], decontamination.LeakSearch()
    for n, item in enumerate(items):
        words = item.split()
        for _ in range(r.randint(0, len(words) // 5)):
            at, kind = r.randrange(len(words)), r.random()
            words[at:at + (kind > 0.3)] = [] if kind > 0.7 else [f"q{r.randrange(99)}"]
        around = (prose(500 + n, 70), prose(600 + n, 50)) if n % 3 else ("", "")
        rows.append((n, f"{around[0]} {' '.join(words).title() if n % 2 else ' — '.join(words)} {around[1]}", None, None))
    rows += [(100, None, None, None), (101, "", None, None), (102, prose(1, 900), None, None), (3, rows[3][1], None, None), (None, items[0], None, None)]
    marks = spark.createDataFrame([(n, t, "x") for n, t in enumerate(items)] + [(50, None, "x"), (51, "too short", "x"), (3, items[3], "x")], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): x.edits for x in decontamination.find_leaks(frame(spark, rows), marks, params).collect()}
    split = lambda t: decontamination.words_of((t or "").lower().replace("—", " "))
    want = {}
    for d, t, _, _ in rows:
        for i, item in enumerate(items):
            if d is not None and (edits := distance(split(item), split(t))) <= params.edits(len(split(item))):
                want[d, i] = edits
    assert len(want) >= 20 and got == want
    assert decontamination.find_leaks(empty(spark), marks).count() == 0
    assert decontamination.find_leaks(frame(spark, rows), marks.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["insert", "delete", "substitute", "mixed"])
def test_leaks_at_the_edit_limit_whatever_the_length(spark, kind):
    r, params = random.Random(23), decontamination.LeakSearch()
    words = {n: [f"w{r.randrange(5000)}" for _ in range(size)] for n, size in enumerate([*range(8, 32), 40, 59, 100, 100, 200, 200, 300, 400])}
    rows = []
    for n, item in words.items():
        held, at = [], set(r.sample(range(len(item)), params.edits(len(item))))
        for place, word in enumerate(item):
            act = r.choice(["insert", "delete", "substitute"]) if kind == "mixed" else kind
            new = [f"q{r.randrange(99)}"]
            held += [word] if place not in at else {"insert": new + [word], "delete": [], "substitute": new}[act]
        rows.append((n, " ".join([*prose(n, 30).split(), *held, *prose(n + 90, 30).split()]), None, None))
    marks = spark.createDataFrame([(n, " ".join(item)) for n, item in words.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(frame(spark, rows), marks, params).collect()}
    assert got == {(n, n) for n in words}


def test_walks_reach_the_target_recall():
    params = decontamination.LeakSearch()
    for size in (5, 6, 7, 8, 9, 12):
        walks = decontamination.walks_for(size, params)
        for window, text in decontamination.edited_windows(size, 300, np.random.default_rng(99 + size)):
            keys = walks.keys(window)
            found = np.any([walks.keys(text[:, n:n + size]) == keys for n in range(5)], 0).any(1)
            assert found.mean() >= params.target_recall - 3 * (params.target_recall * (1 - params.target_recall) / 300) ** 0.5
    assert {params.piece(n) for n in range(8, 600)} <= set(range(5, 11))
    assert all(params.edits(n) < 2 * params.pieces(n) for n in range(8, 600))


def test_leaks_that_share_their_words(spark):
    """A run of words that all items and many documents hold is a key of them all; still every item is found where it is."""
    common = prose(77, 8)
    items = [(n, f"{prose(500 + n, 9)} {common} {prose(600 + n, 9)}") for n in range(20)]
    rows = [(n, f"{prose(n, 30)} {items[n % 20][1] if n < 60 else common} {prose(2000 + n, 30)}", "en", "s") for n in range(200)]
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(frame(spark, rows), marks).collect()}
    assert got == {(n, n % 20) for n in range(60)}


# --- language ---------------------------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    pieces, p = language_id.Pieces(names), np.array([0.1, 0.2, 0.15, 0.25, 0.1, 0.1, 0.1])

    def total(word):
        return 1.0 if not word else sum(p[n] * total(word[len(x):]) for n, x in enumerate(names) if word.startswith(x))

    words = ["a", "ab", "abab", "baab", "b" * 20]
    scaled = (p * language_id._LETTER_SCALE ** pieces.lengths)[:, None]
    assert np.allclose(language_id.word_scores(pieces, scaled, words)[:, 0], [np.log(total("▁" + w)) for w in words], atol=1e-6)
    counts = language_id.expected_counts(pieces, scaled, ["ab"], np.array([0]), np.array([3.0]))[:, 0]
    ways = {(0, 2, 3): 0.1 * 0.15 * 0.25, (1, 3): 0.2 * 0.25, (0, 4): 0.1 * 0.1, (6,): 0.1}
    want = np.zeros(7)
    for way, weight in ways.items():
        want[list(way)] += 3 * weight / sum(ways.values())
    assert np.allclose(counts, want, atol=1e-6)


def test_forward_sums_of_long_unseen_runs():
    names = ["▁", "a", "b", "ab", "x", "xx", "xxxxx"]
    pieces, p = language_id.Pieces(names), np.array([[0.2, 0.1], [0.4, 0.2], [0.3, 0.2], [0.1, 0.1], [1e-9, 0.1], [1e-10, 1e-9], [3e-12, 1e-9]])
    scaled = p * language_id._LETTER_SCALE ** pieces.lengths[:, None]
    no_piece = np.log(language_id._NO_PIECE)

    def sums(word, lang):
        ahead = [-np.inf] * len(word) + [0.0]
        for at in reversed(range(len(word))):
            ways = [np.log(p[n, lang]) + ahead[at + len(x)] for n, x in enumerate(names) if word.startswith(x, at)]
            ahead[at] = np.logaddexp.reduce([*ways, no_piece + ahead[at + 1]])
        return ahead

    words = ["x" * 64, "q" * 64, "ab" * 32, "x" * 30 + "q" * 34, "a", "q" * 20 + "ab" + "x" * 42]
    want = [[sums("▁" + w, lang)[0] for lang in (0, 1)] for w in words]
    assert np.allclose(language_id.word_scores(pieces, scaled, words), want, rtol=1e-9)
    for n, word in enumerate(words):
        for lang in (0, 1):
            got = language_id.expected_counts(pieces, scaled, ["ab", word], np.array([0, lang]), np.array([0.0, 2.0]))[:, lang]
            ahead, behind = sums("▁" + word, lang), [-np.inf] * (len(word) + 2)
            behind[0], counts = 0.0, np.zeros(len(names))
            for at in range(len(word) + 1):
                behind[at + 1] = np.logaddexp(behind[at + 1], behind[at] + no_piece)
                for k, x in enumerate(names):
                    if ("▁" + word).startswith(x, at):
                        way = behind[at] + np.log(p[k, lang])
                        counts[k] += 2 * np.exp(way + ahead[at + len(x)] - ahead[0])
                        behind[at + len(x)] = np.logaddexp(behind[at + len(x)], way)
            assert np.allclose(got, counts, rtol=1e-6, atol=1e-12), (word, lang)


def test_languages_of_texts_with_long_unseen_runs(spark):
    rows = [(n, prose(n, 60, EN if n % 2 else DE) + (" " + "ж" * 64 if n > 90 else ""), "en" if n % 2 else "de", None) for n in range(120)]
    rows += [(200 + n, f"{prose(300 + n, 400)} {run} {prose(400 + n, 400)}", None, None) for n, run in enumerate(["漢" * 64, "ъ" * 64, "ꙮ" * 64, "ёъ" * 90])]
    for row in language_id.identify(frame(spark, rows), PIECES).collect():
        assert 0 <= row.score <= 1
        assert row.lang_pred == ("en" if row.doc_id >= 200 or row.doc_id % 2 else "de")


def test_letters_of_every_code_point():
    import regex

    for begin in range(0, 0x110000, 4096):
        letters = [chr(c) for c in range(begin, begin + 4096) if not 0xD800 <= c < 0xE000]
        for c in letters:
            lower = c.lower()
            assert bool(language_id.text_words(c)) == any(regex.match(r"\p{L}", x) is not None for x in lower), hex(ord(c))
    assert language_id.text_words("½ ② 12 Ⅷ _") == [] and language_id.text_words("a\u0301b") == ["a\u0301b"]


def test_languages(spark):
    rows = [(n, prose(n, 60, EN if n % 2 else DE), "en" if n % 2 else "de", None) for n in range(120)]
    rows += [(200, None, "en", None), (201, "", None, None), (202, "12 !?", "de", None), (203, "漢字" * 100, None, None), (None, "und nicht über", "de", None),
             (1, rows[1][1], "en", None)]
    got = language_id.identify(frame(spark, rows), PIECES).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is not None and row.doc_id < 200:
            assert row.lang_pred == ("en" if row.doc_id % 2 else "de") and 0 <= row.score <= 1
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        if row.doc_id in (200, 201, 202):
            assert (row.lang_pred, row.score) == ("und", 0.0)
    assert language_id.identify(empty(spark), PIECES).count() == 0
    assert {r.lang_pred for r in language_id.identify(texts(spark, "a b").withColumn("lang", F.lit(None).cast("string")), PIECES).collect()} == {"und"}


# --- pages ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<hr>c", "a\nb\n\nc"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z", "- one\n- two\n  3. x\n  4. y\n\nz"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td colspan=2>wide cell<tr><td>x<td>y</table>", "Name       N\nlong name  1\nwide cell\nx          y"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<div style='visibility:hidden'>no<span style='VISIBILITY : visible'>seen<b>too</b></span>no</div>", "seentoo"),
    ("<p>a<p style='visibility:collapse'>no<i>no</i><p style='visibility:hidden; visibility:visible'>b<span hidden style='visibility:visible'>no</span>", "a\n\nb"),
    ("<div style='visibility:hidden'><div style='display:none'><b style='visibility:visible'>no</b></div><img alt=no>no</div>c", "c"),
    ("<div hidden>no</div><p style='color:red; display : none'>no<p>yes<script>var t='</p>';</script><style>x</style><!-- no -->", "yes"),
    ("<pre>\n a\n   b</pre>", " a\n   b"), ("<blockquote>q<p>r</blockquote>", "  q\n\n  r"), ("a&nbsp;&amp; 1 < 2 <b>c</i></b>d", "a & 1 < 2 cd"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("<select><option>a<option selected>b</select>", "b"), ("<title>t</title><textarea>x <b></textarea>", "x <b>"), ("<p class=\"a>b\">x", "x"),
    ("x <a href='", "x"), ("<div>" * 3000 + "deep", "deep"), ("</p>a</div><li>b", "a\nb"),
])
def test_pages(page, text):
    assert html_text.render(page) == text


def test_pages_keep_all_visible_words(spark):
    r = random.Random(5)
    words, parts = [f"w{n}" for n in range(2000)], []
    for w in words:
        parts.append(r.choice(["<p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<td>", "<tr>", "<table>", "</table>", " ", "<ul>", "</ul>", "<span hidden>no</span>"]) + f" {w} ")
    rows = spark.createDataFrame([(1, "".join(parts), "a"), (1, "".join(parts), "a"), (None, None, "b")], "page_id long, html string, text string")
    got = html_text.extract(rows).orderBy(F.desc("page_id")).collect()
    assert sorted(got[0].text.replace("- ", " ").split()) == sorted(words) and got[0].text == got[1].text and got[2].text == ""
    assert got[0].n_lines == len(got[0].text.split("\n")) and html_text.extract(rows.limit(0)).count() == 0


# --- shards -----------------------------------------------------------------------------------------------------

def shards(rows, limit):
    """Split buckets one bit at a time."""
    todo, out = [("", rows)], {}
    while todo:
        bits, members = todo.pop()
        size = sum(n for _, _, n in members)
        if size <= limit or len(bits) == 60:
            out.update({d: (bits, size) for d, _, _ in members})
            continue
        for bit in "01":
            part = [m for m in members if m[1][len(bits)] == bit]
            if part:
                todo.append((bits + bit, part))
    return out


@pytest.mark.parametrize("limit", [1, 300, 5000, 10**9])
def test_shards(spark, limit):
    values = [None, "", *("é" * n for n in range(60)), "x" * 4000]
    got = {r.doc_id: (r.shard, r.shard_bytes) for r in sharding.assign(texts(spark, *values), limit).collect()}
    bits = lambda n: f"{int(hashlib.md5(str(n).encode()).hexdigest()[:15], 16):060b}"
    assert got == shards([(n, bits(n), len((t or "").encode())) for n, t in enumerate(values)], limit)


def test_shards_of_repeated_and_nameless_rows(spark, tmp_path):
    rows = frame(spark, [(1, "abc", None, None)] * 5 + [(None, "abc", None, None), (None, "xyz", None, None), (2, "q", None, None)])
    got = sharding.assign(rows, 6).collect()
    assert len(got) == 8 and {r.shard_bytes for r in got if r.doc_id == 1} == {15} and {r.depth for r in got if r.doc_id == 1} == {60}
    assert sharding.assign(empty(spark), 6).count() == 0
    placed = sharding.write_shards(texts(spark, *("x" * n for n in range(40))).drop("shard"), 200, str(tmp_path / "s"))
    sizes = {r.shard: r.shard_bytes for r in placed.collect()}
    for name, size in sizes.items():
        folder = tmp_path / "s" / f"shard_bits=b{name}"
        assert spark.read.parquet(str(folder)).agg(F.sum(F.length("text"))).first()[0] == size <= 200


def test_written_shards_hold_rows_without_an_id(spark, tmp_path):
    rows = frame(spark, [(None, "abc" * n, None, None) for n in range(20)] + [(None, None, None, None), (1, "abc", None, None), (1, "x", None, None)]).drop("shard")
    sharding.write_shards(rows, 100, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, rows.select("doc_id", "text").collect()))


# --- quality classifier -----------------------------------------------------------------------------------------

def test_classifier_learns_from_few_labels(spark):
    rows = [(n, prose(n, 80) if n % 3 else " | ".join(prose(n, 40).upper().split()) + "!!", "en", f"s{n % 5}") for n in range(400)]
    rows += [(1000, None, None, None), (1001, "", "en", None), (None, prose(3, 50), None, "s1"), (5, rows[5][1], "en", "s0")]
    labels = spark.createDataFrame([(n, int(n % 3 > 0), 0, "t") for n in range(0, 400, 7)] + [(3, None, 0, "t"), (None, 1, 0, "t")],
                                   "doc_id long, quality int, toxic int, text string")
    got = quality_classifier.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    named = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.kept == (r.doc_id % 3 > 0) for r in named) >= 0.97 * len(named)
    assert all(0 <= x <= 1 for r in got for x in (r.score, r.text_score, r.page_score))
    assert {r.score for r in quality_classifier.classify(frame(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), labels).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    item = prose(900, 30)
    r = random.Random(2)
    rows = [(n, prose(n, 70, EN if n % 2 else DE), "en" if n % 2 else "de", "s") for n in range(60)]
    rows += [(100, rows[1][1], "en", "s"), (101, mutated(rows[3][1], r, 1), "en", "s"), (102, "short", "en", "s"), (103, "1 2 3 . " * 40, None, "s"),
             (104, f"{rows[5][1][:200]} {item} {prose(70, 60)}", "en", None), (7, rows[7][1], "en", "s"), (105, None, None, None)]
    docs = frame(spark, rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {d for d, _, _, _ in rows if d < 60}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
            path = str(tmp_path / name)
            out.write.parquet(path)
            out = docs = spark.read.parquet(path)
    assert sorted(x.doc_id for x in out.collect()) == sorted(want)
    assert os.path.isdir(tmp_path / "decontamination")


def test_pipeline_stages_decide_row_by_row(spark, tmp_path):
    import corpus_pipeline

    item, good = prose(900, 30), [prose(n, 70) for n in range(12)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def kept(stage, rows):
        return sorted((x.text for x in dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, rows), str(tmp_path)).collect()), key=str)

    ids = [(None, 7)[n % 2] for n in range(6)]
    base = [(20 + n, t, "en", "s") for n, t in enumerate(good[6:])]
    rows = [*((d, t, "en", "s") for d, t in zip(ids, good)), *base]
    assert kept("quality_rules", [*rows, (None, "short", "en", "s"), (7, "short too", "en", "s")]) == sorted(good)
    assert kept("language_id", [*rows, (None, "1 2", "en", "s"), (7, "3 4", "en", "s")]) == sorted(good)
    assert kept("near_duplicates", [*rows, (None, good[0], "en", "s"), (7, good[1], "en", "s"), (None, good[8], "en", "s")]) == sorted(good)
    leaks = [(d, f"{prose(70, 40)} {item} {prose(71, 40)}", "en", "s") for d in (None, 7)]
    assert kept("decontamination", [*rows, *leaks]) == sorted(good)
