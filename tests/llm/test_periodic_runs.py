"""Periodic runs against a brute-force search: planted and random repeats, nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

from routewright.llm import periodic_runs, queries
from routewright.llm.periodic_runs import RunSearch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, exponent=3):
    """Every stretch that keeps a period and cannot be extended, smallest periods only."""
    found = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, exponent * q) and (start == 0 or words[start - 1] != words[start + q - 1]):
                found.setdefault((start, length), q)
            start = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic(r, letters):
    """Words with nested, adjacent and cut-off repeats."""
    words = []
    for _ in range(r.randint(1, 8)):
        kind = r.randint(0, 3)
        part = [r.choice(letters) for _ in range(r.randint(1, 12))]
        if kind == 0:
            words += part * r.randint(1, 9)
        elif kind == 1:
            inner = part[:3] * r.randint(1, 5) + part
            words += inner * r.randint(1, 6)
        else:
            words += part * r.randint(2, 5) + part[: r.randint(0, len(part))]
    return words


def test_runs_match_brute_force(spark):
    r = random.Random(5)
    rows = [(n, " ".join(periodic(r, "ab" if n % 3 else "abcdefghij"))) for n in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "a"), (1004, " ".join("a" * 23)), (1005, " ".join("a" * 24)),
             (1006, "x\x0by\x0cz w " * 30), (1007, "É é " * 40), (1008, "A a " * 40), (1009, "a b " * 12 + "c " + "a b " * 12)]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, runs int, start int, collapsed int")
    for got, (doc_id, text) in zip(periodic_runs.find_runs(docs).orderBy("doc_id").collect(), rows):
        words = WORD.findall(text or "")
        expected = brute_runs(words)
        assert (got.doc_id, [tuple(x) for x in got.runs], got.n_words) == (doc_id, expected, len(words))
        dropped = {i for s, m, q in expected for i in range(s + q, s + m)}
        assert got.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_query_rows_match_brute_force(spark, tmp_path):
    r = random.Random(6)
    words = [f"w{n}" for n in range(300)]
    rows = [(n, " ".join(r.choice(words) for _ in range(r.randint(0, 200)))) for n in range(300)] + [(7, None), (-5, "b c " * 90), (None, "b c " * 90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = [brute_row(d, t) for d, t in rows if d is not None] + [(None, *brute_row(-5, "b c " * 90)[1:])]
    assert got == sorted(expected, key=str)
    assert sum(row[1] for row in got) > 15


def test_planted_rows_hold_form_feeds_and_the_letter_f(spark, tmp_path):
    r = random.Random(7)
    words = ["offer", "f", "fan", "if", "x\x0cy", "a\x0bb", "é\x85f", "w\x1cf", "\U0001F600f"]
    rows = [(n, " ".join(r.choice(words) for _ in range(r.randint(0, 120)))) for n in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == [brute_row(d, t) for d, t in rows]


def test_other_limits_and_repeated_rows(spark):
    r = random.Random(8)
    texts = [periodic(r, "abc") for _ in range(60)]
    docs = spark.createDataFrame([(n % 20, " ".join(t)) for n, t in enumerate(texts)], "doc_id int, text string")
    got = sorted((row.doc_id, sorted(map(tuple, row.runs))) for row in periodic_runs.find_runs(docs, RunSearch(6, 2)).collect())
    assert got == sorted((n % 20, sorted(brute_runs(t, 6, 2))) for n, t in enumerate(texts))


def test_very_long_text(spark):
    r = random.Random(9)
    noise = [f"n{r.randint(0, 10**9)}" for _ in range(40_000)]
    words = noise[:20_000] + ["a"] * 100_000 + noise[20_000:] + ["b", "c", "d"] * 9 + ["e"]
    row = periodic_runs.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.runs] == [(20_000, 100_000, 1), (140_000, 27, 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.summarise(periodic_runs.find_runs(empty)).count() == 0
