"""Lexical search against scoring every document: statistics, ties, repeats, nulls, long texts, clashing columns, several segments."""

import collections
import math
import random
import re

import numpy as np
import pytest

from routewright.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, top=10):
    counted = [(d, collections.Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, n, doc, -s) for n, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "t", 2) for d, t in rows], "doc_id long, text string, segment int, term string, df int")


def items_table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "t", 2) for d, t in rows], "item_id long, text string, part int, term string, times int")


def corpus(seed, n_docs, words=400):
    r = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(words)] + ["Über", "naïve", "漢字"]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    return [(n, " ".join(r.choices(vocabulary, weights, k=r.randint(0, 60) if n % 50 else 3000))) for n in range(n_docs)]


def queries_of(seed, n, words=400):
    r = random.Random(seed)
    return [(k, " ".join(r.choice([f"w{r.randrange(words)}", f"W{r.randrange(20)}", "naïve", "zzz"]) for _ in range(r.randint(0, 40)))) for k in range(n)]


@pytest.mark.parametrize("segment_bytes", [1 << 24, 30_000])
def test_search_matches_scoring_everything(spark, monkeypatch, segment_bytes):
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", segment_bytes)
    monkeypatch.setattr(lexical_search, "BLOCK", 256 if segment_bytes > 1 << 20 else 16)
    monkeypatch.setattr(lexical_search, "ITEMS_TOGETHER", 25)
    docs, items = corpus(1, 3000), queries_of(2, 80)
    got = found(lexical_search.search(lexical_search.build_index(table(spark, docs).coalesce(3)), items_table(spark, items)))
    assert got == brute(docs, items)
    assert len({r[0] for r in got}) > 70


def test_ties_repeats_nulls_and_frequent_words(spark):
    docs = [(n, "same text here") for n in range(40, 0, -1)] + [(None, "same text here"), (3, "same text"), (3, "same text"), (50, None), (51, ""), (52, "!! ..")]
    docs += [(60, "the " * 400 + "same"), (61, "The THE the"), (62, "x_y x-y"), (63, "a1éb")]
    items = [(1, "same text"), (2, "the the same the"), (3, None), (4, ""), (5, "absent"), (6, "X Y"), (7, "A1éB"), (None, "here"), (8, "same")]
    assert found(lexical_search.search(lexical_search.build_index(table(spark, docs)), items_table(spark, items))) == brute(docs, items)
    repeated = [(1, "text"), (1, "same"), (1, None)]
    got = found(lexical_search.search(lexical_search.build_index(table(spark, docs)), items_table(spark, repeated), 3))
    assert got == brute(docs, [(1, None)], 3)


def test_every_document_has_the_word(spark):
    docs = [(n, "common " * (n % 5 + 1)) for n in range(600)]
    assert found(lexical_search.search(lexical_search.build_index(table(spark, docs)), items_table(spark, [(1, "common")]))) == brute(docs, [(1, "common")])


def test_empty_tables(spark):
    docs, items = table(spark, [(1, "a")]), items_table(spark, [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (table(spark, [(1, None)]), items)):
        assert lexical_search.search(lexical_search.build_index(d), i).count() == 0


def test_blocks_are_rejected_before_decoding():
    """A rare strong term fills the heap; blocks of the weak one that cannot reach its worst score stay packed."""
    stats = lexical_search.Statistics(100_000, 10_000_000)
    n_docs = 256 * 40
    parts = stats.length_part(np.full(n_docs, 100))

    def postings(docs, tf, weight):
        block, counts = np.unique(docs // lexical_search.BLOCK, return_counts=True)
        row = {"block": block, "n_postings": counts, "n_pairs": np.ones(len(block), int), "pair_tf": np.full(len(block), tf),
               "pair_n": np.full(len(block), 100), "places": (docs % lexical_search.BLOCK).astype(np.uint8).tobytes(),
               "tfs": np.full(len(docs), tf, np.uint8).tobytes(), "large": []}
        return lexical_search._List(row, weight, parts, stats)

    weak, strong = postings(np.arange(n_docs), 1, 10), postings(np.arange(2000, 2020), 5, 9000)
    docs, scores = lexical_search.search_segment([weak, strong], np.array([1, 1]), n_docs, np.arange(n_docs), 10)
    assert docs.tolist() == list(range(2000, 2010)) and len(set(scores.tolist())) == 1
    assert weak.decoded.sum() <= 2


def test_query_reads_whole_tables(spark, tmp_path):
    docs, items = corpus(4, 200), queries_of(5, 10)
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    items_table(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert found(queries.op11_block_max(spark, str(tmp_path))) == brute(docs, items)
