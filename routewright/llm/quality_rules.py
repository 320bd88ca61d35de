"""Host-level quality rules, in DataFrame operations only.

Each document gets base measures and a base verdict. Failures are added up by host, each host's failure rate is shrunk
towards an empirical beta prior fitted to all hosts, and hosts whose shrunk rate reaches ``host_limit`` take all their
documents with them.

A null text has no words. Documents without a host are one host of their own. Repeated rows count, and come out, as
often as they are there. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routewright.session import cut_lineage

#: Fixed values of the base rules.
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
LONG_WORDS = 1 << 14


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Hosts at or over this shrunk failure rate are rejected.
    host_limit: float = 0.5
    #: Prior weight (alpha + beta, in documents) where the host rates do not vary enough to fit one, and its upper bound.
    most_weight: float = 1000.0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def measure_text(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of every row, and its columns named by ``carry``.

    Every three-word window becomes one long: its hash above, its place below, with as many bits for places as the text
    needs. Sorted, equal windows are neighbours, and the words they cover follow from the gaps between their places. What
    a text needs for places is missing from its hashes, so texts of ``LONG_WORDS`` words and more keep the two apart and
    compare whole hashes.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rows = rows.select(
        "doc_id", "host", _words(F.col("text")).alias("words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"), *carry)
    rows = rows.select(
        "doc_id", "host", "words", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.expr("cast(ceil(log2(size(words) + 2)) as int)").alias("bits"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), *carry)
    each = "transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> {})"
    full = "xxhash64(w, get(words, i + 1), get(words, i + 2))"
    windows = F.expr(f"CASE WHEN n_words < {LONG_WORDS} THEN " + each.format(f"shiftleft({full}, bits) | cast(i as bigint)") + " ELSE array() END")
    pairs = F.expr(f"CASE WHEN n_words >= {LONG_WORDS} THEN " + each.format(f"named_struct('h', {full}, 'i', cast(i as bigint))") + " END")
    rows = rows.withColumns({"windows": F.sort_array(windows), "pairs": F.sort_array(pairs)}).drop("words")
    found = F.expr(
        "filter(windows, (w, i) -> shiftright(w, bits) = shiftright(get(windows, i - 1), bits) "
        "or shiftright(w, bits) = shiftright(get(windows, i + 1), bits))")
    rows = rows.withColumn("found", found).drop("windows")
    places = F.expr("sort_array(CASE WHEN pairs IS NULL THEN transform(found, w -> w & (shiftleft(1L, bits) - 1L)) ELSE transform("
                    "filter(pairs, (w, i) -> w.h = get(pairs, i - 1).h or w.h = get(pairs, i + 1).h), w -> w.i) END)")
    rows = rows.withColumn("places", places).drop("found", "pairs")
    covered = F.expr(
        "aggregate(transform(places, (p, i) -> least(3L, coalesce(get(places, i + 1) - p, 3L))), 0L, (a, x) -> a + x)")
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), *carry)


def base_failed(rules: HostRules) -> Column:
    return ((F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def host_rates(measured: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """``host, n_docs, n_failed, host_rate, host_rejected``; the beta prior is fitted by moments over all hosts."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = cut_lineage(hosts)
    totals = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff")).first()
    alpha, beta = fit_prior(totals["n"] or 0, totals["f"] or 0, totals["k"], totals["n2"] or 0, totals["ff"] or 0.0, rules.most_weight)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate >= rules.host_limit)


def fit_prior(n: int, f: int, k: int, n2: int, ff: float, most_weight: float) -> tuple[float, float]:
    """Alpha and beta from totals over hosts: documents, failures, hosts, squared documents, failures squared by documents."""
    if not n:
        return 1.0, 1.0
    mean = min(max(f / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    between = ff - f * f / n  # variation of host rates about the mean, weighted by documents
    spread = n - n2 / n
    noise = mean * (1 - mean)
    excess = (between - (k - 1) * noise) / spread if spread > 0 else 0.0
    weight = most_weight if excess <= 0 else min(most_weight, max(2.0, noise / excess - 1))
    return mean * weight, (1 - mean) * weight


def judge_documents(docs: DataFrame, rules: HostRules = HostRules(), carry: Sequence[str] = ()) -> DataFrame:
    """The measures of every row with ``base_failed``, ``host_rate`` and ``kept``, and its columns named by ``carry``."""
    measured = cut_lineage(measure_text(docs, carry).withColumn("base_failed", base_failed(rules)))
    hosts = host_rates(measured, rules).select(
        F.coalesce("host", F.lit("")).alias("host_key"), F.isnull("host").alias("no_host"), "host_rate", "host_rejected")
    keyed = measured.withColumn("host_key", F.coalesce("host", F.lit(""))).withColumn("no_host", F.isnull("host"))
    joined = keyed.join(hosts, ["host_key", "no_host"], "left")
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), *carry)
