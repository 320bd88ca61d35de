"""One registered query for each operator, with production parameters over whole tables, and SQL twins where SQL can say them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routewright.llm import (
    bpe, decontamination, html_text, language_id, lexical_search, licenses, near_duplicates, periodic_runs, quality_classifier, quality_rules,
    sharding, token_files, warc)
from routewright.session import staging_path

#: Folder of the public vocabularies; every operator takes the file as a parameter.
TOKENIZERS = "/opt/tokenizers"
WORD_BPE = os.path.join(TOKENIZERS, "word_bpe_49k.json")
PIECES = os.path.join(TOKENIZERS, "piece_bpe_32k.model")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


_WORD = "[^\\x20\\x09-\\x0D]+"
_SPACE = "[\\x20\\x09-\\x0D]"


@query(f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORD}') AS w FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
         - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
s AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(n * n) AS n2, sum(f * f / n) AS ff FROM h),
p AS (SELECT *, least(greatest(f / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1)) AS mean FROM s),
e AS (SELECT mean, mean * (1 - mean) AS noise,
        CASE WHEN n - n2 / n > 0 THEN (ff - f * f / n - (k - 1) * mean * (1 - mean)) / (n - n2 / n) ELSE 0 END AS excess FROM p),
prior AS (SELECT mean, CASE WHEN excess <= 0 THEN 1000.0 ELSE least(1000.0, greatest(2.0, noise / excess - 1)) END AS weight FROM e),
v AS (SELECT source, (f + mean * weight) / (n + weight) >= 0.5 AS rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
""")
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents")).drop("host", "host_rate")


@query()
def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    rows = ", ".join(f"({n}, '{k}', '{t}')" for n, (k, t) in enumerate(licenses.notices()))
    clean = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT template, license, {pairs} AS g FROM (
    SELECT template, license, {clean.format('notice')} AS w FROM (VALUES {rows}) AS x(template, license, notice))),
s AS (SELECT DISTINCT doc_id, {clean.format('line')} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
b AS (SELECT doc_id, w, {pairs} AS g FROM s WHERE len(w) > 1),
m AS (SELECT doc_id, w, license, template, 2.0 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS dice
      FROM b JOIN t ON len(b.g) BETWEEN len(t.g) * 0.6 AND len(t.g) / 0.6),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY dice DESC, template) AS n FROM m WHERE dice >= 0.75)
SELECT doc_id, license, count(*) AS n_segments, round(max(dice), 6) AS best_dice FROM r WHERE n = 1 GROUP BY doc_id, license
"""


@query(_licenses_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query()
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), WORD_BPE, 2, path)
    return token_files.read_documents(spark, path)


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), PIECES)


@query()
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


#: Bytes of text in a shard.
SHARD_BYTES = 64 << 20


@query(f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash FROM documents),
p AS (SELECT depth, hash >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM d, range(61) AS r(depth) GROUP BY ALL),
l AS (SELECT doc_id, n_bytes, hash, min(depth) AS depth FROM d, range(61) AS r(depth) JOIN p USING (depth)
      WHERE p.prefix = hash >> (60 - depth) AND (shard_bytes <= {SHARD_BYTES} OR depth = 60) GROUP BY ALL)
SELECT doc_id, CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(l.hash >> (60 - l.depth)), 60, '0'), l.depth::INT) END AS shard,
       l.depth::INT AS depth, n_bytes, shard_bytes
FROM l JOIN p ON l.depth = p.depth AND p.prefix = l.hash >> (60 - l.depth)
""")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query()
def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: where crc32(doc_id) ends in 0, the words from one on repeat the first few of them, as the query's contract says."""
    words = "array_remove(split(translate(text, '\\t\\n\\u000b\\u000c\\r', '     '), ' '), '')"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("words", F.expr(f"CASE WHEN h % 10 = 0 THEN {words} END")).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(concat(slice(words, 1, int(a)), "
                     "transform(sequence(a, n - 1), i -> get(words, int(a + (i - a) % p)))), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summarise(periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS keeper FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
""")
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS t FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS t FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
i AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY ALL),
r AS (SELECT item_id, doc_id,
        sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
WHERE rank <= 10
""")
def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
