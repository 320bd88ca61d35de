"""Job inputs derived from the given tables, as SQL that Spark and DuckDB both read.

``{table}`` names a given table; a fixture may name another fixture as ``[name]``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_POINT = "50 + CAST(({k} * 7919) % 4000 AS DOUBLE) / 1000 AS lat, -4 + CAST(({k} * 104729) % 8000 AS DOUBLE) / 1000 AS lon"
_CITY = (
    "CASE {k} % 7 WHEN 0 THEN 'LEEDS' WHEN 1 THEN 'NEW YORK' WHEN 2 THEN 'YORK' WHEN 3 THEN 'ST ALBANS' "
    "WHEN 4 THEN 'OSLO' WHEN 5 THEN 'HONG KONG' ELSE 'MILTON KEYNES' END"
)
_SLUG = (
    "CASE {k} % 6 WHEN 0 THEN 'transport' WHEN 1 THEN 'geography' WHEN 2 THEN 'shapes' WHEN 3 THEN 'cats-dogs' "
    "WHEN 4 THEN 'misc' ELSE 'birds' END"
)
STAMP = "2024-01-01T00:00:00+00:00"


def div(k: str, n: int) -> str:
    return f"CAST(floor(({k}) / {n}) AS BIGINT)"


FIXTURES = {
    "points": f"SELECT c_custkey AS id, {_POINT.format(k='c_custkey')} FROM {{customer}}",
    "catalogue": f"""
        SELECT c_custkey AS id, c_name AS title, {_SLUG.format(k='length(c_mktsegment)')} AS category,
               lower(c_name) AS subcategory,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'City ' || CAST(c_custkey % 37 AS STRING) END AS city,
               CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 'Land ' || CAST(c_custkey % 5 AS STRING) END AS country,
               CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE 50 + CAST((c_custkey * 7919) % 4000 AS DOUBLE) / 1000 END AS lat,
               CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE -4 + CAST((c_custkey * 104729) % 8000 AS DOUBLE) / 1000 END AS lon,
               CAST((c_custkey * 37) % 100 AS DOUBLE) / 100 AS geocode_confidence,
               CASE WHEN c_custkey % 20 = 9 THEN 'ocr-failed' WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 9 THEN 'ocr'
                    ELSE 'title' END AS geocode_source,
               CASE WHEN c_custkey % 3 = 0 THEN '["Mill Lane"]' END AS ocr_streets,
               CASE WHEN c_custkey % 20 = 9 OR c_custkey % 3 = 0 THEN '{STAMP}' END AS ocr_attempted_at,
               'https://img.example.org/' || CAST(c_custkey AS STRING) AS image_url,
               'https://site.example.org/home' AS page_url, CAST(NULL AS DOUBLE) AS distance_estimate_km,
               '{STAMP}' AS scraped_at,
               CASE WHEN c_custkey % 7 = 0 AND c_custkey % 10 <> 9 THEN 'gpx/' || CAST(c_custkey AS STRING) END AS gpx_path,
               CASE WHEN c_custkey % 7 < 3 THEN CAST((c_custkey * 53) % 100 AS DOUBLE) / 100 END AS reconstruction_confidence,
               CASE WHEN c_custkey % 7 < 3 THEN '{STAMP}' END AS reconstruction_attempted_at,
               CASE c_custkey % 7 WHEN 1 THEN 'georef: few' WHEN 2 THEN 'mapmatch: lost' END AS reconstruction_failure
        FROM {{customer}}""",
    "spots": f"""
        SELECT s_suppkey AS query_id, {_POINT.format(k='s_suppkey')},
               CAST(5 + s_suppkey % 5 * 10 AS DOUBLE) AS radius_km,
               CASE s_suppkey % 6 WHEN 0 THEN 'car' WHEN 1 THEN 'Dog' WHEN 2 THEN 'star' WHEN 3 THEN ' misc ' WHEN 4 THEN 'zzz'
                    END AS term
        FROM {{supplier}}""",
    "titles": f"""
        SELECT p_partkey AS position,
               CASE p_partkey % 5 WHEN 0 THEN {_CITY.format(k='p_size')} || ' ' || upper(p_name)
                    WHEN 1 THEN upper(p_name) || ' — ' || {_CITY.format(k='p_size')}
                    WHEN 2 THEN upper(p_name) || ' | ' || p_brand
                    WHEN 3 THEN upper(p_name) || ' 2019 (' || p_brand || ')!' ELSE p_name END AS title,
               {_SLUG.format(k='p_size')} AS category,
               'https://img.example.org/' || CAST(p_partkey AS STRING) AS image_url,
               'https://img.example.org/t/' || CAST(p_partkey AS STRING) AS thumbnail_url,
               'https://site.example.org/home' AS page_url, '{STAMP}' AS scraped_at
        FROM {{part}}""",
    "place_hits": """
        SELECT key, lat, lon, country FROM (
          SELECT lower(c) || ', ' || lower(l) AS key, l AS country, 40 + CAST(min(k) % 100 AS DOUBLE) / 10 AS lat,
                 CAST(min(k) % 77 AS DOUBLE) / 10 AS lon
          FROM (SELECT CASE p_size % 7 WHEN 0 THEN 'LEEDS' WHEN 1 THEN 'NEW YORK' WHEN 2 THEN 'YORK' WHEN 3 THEN 'ST ALBANS'
                       ELSE 'OSLO' END AS c,
                       CASE p_size % 7 WHEN 1 THEN 'United States' WHEN 0 THEN 'United Kingdom' WHEN 2 THEN 'United Kingdom'
                       WHEN 3 THEN 'United Kingdom' ELSE 'Norway' END AS l, p_partkey AS k FROM {part}) AS a GROUP BY c, l
          UNION ALL
          SELECT lower(replace(p_brand, '#', ' ')), 'Land', 10 + CAST(min(p_partkey) % 100 AS DOUBLE) / 10,
                 CAST(min(p_partkey) % 55 AS DOUBLE) / 10 FROM {part} WHERE p_size % 3 = 0 AND p_brand <> 'Brand#1' GROUP BY p_brand
        ) AS h""",
    # One street label per part, eight labels per image.
    "streets": f"""
        SELECT {div('p_partkey', 8)} AS image_id, p_partkey % 8 AS fragment_no, p_partkey AS no,
               p_name || ' ' || CASE p_size % 4 WHEN 0 THEN 'Rd' WHEN 1 THEN 'Ave' WHEN 2 THEN 'Ln' ELSE 'St.' END AS text,
               p_name || ' ' || CASE p_size % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'avenue' WHEN 2 THEN 'lane' ELSE 'street' END
                 AS name,
               CAST((p_partkey * 37) % 100 AS DOUBLE) / 100 AS conf,
               CAST(20 + (p_partkey * 13) % 50 AS DOUBLE) AS x_min, CAST(40 * (p_partkey % 8) + (p_partkey * 7) % 5 AS DOUBLE) AS y_min
        FROM {{part}}""",
    # The same labels with some m read as rn.
    "misread": """
        SELECT image_id, CASE WHEN no % 3 = 0 THEN replace(text, 'm', 'rn') ELSE text END AS text, conf, x_min + 40 AS x_center,
               y_min + 6 AS y_center, y_min AS band_y, x_min AS band_x, CAST(1 AS BIGINT) AS part,
               CASE WHEN no % 3 = 0 THEN replace(name, 'm', 'rn') ELSE name END AS name FROM [streets]""",
    # Raw fragments: the name and the street word apart, close enough to be joined or not, plus digits as noise.
    "fragments": """
        SELECT image_id, no * 4 AS fragment_no, substr(name, 1, length(name) - length(split_part(name, ' ', 3)) - 1) AS text, conf,
               x_min, x_min + 60 AS x_max, y_min, y_min + 10 + no % 4 AS y_max, x_min + 30 AS x_center,
               y_min + CAST(10 + no % 4 AS DOUBLE) / 2 AS y_center FROM [streets]
        UNION ALL
        SELECT image_id, no * 4 + 1, split_part(text, ' ', 3), conf / 2, x_min + 60 + gap, x_min + 85 + gap, y_min + 1, y_min + 13,
               x_min + 72.5 + gap, y_min + 7 FROM (SELECT *, CAST(CASE WHEN no % 5 = 0 THEN 80 ELSE 5 + no % 9 END AS DOUBLE) AS gap FROM [streets]) AS g
        UNION ALL
        SELECT image_id, no * 4 + 2, CAST(no % 50 AS STRING), conf, x_min + 61, x_min + 64, y_min, y_min + 9, x_min + 62.5, y_min + 4.5
        FROM [streets] WHERE no % 3 = 0""",
    "labels": """
        SELECT image_id, text, conf, x_min + 40 AS x_center, y_min + 6 AS y_center, y_min AS band_y, x_min AS band_x,
               CAST(1 AS BIGINT) AS part, name FROM [streets]""",
    # Street gazetteer: every name in some of the nations' cities, a few streets each.
    "gazetteer": """
        SELECT nn * 1000 + n_nationkey * 10 + copy AS place_id, name,
               CASE WHEN nn % 5 = 0 THEN name || ' (en)' END AS name_en,
               40 + n_nationkey + CAST((nn * 17 + copy * 3) % 20 AS DOUBLE) / 1000 AS lat,
               n_nationkey - 10 + CAST((nn * 29 + copy * 7) % 20 AS DOUBLE) / 1000 AS lon,
               'City ' || CAST(n_nationkey AS STRING) AS city, 'Land ' || CAST(n_regionkey AS STRING) AS country,
               CAST((nn * 7 + n_nationkey * 13 + copy) % 11 AS DOUBLE) AS importance
        FROM (SELECT name, min(no) AS nn, 0 AS copy FROM [streets] GROUP BY name
              UNION ALL SELECT name, min(no), 1 FROM [streets] GROUP BY name) AS n
        JOIN {nation} ON n_nationkey % 4 = nn % 4""",
    # Lines of 40 points, drawn from events by number.
    "lines": f"""
        SELECT {div('event_id', 40)} AS route_id, event_id % 40 AS seq,
               51 + CAST({div('event_id', 40)} % 50 AS DOUBLE) / 100 + CAST((event_id % 40) * 30 + (event_id * 7) % 25 AS DOUBLE) / 100000
                 AS lat,
               CAST({div('event_id', 40)} % 30 AS DOUBLE) / 100 + CAST((event_id * 13) % 60 + (event_id % 40) * 20 AS DOUBLE) / 100000 AS lon
        FROM {{events}}""",
    "lines_b": """
        SELECT route_id, seq, lat + CAST((route_id + seq * 3) % 9 AS DOUBLE) / 20000 AS lat,
               lon + CAST((route_id * 5 + seq) % 7 AS DOUBLE) / 20000 AS lon FROM [lines] WHERE seq < 36""",
    "shapes_xy": """
        SELECT route_id AS shape_id, seq, CAST((seq * 7 + route_id * 3) % 23 AS DOUBLE) AS x,
               CAST((seq * 11 + route_id) % 19 AS DOUBLE) AS y FROM [lines] WHERE seq < 9 + route_id % 20""",
    # Street grid, 50 nodes wide and as long as the customer table allows.
    "nodes": f"""
        SELECT c_custkey AS id, 51 + CAST({div('c_custkey', 50)} AS DOUBLE) / 1000 AS lat,
               CAST(c_custkey % 50 AS DOUBLE) * 16 / 10000 AS lon FROM {{customer}}""",
    "edges": """
        SELECT u, v, CAST(50 + (u * 31 + v * 17) % 70 AS DOUBLE) AS length FROM (
          SELECT a.id AS u, b.id AS v FROM [nodes] AS a JOIN [nodes] AS b
            ON b.id = a.id + 1 AND a.id % 50 <> 49 AND a.id % 13 <> 5
          UNION ALL SELECT b.id, a.id FROM [nodes] AS a JOIN [nodes] AS b ON b.id = a.id + 1 AND a.id % 50 <> 49
          UNION ALL SELECT a.id, b.id FROM [nodes] AS a JOIN [nodes] AS b ON b.id = a.id + 50
          UNION ALL SELECT b.id, a.id FROM [nodes] AS a JOIN [nodes] AS b ON b.id = a.id + 50) AS e""",
    # 40 x 40 pixel images, one pixel per order.
    "pixels": f"""
        SELECT image_id, x, y, b0 + (x + y) % 20 AS b, g0 + (x * 3) % 25 AS g, r0 + (y * 5) % 30 AS r
        FROM (SELECT image_id, x, y, CASE WHEN
                (abs(x - 5 - image_id % 7) <= 1 AND y >= 4 AND y <= 34) OR (abs(y - 33) <= 1 AND x >= 5 AND x <= 30 + image_id % 5)
                OR (x >= 34 AND y <= 2 + image_id % 3) OR (x = 20 AND y % 6 = image_id % 6) THEN 1 ELSE 0 END AS ink
              FROM (SELECT {div('o_orderkey', 1600)} AS image_id, CAST(o_orderkey % 40 AS INT) AS x,
                           CAST({div('o_orderkey', 40)} % 40 AS INT) AS y FROM {{orders}}) AS p) AS s
        JOIN (SELECT 0 AS ink, 200 AS b0, 205 AS g0, 210 AS r0 UNION ALL SELECT 1, 20, 30, 180) AS c ON c.ink = s.ink""",
    # Control points with a known map per image; every fourth image has one anchor far off.
    "gcps": """
        SELECT image_id, x_px, y_px,
               51.5 + lat_of + CASE WHEN n = 6 AND image_id % 4 = 0 THEN 0.05 ELSE 0 END AS lat,
               image_id % 40 + lon_of AS lon, label, weight
        FROM (SELECT image_id, fragment_no AS n, CAST(100 + (fragment_no * 137) % 400 AS DOUBLE) AS x_px,
                     CAST(50 + (fragment_no * fragment_no * 61) % 350 AS DOUBLE) AS y_px,
                     -CAST(50 + (fragment_no * fragment_no * 61) % 350 AS DOUBLE) / 100000 AS lat_of,
                     CAST(100 + (fragment_no * 137) % 400 AS DOUBLE) / 60000 AS lon_of,
                     'L' || CAST(fragment_no AS STRING) AS label, conf AS weight
              FROM [streets] WHERE fragment_no < 7 AND fragment_no < 2 + image_id % 6 + 1) AS g""",
    "requests": """
        SELECT s_suppkey AS request_id, CASE s_suppkey % 5 WHEN 4 THEN 'yak' WHEN 3 THEN 'star' ELSE 'box' END AS shape,
               50 + CAST((s_suppkey * 7919) % 4000 AS DOUBLE) / 1000 + CASE WHEN s_suppkey % 11 = 0 THEN 60 ELSE 0 END AS lat,
               -4 + CAST((s_suppkey * 104729) % 8000 AS DOUBLE) / 1000 AS lon,
               CAST(s_suppkey % 55 AS DOUBLE) AS distance_km, CAST(8 + s_suppkey % 5 * 4 AS INT) AS waypoints,
               CAST(1 + s_suppkey % 4 AS INT) AS iterations,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 20 AS DOUBLE) END AS search_radius_km,
               CAST(1 + s_suppkey % 4 AS INT) AS candidates, CAST(1 + s_suppkey % 3 AS INT) AS scales
        FROM {supplier}""",
    # Outlines: a rectangle as large as the part sizes span, and a star with one corner per part size.
    "extent": "SELECT CAST(max(p_size) AS DOUBLE) AS w, CAST(min(p_size) + 20 AS DOUBLE) AS h FROM {part}",
    "outlines": """
        SELECT 'box' AS shape, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM [extent]
        UNION ALL SELECT 'box', 1, w, CAST(0 AS DOUBLE) FROM [extent]
        UNION ALL SELECT 'box', 2, w, h FROM [extent]
        UNION ALL SELECT 'box', 3, CAST(0 AS DOUBLE), h FROM [extent]
        UNION ALL SELECT 'box', 4, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM [extent]
        UNION ALL SELECT 'star', row_number() OVER (ORDER BY p_size) - 1, CAST((p_size * 7) % 50 AS DOUBLE), CAST((p_size * 4) % 50 AS DOUBLE)
        FROM (SELECT p_size FROM {part} GROUP BY p_size) AS s""",
    "outcomes": f"""
        SELECT event_id AS id, CAST(event_id % 101 AS DOUBLE) / 101 AS confidence,
               CASE WHEN event_type = 'click' THEN NULL WHEN event_id % 6 = 0 THEN 'fetch: ' || event_type
                    WHEN event_id % 6 = 1 THEN 'ocr: none' WHEN event_id % 6 = 2 THEN 'georef: few'
                    ELSE 'mapmatch: ' || event_type END AS failure,
               CASE WHEN event_type = 'click' THEN 'gpx/' || CAST(event_id AS STRING) END AS gpx_path,
               '{STAMP}' AS attempted_at
        FROM {{events}}""",
    "label_outcomes": """
        SELECT event_id AS id, event_id % 4 AS candidates,
               CASE WHEN event_id % 4 > 1 AND event_type = 'click' THEN 50 + CAST(event_id % 77 AS DOUBLE) / 10 END AS cluster_lat,
               CASE WHEN event_type = 'error' THEN 'fetch: lost' END AS error FROM {events}""",
}


def _with(name_or_body: str, tables: dict[str, str]) -> str:
    """Query text with every fixture it names, in order of need, as common table expressions."""
    parts: dict[str, str] = {}

    def expand(text: str) -> str:
        for name in re.findall(r"\[([a-z_]+)\]", text):
            if name in FIXTURES and name not in parts:
                parts[name] = expand(FIXTURES[name])
        text = re.sub(r"\[([a-z_]+)\]", lambda m: f"fx_{m[1]}" if m[1] in FIXTURES else m[0], text)
        return re.sub(r"\{([a-z]+)\}", lambda m: tables.get(m[1], m[0]), text)

    body = expand(name_or_body)
    ctes = ", ".join(f"fx_{name} AS ({sql})" for name, sql in parts.items())
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body.lstrip()[14:]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {ctes}, {body.lstrip()[4:]}"
    return f"WITH {ctes} {body}"


def duck(text: str) -> str:
    """DuckDB query for a body that may name tables and fixtures."""
    return _with(text, {t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark DataFrame of a fixture name or of a body that names fixtures."""
    body = f"SELECT * FROM [{text}]" if text in FIXTURES else text
    return spark.sql(_with(body, {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))
