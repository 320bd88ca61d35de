"""Titles, labels, street names, keys and score formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from routewright import dims
from routewright.functions import geo, scores, streets, text
from routewright.operators import catalogue as cat
from routewright.operators import labels, raster, titles
from routewright.sinks import writers
from workload.fixtures import derive, table
from workload.registry import query, r6, s6, s_hav


# --- SQL building blocks ----------------------------------------------------------------------------------------

def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def s_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_clean_title(x: str) -> str:
    marks = "[\\x{10000}-\\x{10FFFF}☀-➿!?()\\[\\]{}\"''*#~]+".replace("{}", "\\{\\}")
    return s_collapse(f"regexp_replace(regexp_replace(coalesce({x}, ''), '{marks}', ' ', 'g'), '\\b(19|20)\\d{{2}}\\b', ' ', 'g')")


def s_title_case(x: str) -> str:
    letter = "a-zß-öø-ÿ"
    split = f"string_split(regexp_replace(lower({x}), '([^{letter}])([{letter}])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"array_to_string(list_transform({split}, lambda p: (CASE WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END) || p[2:]), '')"


def s_clean_label(x: str) -> str:
    quotes = text.LABEL_QUOTES.replace("'", "''")
    inner = s_collapse(f"trim({s_collapse(x)}, '{quotes}')")
    noise = "^[!|@#%^&*+=~?,;:_/\\\\\\d]+$"
    return f"array_to_string(list_filter(string_split({inner}, ' '), lambda w: NOT regexp_matches(w, '{noise}') AND w <> ''), ' ')"


def s_map(pairs: dict, key: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items())
    return f"(CASE {key} {whens} END)"


_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ''’\\.\\-]*"


def s_parse_street(source: str, raw: str = "raw") -> str:
    """SELECT *, normalized, suffix over rows of ``source`` with a cleaned column ``raw``."""
    trailing = f"^((?:{_WORD}\\s+){{0,4}}{_WORD})\\s+([A-Za-z]{{1,12}})\\.?$"
    leading = f"^([A-Za-z]{{2,8}})\\s+({_WORD}(?:\\s+{_WORD}){{0,4}}\\.?)$"
    glued = "(?i)^([A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ''\\-]{2,})(strasse|straße)$"
    t = s_map(dims.TRAILING_STREET_WORDS, f"lower(regexp_extract({raw}, '{trailing}', 2))")
    ld = s_map({w: w for w in dims.LEADING_STREET_WORDS}, f"lower(regexp_extract({raw}, '{leading}', 1))")
    g = s_map(dims.GLUED_STREET_ENDINGS, f"lower(regexp_extract({raw}, '{glued}', 2))")
    title_t = s_title_case(f"regexp_extract({raw}, '{trailing}', 1)")
    title_l = s_title_case(f"rtrim(regexp_extract({raw}, '{leading}', 2), '.')")
    title_g = s_title_case(f"regexp_extract({raw}, '{glued}', 1)")
    return (
        f"SELECT *, coalesce(t, ld, g) AS suffix, CASE WHEN t IS NOT NULL THEN {title_t} || ' ' || {s_title_case('t')} "
        f"WHEN ld IS NOT NULL THEN {s_title_case('ld')} || ' ' || {title_l} WHEN g IS NOT NULL THEN {title_g} || g END "
        f"AS normalized FROM (SELECT *, {t} AS t, {ld} AS ld, {g} AS g FROM ({source}) AS s0) AS s1"
    )


def s_variants(name: str, limit: int) -> str:
    """List of the name and its first ``limit`` misreadings (no overlapping dropped-i sites in the data)."""
    c = f"[{streets.CONSONANTS}{streets.CONSONANTS.upper()}]"
    parts = []
    for found, new in streets.MISREADINGS:
        k = len(found)
        parts.append(
            f"list_transform(list_filter(range(1, length({name}) + 1), lambda p: {name}[p:p + {k - 1}] = '{found}'), "
            f"lambda p: {name}[1:p - 1] || '{new}' || {name}[p + {k}:])"
        )
    parts.append(
        f"list_transform(list_filter(range(2, length({name})), lambda p: regexp_full_match({name}[p - 1:p + 1], '{c}[iI]{c}')), "
        f"lambda p: {name}[1:p - 1] || {name}[p + 1:])"
    )
    parts.append(
        f"list_transform(list_filter(range(1, length({name})), lambda p: regexp_full_match({name}[p:p + 1], '{c}{c}')), "
        f"lambda p: {name}[1:p - 1] || 'i' || {name}[p:])"
    )
    every = f"flatten([[{name}], {', '.join(parts)}])"
    return (f"list_filter({every}, lambda v, i: list_position({every}, v) = i)[1:{limit + 1}]")


# --- titles and keys --------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, md5({s_clean_title('text')}) AS cleaned FROM {{documents}}")
def clean_title(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_title(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, md5({s_title_case('text')}) AS cased FROM {{documents}}")
def title_case(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.title_case(F.col("text"))).alias("cased"))


def _ranked_cities() -> str:
    ranked = sorted(enumerate(dims.CITIES), key=lambda item: (-len(item[1][0]), item[0]))
    return ", ".join(f"({i}, {lit(c)}, {lit(n)})" for i, (_, (c, n)) in enumerate(ranked))


def s_parse_title(source: str, key: str, cities: str | None = None) -> str:
    """SELECT key, shape, city, country, confidence over (key, title) rows; ``cities`` selects (i, city, country), best first."""
    cities = cities or f"SELECT * FROM (VALUES {_ranked_cities()}) AS r(i, city, country)"
    bounded = "'(^|[^A-Z])' || c.city || '([^A-Z]|$)'"
    sep = "\\s*[–—―,|/]\\s*"
    stop = ", ".join(lit(w.upper()) for w in dims.NON_PLACES)
    rest = s_collapse(f"regexp_replace(regexp_replace(u, '(^|[^A-Z])' || city || '([^A-Z]|$)', '\\1 \\2'), '{sep}', ' ', 'g')")
    return f"""
        SELECT {key},
          CASE WHEN city IS NOT NULL THEN CASE WHEN {rest} = '' THEN u ELSE {rest} END
               WHEN guess THEN trim(array_to_string(parts[1:len(parts) - 1], ' ')) ELSE u END AS shape,
          CASE WHEN city IS NOT NULL THEN {s_title_case('city')} WHEN guess THEN {s_title_case('last')} END AS city,
          CASE WHEN city IS NOT NULL THEN country END AS country,
          CASE WHEN city IS NOT NULL THEN 1.0 WHEN guess THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence
        FROM (SELECT *, len(parts) >= 2 AND last <> '' AND len(string_split(last, ' ')) <= 3
                AND NOT list_has_any(string_split(last, ' '), [{stop}]) AS guess
              FROM (SELECT t.{key}, t.u, b.city, b.country, regexp_split_to_array(t.u, '{sep}') AS parts,
                      trim(regexp_split_to_array(t.u, '{sep}')[-1]) AS last
                    FROM (SELECT {key}, upper({s_clean_title('title')}) AS u FROM ({source}) AS q) AS t
                    LEFT JOIN (SELECT {key}, arg_min(city, i) AS city, arg_min(country, i) AS country
                               FROM (SELECT {key}, c.* FROM (SELECT {key}, upper({s_clean_title('title')}) AS u FROM ({source}) AS q2) AS q
                                     JOIN ({cities}) AS c(i, city, country) ON regexp_matches(q.u, {bounded})) AS m
                               GROUP BY {key}) AS b ON b.{key} = t.{key}) AS p) AS z"""


@query(s_parse_title("SELECT position, title FROM [titles]", "position"))
def parse_title(spark, d):
    parsed = cat.parse_titles(derive(spark, d, "titles"))
    return parsed.select("position", "shape", "city", "country", "confidence")


_CITY_ROWS = f"""
    SELECT row_number() OVER (ORDER BY length(city) DESC, i, city), city, country
    FROM (SELECT i, city, country FROM (VALUES {_ranked_cities()}) AS b(i, city, country)
          UNION ALL SELECT 1000 + n_nationkey, n_name, r_name FROM {{nation}} JOIN {{region}} ON r_regionkey = n_regionkey) AS a"""
_NATION_TITLES = """SELECT position, CASE WHEN position % 2 = 0 THEN title || ' ' || n_name ELSE title END AS title
                    FROM [titles] JOIN {nation} ON n_nationkey = position % 25"""


@query(s_parse_title(_NATION_TITLES, "position", _CITY_ROWS))
def parse_titles_by_rows(spark, d):
    nations = table(spark, d, "nation")
    added = nations.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("name"), F.col("r_name").alias("country"), (F.col("n_nationkey") + 1000).cast("long").alias("position"))
    cities = titles.built_in_cities(spark).unionByName(added)
    named = derive(spark, d, "titles").join(nations, F.col("n_nationkey") == F.col("position") % 25).select(
        "position", F.when(F.col("position") % 2 == 0, F.concat("title", F.lit(" "), "n_name")).otherwise(F.col("title")).alias("title"))
    return cat.parse_titles(named, cities).select("position", "shape", "city", "country", "confidence")


@query(f"""SELECT position, lower({s_collapse("city || CASE WHEN country IS NULL THEN '' ELSE ', ' || country END")}) AS key
           FROM ({s_parse_title("SELECT position, title FROM [titles]", "position")}) AS p""")
def geocode_key(spark, d):
    parsed = cat.parse_titles(derive(spark, d, "titles"))
    return parsed.select("position", text.geocode_key(F.col("city"), F.col("country")).alias("key"))


_SYNONYMS = {**dims.SYNONYMS, **{s: s for s in dims.CATEGORIES}}


@query(f"""SELECT query_id, coalesce(t.slug, {s_map(_SYNONYMS, 'lower(trim(s.term))')}) AS category
           FROM [spots] AS s LEFT JOIN (SELECT 'zzz' AS term, 'special' AS slug UNION ALL SELECT 'car', 'shapes') AS t
           ON t.term = lower(s.term)""")
def resolve_category(spark, d):
    synonyms = spark.createDataFrame([("zzz", "special"), ("car", "shapes")], "term string, slug string")
    return cat.resolve_category(derive(spark, d, "spots"), "term", synonyms, "category").select("query_id", "category")


@query("SELECT id, CASE WHEN failure IS NULL THEN 'unknown' ELSE split_part(failure, ':', 1) END AS mode FROM [outcomes]")
def failure_mode(spark, d):
    return derive(spark, d, "outcomes").select("id", text.failure_mode(F.col("failure")).alias("mode"))


# --- labels and streets -----------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}"


def _doc_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"SELECT doc_id, md5({s_clean_label('line')}) AS cleaned, count(*) AS n FROM ({_LINES}) AS l GROUP BY ALL")
def clean_label(spark, d):
    cleaned = _doc_lines(spark, d).select("doc_id", F.md5(text.clean_label(F.col("line"))).alias("cleaned"))
    return cleaned.groupBy("doc_id", "cleaned").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, md5(translate(text, '{text._MARKED}', '{text._PLAIN}')) AS folded FROM {{documents}}")
def ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.ascii_fold(F.col("text"))).alias("folded"))


@query(f"""SELECT doc_id, count(*) AS lines, count(*) FILTER (letters >= 2 AND letters * 2 >= visible) AS labels
           FROM (SELECT doc_id, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS letters,
                   length(regexp_replace(line, '\\s+', '', 'g')) AS visible FROM ({_LINES}) AS l) AS c GROUP BY doc_id""")
def is_alpha_label(spark, d):
    return _doc_lines(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(text.is_alpha_label(F.col("line"))).alias("labels")
    )


_STREET_TEXTS = """
    SELECT no, CASE no % 8 WHEN 0 THEN text WHEN 1 THEN '"' || upper(text) || '"' WHEN 2 THEN 'rue ' || name
      WHEN 3 THEN split_part(name, ' ', 2) || 'strasse' WHEN 4 THEN '( ' || replace(text, ' ', ' 12 ! ') || ' )'
      WHEN 5 THEN split_part(name, ' ', 1) WHEN 6 THEN split_part(name, ' ', 1) || 'er o''' || text ELSE text || ' 7' END AS text
    FROM [streets]"""


@query(f"SELECT no, raw, normalized, suffix FROM ({s_parse_street(f'SELECT no, {s_clean_label(chr(116) + chr(101) + chr(120) + chr(116))} AS raw FROM ({_STREET_TEXTS}) AS t')}) AS p WHERE suffix IS NOT NULL")
def parse_street(spark, d):
    rows = derive(spark, d, _STREET_TEXTS).withColumn("s", streets.parse_street(F.col("text")))
    return rows.filter("s IS NOT NULL").select("no", "s.raw", "s.normalized", "s.suffix")


@query(f"""SELECT doc_id, count(*) AS lines, count(*) FILTER (suffix IS NOT NULL AND length(raw) <= 60) AS streets
           FROM ({s_parse_street(f"SELECT doc_id, {s_clean_label('line')} AS raw FROM ({_LINES}) AS l")}) AS p GROUP BY doc_id""")
def looks_like_street(spark, d):
    return _doc_lines(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(streets.looks_like_street(F.col("line"))).alias("streets")
    )


@query(f"SELECT no, array_to_string({s_variants('name', 6)}, '|') AS variants FROM [streets]")
def name_variants(spark, d):
    return derive(spark, d, "streets").select(
        "no", F.array_join(streets.name_variants(F.col("name"), 6), "|").alias("variants")
    )


@query(f"""SELECT no, {s6('(x0 + x1 + x2 + x3) / 4.0', 'x_center')}, {s6('(y0 + y1 + y2 + y3) / 4.0', 'y_center')},
             least(x0, x1, x2, x3) AS x_min, greatest(x0, x1, x2, x3) AS x_max,
             greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) AS height
           FROM (SELECT no, x_min AS x0, y_min AS y0, x_min + 80 AS x1, y_min + no % 3 AS y1, x_min + 82 AS x2,
                   y_min + 12 + no % 3 AS y2, x_min + no % 2 AS x3, y_min + 12 AS y3 FROM [streets]) AS b""")
def box_metrics(spark, d):
    corners = F.expr("""array(struct(x_min AS x, y_min AS y), struct(x_min + 80 AS x, y_min + no % 3 AS y),
                        struct(x_min + 82 AS x, y_min + 12 + no % 3 AS y), struct(x_min + no % 2 AS x, y_min + 12 AS y))""")
    rows = derive(spark, d, "streets").select("no", labels.box_metrics(corners).alias("m"))
    return rows.select("no", r6("m.x_center", "x_center"), r6("m.y_center", "y_center"), "m.x_min", "m.x_max", "m.height")


# --- distances, frames, scores ----------------------------------------------------------------------------------

_PAIRS = "SELECT route_id, seq, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM [lines] AS a JOIN [lines_b] AS b USING (route_id, seq)"


@query(f"""SELECT route_id, seq, {s6(s_hav('lat1', 'lon1', 'lat2', 'lon2', '6371.0088'), 'search_km')},
             {s6(s_hav('lat1', 'lon1', 'lat2', 'lon2', '6371.0', True), 'cluster_km')},
             round({s_hav('lat1', 'lon1', 'lat2', 'lon2', '6371000.0', True)}, 4) AS match_m,
             round({s_hav('lat1', 'lon1', 'lat2', 'lon2', '6371008.8')}, 4) AS outline_m FROM ({_PAIRS}) AS p""")
def haversine(spark, d):
    a = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    return derive(spark, d, _PAIRS).select(
        "route_id", "seq", r6(geo.haversine(*a, geo.SEARCH_RADIUS_KM), "search_km"),
        r6(geo.haversine(*a, geo.CLUSTER_RADIUS_KM, True), "cluster_km"),
        F.round(geo.haversine(*a, geo.MATCH_RADIUS_M, True), 4).alias("match_m"),
        F.round(geo.haversine(*a, geo.OUTLINE_RADIUS_M), 4).alias("outline_m"),
    )


@query(f"""SELECT query_id, {s6('lat - radius_km / 111.0', 'south')}, {s6('lat + radius_km / 111.0', 'north')},
             {s6('lon - radius_km / (111.0 * greatest(0.01, cos(radians(lat))))', 'west')},
             {s6('lon + radius_km / (111.0 * greatest(0.01, cos(radians(lat))))', 'east')} FROM [spots]""")
def radius_box(spark, d):
    rows = derive(spark, d, "spots").withColumn("b", geo.radius_box(F.col("lat"), F.col("lon"), F.col("radius_km")))
    return rows.select("query_id", *[r6(f"b.{c}", c) for c in ("south", "north", "west", "east")])


_ORIGIN = "SELECT route_id, (min(lat) + max(lat)) / 2 AS lat0, (min(lon) + max(lon)) / 2 AS lon0 FROM [lines] GROUP BY route_id"


@query(f"""SELECT route_id, seq, round(radians(lon - lon0) * 6371000.0 * cos(radians(lat0)), 4) + 0.0 AS x,
             round(radians(lat - lat0) * 6371000.0, 4) + 0.0 AS y, {s6('lat', 'lat')}, {s6('lon', 'lon')}
           FROM [lines] JOIN ({_ORIGIN}) AS o USING (route_id)""")
def local_frame(spark, d):
    rows = derive(spark, d, f"SELECT route_id, seq, lat, lon, lat0, lon0 FROM [lines] JOIN ({_ORIGIN}) AS o USING (route_id)")
    xy = rows.withColumn("p", geo.to_local_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")))
    back = xy.withColumn("g", geo.from_local_xy(F.col("p.x"), F.col("p.y"), F.col("lat0"), F.col("lon0")))
    return back.select(
        "route_id", "seq", (F.round("p.x", 4) + 0.0).alias("x"), (F.round("p.y", 4) + 0.0).alias("y"),
        r6("g.lat", "lat"), r6("g.lon", "lon"),
    )


_TERMS = """SELECT id, id % 8 AS n, CAST(id % 260 AS DOUBLE) AS rmse, confidence AS label_conf,
            CAST(id % 97 AS DOUBLE) / 97 AS fid FROM [outcomes]"""


def _unit(x: str) -> str:
    return f"greatest(0.05, least(1.0, {x}))"


@query(f"""SELECT id, {s6(f"exp((ln({_unit('(n - 3) / 3.0')}) + ln({_unit('1.0 - (rmse - 30.0) / 170.0')}) + ln({_unit('label_conf')}) + ln({_unit('fid')})) / 4)", 'confidence')}
           FROM ({_TERMS}) AS t""")
def reconstruction_confidence(spark, d):
    score = scores.reconstruction_confidence(F.col("n"), F.col("rmse"), F.col("label_conf"), F.col("fid"))
    return derive(spark, d, _TERMS).select("id", r6(score, "confidence"))


@query(f"""SELECT id, {s6('score', 'score')}, score >= 0.6 AS passes FROM (
             SELECT id, greatest(0.0, least(1.0, 0.6 * fid + 0.4 * greatest(0.0, 1.0 - rmse / 200.0))) AS score FROM ({_TERMS}) AS t) AS s""")
def fidelity_combine(spark, d):
    rows = derive(spark, d, _TERMS).withColumn("score", scores.fidelity_combine(F.col("fid"), F.col("rmse")))
    return rows.select("id", r6("score"), scores.passes(F.col("score")).alias("passes"))


@query(f"SELECT o_orderkey, {s6('(o_totalprice - 150000.0) / 150000.0 * 100.0', 'error_pct')} FROM {{orders}}")
def error_pct(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", r6(scores.error_pct(F.col("o_totalprice"), F.lit(150000.0)), "error_pct")
    )


# --- pixels -----------------------------------------------------------------------------------------------------

def s_hsv(source: str) -> str:
    return f"""
        SELECT image_id, x, y, v, CASE WHEN v = 0 THEN 0 ELSE floor(c * 255.0 / v + 0.5) END AS s,
          CASE WHEN c = 0 THEN 0 ELSE CAST(floor(((CASE WHEN v = r THEN (g - b) / c WHEN v = g THEN (b - r) / c + 2.0 ELSE (r - g) / c + 4.0 END
            * 60.0) + CASE WHEN v = r AND g < b THEN 360.0 ELSE 0.0 END) / 2.0 + 0.5) AS INT) % 180 END AS h
        FROM (SELECT image_id, x, y, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r,
                CAST(greatest(b, g, r) AS DOUBLE) AS v, CAST(greatest(b, g, r) - least(b, g, r) AS DOUBLE) AS c FROM ({source}) AS q) AS w"""


S_STROKE = (f"SELECT image_id, x, y FROM ({s_hsv('SELECT * FROM [pixels]')}) AS hsv WHERE s >= 90 AND v >= 60 AND "
            "(h BETWEEN 0 AND 25 OR h BETWEEN 140 AND 180)")


@query(S_STROKE)
def stroke_mask(spark, d):
    return raster.stroke_mask(derive(spark, d, "pixels"))


@query(f"""SELECT DISTINCT m.image_id, m.x + o.dx AS x, m.y + o.dy AS y
           FROM (SELECT image_id, x, y FROM ({s_hsv('SELECT * FROM [pixels]')}) AS hsv WHERE s >= 110 AND v >= 70) AS m
           CROSS JOIN (SELECT dx, dy FROM (SELECT unnest(range(-2, 3)) AS dx) AS a CROSS JOIN (SELECT unnest(range(-2, 3)) AS dy) AS b
                       WHERE abs(dy) < 2 OR dx = 0) AS o
           JOIN (SELECT image_id, max(x) AS mx, max(y) AS my FROM [pixels] GROUP BY image_id) AS z ON z.image_id = m.image_id
           WHERE m.x + o.dx BETWEEN 0 AND mx AND m.y + o.dy BETWEEN 0 AND my""")
def saturated_mask(spark, d):
    mask = raster.saturated_mask(derive(spark, d, "pixels"))
    return mask.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(f"""SELECT event_id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat), false) AS ok
           FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value * 2 END AS lat,
                   CASE WHEN event_id % 19 = 0 THEN NULL ELSE value * 4 - 100 END AS lon FROM {{events}}) AS e""")
def valid_coords(spark, d):
    rows = derive(spark, d, """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value * 2 END AS lat,
        CASE WHEN event_id % 19 = 0 THEN NULL ELSE value * 4 - 100 END AS lon FROM {events}""")
    return rows.select("event_id", writers.valid_coords(F.col("lat"), F.col("lon")).alias("ok"))
