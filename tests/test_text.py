import pytest
from pyspark.sql import functions as F

from routewright import dims
from routewright.functions import streets, text
from routewright.operators import catalogue as cat
from routewright.operators import titles


def test_dimension_sizes():
    assert len(dims.CITIES) == 72 and len(dims.SYNONYMS) == 130 and len(dims.CATEGORIES) == 23
    assert set(dims.SYNONYMS.values()) <= set(dims.CATEGORIES)


TITLES = {
    "LEEDS GOAT": ("GOAT", "Leeds", "United Kingdom", 1.0),
    "Milton Keynes Newt 2021": ("NEWT", "Milton Keynes", "United Kingdom", 1.0),
    "OWL — OSLO": ("OWL", "Oslo", "Norway", 1.0),
    "NEW YORK": ("NEW YORK", "New York", "United States", 1.0),
    "YORKSHIRE HARE": ("YORKSHIRE HARE", None, None, 0.0),
    "Hare, Ulan Bator": ("HARE", "Ulan Bator", None, 0.5),
    "A – B | Lake": ("A B", "Lake", None, 0.5),
    "Hare, one two three four": ("HARE, ONE TWO THREE FOUR", None, None, 0.0),
    "Hare | morning loop": ("HARE | MORNING LOOP", None, None, 0.0),
    "ODD-EYED NEWT 🦎": ("ODD-EYED NEWT", None, None, 0.0),
    "": ("", None, None, 0.0),
}


def test_parse_title(column):
    got = column(list(TITLES), text.parse_title)
    assert {t: tuple(g) for t, g in zip(TITLES, got)} == TITLES


def test_a_title_is_parsed_once(spark):
    """However many steps name what was read from a title, the plan holds its parse once."""
    tiles = spark.range(4).selectExpr("id AS n", "concat('Hare ', id, ', Ulan Bator') AS title")
    hits = spark.createDataFrame([("oslo, norway", 1.0, 2.0, "Norway")], "key string, lat double, lon double, country string")
    parsed = cat.parse_titles(tiles)
    asked = cat.unresolved_places(parsed, hits, spark.createDataFrame([("x",)], "key string"))
    for df in (parsed, cat.geocode_titles(parsed, hits), asked):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
    assert [r["key"] for r in asked.collect()] == ["ulan bator"]


def test_longest_city_wins_over_earlier_one(column):
    got = column(["BATH NEWT NEW YORK"], text.parse_title)[0]
    assert (got["city"], got["shape"]) == ("New York", "BATH NEWT")


@pytest.mark.parametrize("raw", ["o'connell 3rd", "jean-luc", "éa ée", "A1b2 C", "ÉCOLE d'été"])
def test_title_case_follows_any_non_letter(column, raw):
    assert column([raw], text.title_case) == [raw.title()]


def test_geocode_key(spark):
    df = spark.createDataFrame(
        [("St  Albans", "United Kingdom"), ("Oslo", None), (None, "X"), ("", "X")], "a string, b string"
    )
    got = [r[0] for r in df.select(text.geocode_key(F.col("a"), F.col("b"))).collect()]
    assert got == ["st albans, united kingdom", "oslo", None, None]


STREETS = {
    "Acorn Rd": "Acorn Road", "St Giles Way": "St Giles Way", "Elm ! Ave": "Elm Avenue", "'Mill Ln.'": "Mill Lane",
    "rue du bac": "Rue Du Bac", "Via Garibaldi": "Via Garibaldi", "Lindenstraße": "Lindenstrasse",
    "Parkstrasse": "Parkstrasse", "O'Neill St": "O'Neill Street", "High 12 St": "High Street",
    "Road": None, "strasse": None, "hello": None, "A B C D E F Rd": None, "": None, "10 km": None,
}


def test_parse_street(column):
    got = column(list(STREETS), streets.parse_street)
    assert {t: (g and g["normalized"]) for t, g in zip(STREETS, got)} == STREETS


def test_long_text_is_parsed_but_does_not_look_like_a_street(column):
    long = "A" * 58 + " Rd"
    assert column([long], streets.looks_like_street) == [False]
    assert column([long], streets.parse_street)[0] is not None


def test_variants_order_and_limit(column):
    assert column(["Tomlin Rd"], lambda c: streets.name_variants(c, 3)) == [
        ["Tomlin Rd", "Tcmlin Rd", "Torniin Rd".replace("iin", "lin"), "Tomiin Rd"]
    ]
    assert "Partridge Way" in column(["Partrdge Way"], lambda c: streets.name_variants(c, 6))[0]
    assert column(["Titit"], lambda c: streets.name_variants(c, 6)) == [["Titit", "Ttit"]]


def test_label_helpers(column):
    assert column([" (Mill  42 Rd) "], text.clean_label) == ["Mill Rd"]
    assert column(["ab", "a1", "a b 12345", "éé", ""], text.is_alpha_label) == [True, False, False, True, False]
    assert column(["Bréf Çà ß"], text.ascii_fold) == ["Bref Ca ß"]
    assert column(["ocr: x", None, "", "odd"], text.failure_mode) == ["ocr", "unknown", "unknown", "odd"]


def by_rows(spark, given, cities=None, non_places=None):
    tiles = spark.createDataFrame([(n, t) for n, t in enumerate(given)], "n int, title string")
    cities = None if cities is None else spark.createDataFrame(cities, "name string, country string, position long")
    words = None if non_places is None else spark.createDataFrame(non_places, "word string")
    got = titles.parse_titles_by_rows(tiles, cities, words)
    assert got.columns == ["n", "title", "shape", "city", "country", "confidence"]
    return [tuple(r)[2:] for r in got.orderBy("n").collect()]


def test_titles_by_built_in_rows_equal_the_expression(spark, column):
    given = [
        *TITLES, *TITLES, "BATH NEWT NEW YORK", "bath2 york3 hare", "LeedsÉBATH", "NEW  YORK/HONG KONG — fox", "St Albans (2019)",
        "owl|York|", "PERTH PERTH owl", "New, York", "ROME OSLO BATH YORK", None, "   ", "x" * 5000 + " Oslo " + "HARE " * 5000,
    ]
    assert by_rows(spark, given) == [tuple(g) for g in column(given, text.parse_title)]


def test_rows_decide_what_is_a_city(spark):
    cities = [
        ("Ulan Bator", "Mongolia", None), ("Xi'an", "China", None), ("évry", "France", None), ("Москва", "Russia", None),
        ("Bator", "Nowhere", 1), ("San José de Tacámbaro", "Mexico", 2), ("San José", "Costa Rica", 3), ("Ab", "Second", 5),
        ("ab", "First", 4), ("Cd", "Tie", 1), (None, "Null", 0), ("!?", "Empty", 0), ("Route 66", "Road", None),
    ]
    got = by_rows(spark, [
        "Hare ULAN BATOR", "xi'an owl", "goat Évry", "москва лиса", "fox san josé", "fox San José de Tacámbaro", "CD AB", "LEEDS",
        "run route 66", "route 666", "лисамосква",
    ], cities)
    assert got == [
        ("HARE", "Ulan Bator", "Mongolia", 1.0), ("OWL", "Xi An", "China", 1.0), ("GOAT", "Évry", "France", 1.0),
        ("ЛИСА", "Москва", "Russia", 1.0), ("FOX", "San José", "Costa Rica", 1.0),
        ("FOX", "San José De Tacámbaro", "Mexico", 1.0), ("AB", "Cd", "Tie", 1.0), ("LEEDS", None, None, 0.0),
        ("RUN", "Route 66", "Road", 1.0), ("ROUTE 666", None, None, 0.0), ("ЛИСАМОСКВА", None, None, 0.0),
    ]


def test_rows_decide_what_is_no_place(spark):
    assert by_rows(spark, ["Hare, lake", "Hare, morning"], [], [("Lake",), (None,)]) == [
        ("HARE, LAKE", None, None, 0.0), ("HARE", "Morning", None, 0.5)]
    assert by_rows(spark, ["Hare, morning", "OSLO"], [], []) == [("HARE", "Morning", None, 0.5), ("OSLO", None, None, 0.0)]
    assert by_rows(spark, [], None, []) == []
