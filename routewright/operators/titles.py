"""Titles against gazetteer rows: the longest name that stands in a title as whole words, found by equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routewright import dims
from routewright.functions import text

_WORD = r"A-Z0-9\p{L}\p{M}"
_PIECE = rf"[A-Z]+|[0-9]+|[\p{{L}}\p{{M}}&&[^A-Z]]+|[^{_WORD}]+"
_LAST = 1 << 62


def pieces(upper: Column) -> Column:
    """The text cut between words, numbers and what lies between them; joined they are the text again."""
    return F.regexp_extract_all(upper, F.lit(_PIECE), F.lit(0))


def built_in_cities(spark: SparkSession) -> DataFrame:
    rows = [(name, country, n) for n, (name, country) in enumerate(dims.CITIES)]
    return spark.createDataFrame(rows, "name string, country string, position long")


def built_in_non_places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(word,) for word in dims.NON_PLACES], "word string")


def city_names(cities: DataFrame) -> DataFrame:
    """``name, head, n_pieces, position, country`` of distinct names, spelled as titles are after cleaning.

    Of rows with the same name, the one with the smallest ``position`` counts, then the smallest country. Null names and
    names of which cleaning leaves nothing are left out.
    """
    position = F.col("position").cast("long") if "position" in cities.columns else F.lit(None).cast("long")
    name = F.regexp_replace(F.upper(text.clean_title(F.col("name"))), rf"^[^{_WORD}]+|[^{_WORD}]+$", "")
    rows = cities.select(name.alias("name"), F.coalesce(position, F.lit(_LAST)).alias("position"), "country").where("name <> ''")
    best = rows.groupBy("name").agg(F.min(F.struct("position", "country")).alias("best")).withColumn("cut", pieces(F.col("name")))
    return best.select("name", F.element_at("cut", 1).alias("head"), F.size("cut").alias("n_pieces"), "best.*")


def longest_city(titles: DataFrame, cities: DataFrame) -> DataFrame:
    """``upper, name, country, first, n_pieces`` for each distinct ``upper`` of ``titles`` that holds a name.

    The longest name wins, then the smallest position, then the name; ``first`` is the piece at which it first begins.
    A word of a title is joined with the first words of names for the lengths worth trying, and each such span with
    the names themselves. So the work follows the words of titles, not the number of names, and a span is never longer
    than the longest name.
    """
    names = city_names(cities)
    most = names.agg(F.max("n_pieces")).first()[0] or 1
    heads = names.groupBy("head").agg(F.collect_set("n_pieces").alias("lengths"))
    cut = titles.where("upper <> ''").select("upper", pieces(F.col("upper")).alias("cut"))
    spans = cut.select("upper", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("cut")),
        lambda n: F.struct(n.alias("first"), F.element_at("cut", n).alias("head"), F.slice("cut", n, most).alias("span")),
    )).alias("at")).select("upper", "at.*")
    tried = spans.where(F.col("head").rlike(f"^[{_WORD}]")).join(heads, "head").select(
        "upper", "first", "span", F.explode("lengths").alias("tried"))
    spelled = tried.where(F.size("span") >= F.col("tried")).select(
        "upper", "first", F.array_join(F.slice("span", F.lit(1), F.col("tried")), "").alias("name"))
    found = spelled.join(names.drop("head"), "name")
    order = F.struct((-F.length("name")).alias("size"), "position", "name", "first", "n_pieces", "country")
    return found.groupBy("upper").agg(F.min(order).alias("best")).select(
        "upper", *(f"best.{c}" for c in ("name", "country", "first", "n_pieces")))


def parse_titles_by_rows(tiles: DataFrame, cities: DataFrame | None = None, non_places: DataFrame | None = None) -> DataFrame:
    """Add shape, city, country and confidence read from ``title``, by rows of cities (name, country) and words (word).

    ``cities`` may have a ``position`` that settles ties of length. Equal to the built-in parse on the built-in rows. Every
    distinct title is worked on once. A null title counts as empty; empty tables of cities or words match nothing.
    """
    spark = tiles.sparkSession
    cities = built_in_cities(spark) if cities is None else cities
    non_places = built_in_non_places(spark) if non_places is None else non_places
    keyed = tiles.withColumn("_title_key", F.upper(text.clean_title(F.col("title"))))
    titles = keyed.select(F.col("_title_key").alias("upper")).distinct()

    stop = non_places.select(F.upper(F.trim("word")).alias("token")).distinct()
    barred = titles.select("upper", F.explode(F.array_distinct(text.last_tokens(F.col("upper")))).alias("token")).join(
        stop, "token", "left_semi").select("upper", F.lit(True).alias("barred")).distinct()

    cut, first, size = pieces(F.col("upper")), F.col("first"), F.col("n_pieces")
    rest = F.concat(
        F.array_join(F.slice(cut, F.lit(1), first - 1), ""), F.lit(" "), F.array_join(F.slice(cut, first + size, F.size(cut)), ""))
    parsed = titles.join(longest_city(titles, cities), "upper", "left").join(barred, "upper", "left").select(
        F.col("upper").alias("_title_key"),
        text.title_struct(F.col("upper"), F.col("name"), F.col("country"), rest, F.coalesce("barred", F.lit(False))).alias("_t"))
    return keyed.join(parsed, "_title_key", "left").select(*(keyed[c] for c in tiles.columns), "_t.*")
