"""Text expressions: cleaning, casing, keys and label tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routewright import dims

# Decoration dropped from titles, year form, and title separators.
DECORATION = r"""[\x{10000}-\x{10FFFF}☀-➿!?()\[\]{}"'*#~]+"""
YEAR = r"(?U)\b(19|20)\d{2}\b"
SEPARATOR = r"(?U)\s*[–—―,|/]\s*"

# Marks stripped around a label, and tokens made only of noise.
LABEL_QUOTES = "\"'`“”‘’()[]{}<>"
NOISE_TOKEN = r"(?<!\S)[!|@#%^&*+=~?,;:_/\\\p{Nd}]+(?!\S)"

_SPACES = r"(?U)\s+"
_MARK = "\u0001"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once for a row, however often ``use`` names it; a plain column is copied to each place."""
    return F.transform(F.array(value), use)[0]


def collapse(c: Column) -> Column:
    """Whitespace runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def clean_title(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), DECORATION, " ")
    return collapse(F.regexp_replace(text, YEAR, " "))


def title_case(c: Column) -> Column:
    """Upper-case a letter that follows any non-letter, lower-case the rest."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{Ll}\p{Lu}\p{Lt}])(?=[\p{Ll}\p{Lu}\p{Lt}])")


    def capital(piece: Column) -> Column:
        first = F.substring(piece, 1, 1)
        # The one letter here whose title form has two letters.
        return F.concat(F.when(first == "ß", "Ss").otherwise(F.upper(first)), piece.substr(F.lit(2), F.length(piece)))

    return F.array_join(F.transform(pieces, capital), "")


def geocode_key(city: Column, country: Column) -> Column:
    """Lookup key of a place; NULL when there is nothing to look up."""
    key = F.lower(collapse(F.concat_ws(", ", city, F.when(country != "", country))))
    return F.when((city != "") & (key != ""), key)


def clean_label(c: Column) -> Column:
    """Outer quotes and brackets off, one space between tokens, tokens of pure noise dropped."""
    stripped = F.btrim(collapse(c), F.lit(LABEL_QUOTES))
    return collapse(F.regexp_replace(collapse(stripped), NOISE_TOKEN, ""))


# Latin letters with marks and their plain form.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def ascii_fold(c: Column) -> Column:
    """Drop accents over the Latin range street names may use; letters without a plain form stay."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), _MARKED, _PLAIN)


def is_alpha_label(c: Column) -> Column:
    """At least two letters, and letters make up half of the visible characters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    visible = F.length(F.regexp_replace(c, _SPACES, ""))
    return F.coalesce((letters >= 2) & (letters * 2 >= visible), F.lit(False))


def failure_mode(c: Column) -> Column:
    """Reason class of a failure text."""
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(F.split_part(c, F.lit(":"), F.lit(1)))


def built_in_category(term: Column) -> Column:
    """Category of a term without a synonym table: slugs name themselves, then the built-in terms."""
    key = F.lower(F.trim(term))
    known = {**dims.SYNONYMS, **{slug: slug for slug in dims.CATEGORIES}}
    return literal_map(known)[key]


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def xml_escape(c: Column) -> Column:
    text = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def parse_title(title: Column) -> Column:
    """struct(shape, city, country, confidence) of a gallery title.

    All bounded city names are captured in one zero-width pass (longest alternative first at each position), and the
    one that ranks first by length and list order wins.
    """
    ranked = [city for _, city in sorted(enumerate(dims.CITIES), key=lambda item: (-len(item[1][0]), item[0]))]
    names = F.array(*[F.lit(name) for name, _ in ranked])
    countries = literal_map(dict(ranked))
    alternatives = "|".join(name for name, _ in ranked)
    stop = F.array(*[F.lit(word.upper()) for word in dims.NON_PLACES])

    def parse(upper: Column) -> Column:
        found = F.regexp_extract_all(upper, F.lit(rf"(?<![A-Z])(?=({alternatives})(?![A-Z]))"), F.lit(1))
        rank = F.array_min(F.transform(found, lambda name: F.array_position(names, name)))
        city = once(rank, lambda n: F.when(n.isNotNull(), F.element_at(names, n.cast("int"))))
        return once(city, lambda name: title_struct(
            upper, name, countries[name], without(upper, name), F.arrays_overlap(last_tokens(upper), stop)))

    def without(upper: Column, city: Column) -> Column:
        before_city = F.concat(F.lit(r"^(.*?)(?<![A-Z])"), city, F.lit("(?![A-Z])"))
        return F.regexp_replace(upper, before_city, F.lit("$1 "))

    return once(F.upper(clean_title(title)), parse)


def last_tokens(upper: Column) -> Column:
    """Words of the last part of a title in upper case."""
    return F.split(F.trim(F.element_at(F.split(upper, SEPARATOR, -1), -1)), " ")


def title_struct(upper: Column, city: Column, country: Column, rest: Column, no_place: Column) -> Column:
    """What :func:`parse_title` returns: ``rest`` is the title without its city, ``no_place`` bars a guess at the last part."""
    shape = once(collapse(F.regexp_replace(F.trim(rest), SEPARATOR, " ")), lambda left: F.when(left == "", upper).otherwise(left))
    known = F.struct(
        shape.alias("shape"), title_case(city).alias("city"), country.alias("country"), F.lit(1.0).alias("confidence"),
    )
    nothing = F.struct(
        upper.alias("shape"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("country"), F.lit(0.0).alias("confidence"),
    )

    def guess(parts: Column, last: Column) -> Column:
        guessable = (F.size(parts) >= 2) & (last != "") & (F.size(F.split(last, " ")) <= 3) & ~no_place
        return F.when(guessable, F.struct(
            F.trim(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " ")).alias("shape"),
            title_case(last).alias("city"), F.lit(None).cast("string").alias("country"), F.lit(0.5).alias("confidence"),
        )).otherwise(nothing)

    guessed = once(F.split(upper, SEPARATOR, -1), lambda parts: once(F.trim(F.element_at(parts, -1)), lambda last: guess(parts, last)))
    return F.when(city.isNotNull(), known).otherwise(guessed)
