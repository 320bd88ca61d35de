"""Street-name recognition, long forms and spelling variants as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routewright import dims
from routewright.functions.text import clean_label, literal_map, title_case

# What a word of a street name may be made of.
_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’\.\-]*"
_TRAILING = rf"^((?:{_WORD}\s+){{0,4}}{_WORD})\s+([A-Za-z]{{1,12}})\.?$"
_LEADING = rf"^([A-Za-z]{{2,8}})\s+({_WORD}(?:\s+{_WORD}){{0,4}}\.?)$"
_GLUED = rf"(?iu)^([A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'\-]{{2,}})({'|'.join(dims.GLUED_STREET_ENDINGS)})$"

# Letters taken as consonants, and misreadings tried in this order (found text, replacement).
CONSONANTS = "bcdfghjklmnpqrstvwxz"
MISREADINGS = [("cm", "om"), ("om", "cm"), ("rn", "m"), ("m", "rn"), ("I", "l"), ("l", "i")]

_MARK = "\u0001"


def parse_street(text: Column) -> Column:
    """struct(raw, normalized, suffix), NULL where the text is not street-shaped."""
    raw = clean_label(text)
    trailing_words = literal_map(dims.TRAILING_STREET_WORDS)
    leading_words = literal_map({word: word for word in dims.LEADING_STREET_WORDS})
    glued_words = literal_map(dims.GLUED_STREET_ENDINGS)

    def branch(suffix: Column, normalized: Column) -> Column:
        return F.when(
            suffix.isNotNull(),
            F.struct(raw.alias("raw"), normalized.alias("normalized"), suffix.alias("suffix")),
        )

    trailing = trailing_words[F.lower(F.regexp_extract(raw, _TRAILING, 2))]
    leading = leading_words[F.lower(F.regexp_extract(raw, _LEADING, 1))]
    glued = glued_words[F.lower(F.regexp_extract(raw, _GLUED, 2))]
    return F.coalesce(
        branch(trailing, F.concat(title_case(F.regexp_extract(raw, _TRAILING, 1)), F.lit(" "), title_case(trailing))),
        branch(leading, F.concat(title_case(leading), F.lit(" "),
                                 title_case(F.rtrim(F.regexp_extract(raw, _LEADING, 2), F.lit("."))))),
        branch(glued, F.concat(title_case(F.regexp_extract(raw, _GLUED, 1)), glued)),
    )


def looks_like_street(text: Column) -> Column:
    return (F.length(clean_label(text)) <= 60) & parse_street(text).isNotNull()


def _one_site_each(name: Column, marked: Column, dropped: int, inserted: str) -> Column:
    """Variants that change one marked site each: drop ``dropped`` characters after the mark, insert text there."""
    def variants(pieces: Column) -> Column:
        def change(site: Column) -> Column:
            head = F.array_join(F.slice(pieces, 1, site), "")
            tail = F.array_join(F.slice(pieces, site + 1, F.size(pieces)), "")
            return F.concat(head, F.lit(inserted), F.substr(tail, F.lit(dropped + 1)))

        sites = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1))
        return F.transform(F.coalesce(sites, F.array().cast("array<int>")), change)

    # Mapping over the one split result binds it to a name, so it is computed once.
    return F.flatten(F.transform(F.array(F.split(marked, _MARK)), variants))


def name_variants(name: Column, limit: int | None = 6) -> Column:
    """The name, then up to ``limit`` (or all) likely misreadings of it, in rule order and then by position."""
    pair = f"[{CONSONANTS}]"
    groups = [
        _one_site_each(name, F.regexp_replace(name, found, _MARK + found), len(found), replacement)
        for found, replacement in MISREADINGS
    ]
    groups.append(_one_site_each(name, F.regexp_replace(name, f"(?i)({pair})(i)({pair})", f"$1{_MARK}$2$3"), 1, ""))
    groups.append(_one_site_each(name, F.regexp_replace(name, f"(?i)(?={pair}{pair})", _MARK), 0, "i"))
    spellings = F.array_distinct(F.concat(F.array(name), *groups))
    return spellings if limit is None else F.slice(spellings, 1, limit + 1)
