"""Language labels as written by many hands: spellings of one language are merged into its code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say "unknown" in a label field. A label without any letter says so too.
UNKNOWN_WORDS = ("und", "unknown", "unk", "none", "null", "nan", "na", "n/a", "nil", "mis", "mul", "zxx", "xx", "undefined", "undetermined", "missing", "other")
#: More rows than this can't be a table of languages; it is collected into a map literal.
MOST_LANGUAGES = 2000


def label_key(label: Column) -> Column:
    """The label trimmed, in lower case, and without a region ending such as ``-US``; null if it says nothing."""
    low = F.lower(F.trim(F.regexp_replace(label, r"(?U)[\s ​]+", " ")))
    bare = F.when(low.isin(*UNKNOWN_WORDS) | ~low.rlike(r"\p{L}"), None).otherwise(low)
    return F.regexp_replace(bare, r"^([a-z]{2,3})[-_][a-z0-9]{2,8}([-_][a-z0-9]{2,8})*$", "$1")


def code_of(label: Column, languages: DataFrame) -> Column:
    """The code in ``languages`` that a label names by code, three-letter code or name.

    Null for a missing label. A label that names something else stays as its trimmed
    lower-case self, so that it is never mistaken for a missing one.
    """
    rows = languages.select("code", "iso3", "name_en", "name_native").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError("the table of languages is too long")
    names: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: str(r["code"])):
        for name in (r["code"], r["iso3"], r["name_en"], r["name_native"]):
            if name and r["code"]:
                names.setdefault(name.strip().lower(), r["code"])
    key = label_key(label)
    if not names:
        return key
    spelled = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.when(key.isNotNull(), F.coalesce(F.try_element_at(spelled, key), key))
