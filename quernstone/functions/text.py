"""Text cleaning and word splitting as Column expressions.

``\\w`` and ``\\s`` mean letters, numbers and underscore, and Unicode white space with the
separators U+001C-U+001F; plain Java classes differ in combining marks and separators.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s\x1c-\x1f"
URL = rf"(?U)https?://[^{SPACE}]+|www\.[^{SPACE}]+"
NOT_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE}]"
SPACES = rf"(?U)[{SPACE}]+"
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
ARABIC_MARKS = "[ً-ْٰـ]"
#: Punctuation that is deleted from Arabic text (fixed values): ASCII, and these further marks.
ARABIC_PUNCTUATION = string.punctuation + "÷×؛،؟«»“”…–¦ـ"


def strip_urls(c: Column) -> Column:
    """Web addresses become one space; schemes match in lower case only."""
    return F.regexp_replace(c, URL, " ")


def strip_symbol_runs(c: Column, least: int) -> Column:
    """Runs of ``least`` or more characters that are neither word nor space become one space."""
    return F.regexp_replace(c, rf"(?U){NOT_WORD}{{{least},}}", " ")


def collapse_spaces(c: Column) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_lexical(c: Column) -> Column:
    """For sparse retrieval: no addresses, no symbol runs of 4 or more, single spaces, lower case. Null becomes empty."""
    return F.lower(collapse_spaces(strip_symbol_runs(strip_urls(F.coalesce(c, F.lit(""))), 4)))


def clean_dense(c: Column) -> Column:
    """For dense retrieval: no addresses, no symbol runs of 10 or more, single spaces; case is kept. Null becomes empty."""
    return collapse_spaces(strip_symbol_runs(strip_urls(F.coalesce(c, F.lit(""))), 10))


def strip_arabic_marks(c: Column) -> Column:
    """Without vowel signs and tatweel."""
    return F.regexp_replace(c, ARABIC_MARKS, "")


def delete_punctuation(c: Column) -> Column:
    """Punctuation is deleted, not spaced, so its neighbours join."""
    return F.translate(c, ARABIC_PUNCTUATION, "")


def normalize_arabic(c: Column) -> Column:
    """Cleaning for Arabic: addresses, symbol runs, punctuation, spaces, case, vowel signs."""
    plain = delete_punctuation(strip_symbol_runs(strip_urls(F.coalesce(c, F.lit(""))), 4))
    return strip_arabic_marks(F.lower(collapse_spaces(plain)))


def split_words(c: Column) -> Column:
    """Runs of letters, numbers and underscores."""
    return F.filter(F.split(c, BETWEEN_WORDS), lambda w: w != "")


def lexical_words(c: Column) -> Column:
    """``split_words(clean_lexical(c))`` in one pass over texts without addresses: symbols and white space part words anyway.

    Only the sigma is lowered by what stands around it.
    """
    plain = F.coalesce(c, F.lit(""))
    cleaned = plain.contains("://") | plain.contains("www.") | plain.contains("\u03a3")
    return split_words(F.when(cleaned, clean_lexical(plain)).otherwise(F.lower(plain)))


def split_spaces(c: Column) -> Column:
    """What lies between white space, without empty strings."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def ends_sentence(word: Column) -> Column:
    return word.rlike("[.!?]$")


def join_words(words: Column, start: Column, length: Column) -> Column:
    """``length`` words from the 0-based ``start``, joined by spaces."""
    return F.array_join(F.slice(words, start + 1, length), " ")


def parse_list(c: Column) -> Column:
    """A printed list ``['a', 'b']`` as an array; ``[]`` and null give an empty one."""
    inner = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[|\]$", "")
    parts = F.filter(F.split(inner, ", "), lambda x: x != "")
    return F.transform(parts, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
