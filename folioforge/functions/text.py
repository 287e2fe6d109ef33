"""Text normalisers and token sets. The variants differ on purpose; one function each."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "    ﻿"


def _bases() -> tuple[str, str]:
    """Letters whose canonical decomposition is an ASCII letter and marks, with those letters."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for r in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for i in r]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


ACCENTED, PLAIN = _bases()


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def text(c: Column) -> Column:
    """Null as empty text, wide blanks as plain ones."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), BLANKS, " " * len(BLANKS))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty; null if there is none."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


#: Combining marks, which go with the accents.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def strip_accents(c: Column, drop: str = "") -> Column:
    """Letters without accents, wide blanks as plain ones, and without the characters ``drop``: one pass over the text."""
    return F.translate(c, BLANKS + ACCENTED + MARKS + drop, " " * len(BLANKS) + PLAIN)


def raw(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def normalize_unicode(c: Column) -> Column:
    """Lower case without diacritics; all but letters, digits and blanks become blanks (TX1)."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(raw(c)), "^`¨¯´·¸"), "[^\\p{L}\\p{N}]+", " "))


def normalize_ascii(c: Column) -> Column:
    """Lower case without accents; all but a-z, 0-9 and white space become blanks (TX2, TX3)."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(raw(c))), "[^a-z0-9]+", " "))


def padded_corpus(*cols: Column) -> Column:
    """All texts as one run of plain words between single blanks, a blank at either end (TX4)."""
    joined = F.concat_ws(" ", *[F.when(text(c) != "", text(c)) for c in cols])
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(strip_accents(joined)), "[^a-z0-9]+", " ")), F.lit(" "))


def _spelled(c: Column, words: tuple[tuple[str, str], ...]) -> Column:
    start = F.replace(F.replace(F.lower(raw(c)), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    out = reduce(lambda x, w: F.replace(x, F.lit(w[0]), F.lit(w[1])), words, strip_accents(start))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def normalize_match(c: Column) -> Column:
    """Ligatures, ampersand and plus are spelled out (TX5)."""
    return _spelled(c, (("&", " and "), ("+", " plus ")))


def normalize_title(c: Column) -> Column:
    """Ligatures are spelled out (TX6)."""
    return _spelled(c, ())


def normalize_author(c: Column) -> Column:
    """Runs of all but a-z and 0-9 become one blank (TX7)."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(raw(c))), "[^a-z0-9]+", " "))


def normalize_wording(c: Column) -> Column:
    """Lower case without accents and apostrophes; other punctuation stays (TX8)."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(text(c))), "['’]", " "))


def clean_text(c: Column) -> Column:
    """White space squeezed (TX9); null and blank text give an empty one."""
    return squeeze(text(c))


def raw_text_title(c: Column) -> Column:
    """Text before the first author or ISBN label (TX10)."""
    return clean_text(F.get(F.split(text(c), "(?i)author\\(?s?\\)?\\s*:|isbn-1[03]\\s*:"), F.lit(0)))


def main_title(c: Column) -> Column:
    """Text before the first of : ; ( [ (TX11)."""
    return F.get(F.split(text(c), "[:;(\\[]", 2), F.lit(0))


#: Stop words of the token sets (TX12).
STOP_SIMILARITY = ("le", "la", "les", "un", "une", "des", "du", "de", "d", "l", "et", "a", "au", "aux", "en", "the", "of", "and")
STOP_TITLE = ("le", "la", "les", "un", "une", "des", "de", "du", "d", "l", "et", "au", "aux", "en", "dans", "sur", "the", "of", "to", "and", "a", "an")
STOP_WORK = ("le", "la", "les", "un", "une", "des", "de", "du", "d", "l", "et", "a", "au", "aux", "en", "the", "of", "and", "edition", "french", "tome", "vol")
STOP_PROVIDER = ("le", "la", "les", "un", "une", "des", "de", "du", "et", "au", "aux", "en", "dans", "tome", "vol", "volume", "the", "of", "and")


def token_list(normal: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Words of a normalised text in order, repeats included."""
    words = F.filter(F.split(normal, " "), lambda t: F.length(t) >= max(1, least))
    return F.filter(words, lambda t: ~t.isin(*stop)) if stop else words


def token_set(normal: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    return F.array_distinct(token_list(normal, least, stop))


def normal_similarity_tokens(normal: Column) -> Column:
    """:func:`similarity_tokens` of a text that :func:`normalize_unicode` made."""
    return token_set(normal, 2, STOP_SIMILARITY)


def similarity_tokens(c: Column) -> Column:
    return normal_similarity_tokens(normalize_unicode(c))


def title_tokens(c: Column) -> Column:
    return token_set(normalize_ascii(c), 1, STOP_TITLE)


def work_tokens(c: Column) -> Column:
    """Meaningful title words in order, repeats included."""
    return token_list(normalize_match(c), 3, STOP_WORK)


def token_key(c: Column) -> Column:
    """Sorted token set as one text (TX13)."""
    return F.array_join(F.array_sort(similarity_tokens(c)), " ")


def clip(c: Column, n: int) -> Column:
    """At most n characters, an ellipsis as the last where text was cut (TX14)."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def strip_bullets(c: Column) -> Column:
    return squeeze(F.regexp_replace(text(c), "^[\\s\\-–—*•·.]+", ""))


def slug(c: Column, n: int = 80) -> Column:
    """Lower-case words joined by hyphens, for names of files."""
    return F.substring(F.replace(normalize_author(c), F.lit(" "), F.lit("-")), 1, n)


def safe_path(c: Column) -> Column:
    """Characters other than letters, digits, dot, hyphen and underscore become underscores."""
    return F.regexp_replace(text(c), "[^A-Za-z0-9._-]+", "_")
