"""Book numbers: cleaning, checks, conversion, repair and search in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, text


def clean(c: Column) -> Column:
    """Digits and X only, upper case; null if nothing is left (IS1)."""
    kept = F.upper(F.regexp_replace(c.cast("string"), "[^0-9Xx]", ""))
    return F.when(kept != "", kept)


def _weighted(s: Column, n: int, weight) -> Column:
    """Sum of the first n digits, each times ``weight`` of its place from 1; null where a sign is no digit."""
    digit = lambda i: F.substring(s, i, F.lit(1)).try_cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda total, i: total + digit(i) * weight(i))


def check_digit13(core: Column) -> Column:
    """Check digit of 12 digits as text: weights 1 and 3 in turn, modulo 10."""
    total = _weighted(core, 12, lambda i: F.when(i % 2 == 1, 1).otherwise(3))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def valid13(c: Column) -> Column:
    """Thirteen digits with a right check digit (IS2); null counts as not valid."""
    right = lambda s: F.when(s.rlike("^[0-9]{13}$"), check_digit13(s) == F.substring(s, 13, 1))
    return F.coalesce(let(c, right), F.lit(False))


def valid10(c: Column) -> Column:
    """Nine digits and a digit or X whose weighted sum is divisible by 11 (IS3)."""
    last = lambda s: F.when(F.substring(s, 10, 1) == "X", 10).otherwise(F.substring(s, 10, 1).try_cast("int"))
    right = lambda s: F.when(s.rlike("^[0-9]{9}[0-9X]$"), F.pmod(_weighted(s, 9, lambda i: 11 - i) + last(s), F.lit(11)) == 0)
    return F.coalesce(let(c, right), F.lit(False))


def _with_check(core: Column) -> Column:
    return let(core, lambda x: F.concat(x, check_digit13(x)))


def ten_to_thirteen(c: Column, check: bool = True) -> Column:
    """IS4: prefix 978 and a new check digit; null for what is no book number of ten."""
    shaped = lambda s: valid10(s) if check else F.coalesce(s.rlike("^[0-9]{9}[0-9X]$"), F.lit(False))
    return _with_check(let(c, lambda s: F.when(shaped(s), F.concat(F.lit("978"), F.substring(s, 1, 9)))))


def thirteen_to_ten(c: Column) -> Column:
    """IS5: only for valid numbers that begin with 978."""
    core = let(c, lambda s: F.when(valid13(s) & F.startswith(s, F.lit("978")), F.substring(s, 4, 9)))
    check = lambda x: F.pmod(F.lit(11) - F.pmod(_weighted(x, 9, lambda i: 11 - i), F.lit(11)), F.lit(11))
    return let(core, lambda x: F.concat(x, let(check(x), lambda d: F.when(d == 10, F.lit("X")).otherwise(d.cast("string")))))


def best(isbn13: Column, isbn10: Column, isbn: Column) -> Column:
    """IS6: the first valid of isbn13, isbn, and isbn10 and isbn as ten-digit numbers."""
    if_valid = lambda c: let(clean(c), lambda s: F.when(valid13(s), s))
    return F.coalesce(if_valid(isbn13), if_valid(isbn), ten_to_thirteen(clean(isbn10)), ten_to_thirteen(clean(isbn)))


def normalize(c: Column) -> Column:
    """Any valid number as thirteen digits (IS7)."""
    return let(clean(c), lambda s: F.coalesce(F.when(valid13(s), s), ten_to_thirteen(s)))


def repair(c: Column) -> Column:
    """Thirteen digits from 978 or 979 with the check digit set right (IS7)."""
    return _with_check(let(clean(c), lambda s: F.when(s.rlike("^97[89][0-9]{10}$"), F.substring(s, 1, 12))))


def resolve(c: Column) -> Column:
    """struct(isbn13, repaired): the number if valid, else repaired where possible (IS7)."""
    pair = lambda p: F.struct(F.coalesce(p["good"], p["mended"]).alias("isbn13"), (p["good"].isNull() & p["mended"].isNotNull()).alias("repaired"))
    return let(c, lambda s: let(F.struct(normalize(s).alias("good"), repair(s).alias("mended")), pair))


def find_in_text(c: Column) -> Column:
    """array<struct<isbn13, via>> of all valid numbers in free text: thirteen digits with separators, product
    paths, then bare tens (IS8). Repeats stay."""
    s = text(c)
    long = F.transform(F.regexp_extract_all(s, F.lit("97[89](?:[\\s-]?[0-9]){10}"), F.lit(0)), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    path = F.regexp_extract_all(s, F.lit("/(?:dp|gp/product)/([0-9]{9}[0-9xX])"), F.lit(1))
    bare = F.regexp_extract_all(s, F.lit("(?<![0-9A-Za-z])([0-9]{9}[0-9xX])(?![0-9A-Za-z])"), F.lit(1))
    tag = lambda via: lambda v: F.struct(v.alias("isbn13"), F.lit(via).alias("via"))
    good = F.transform(F.filter(long, valid13), tag("isbn13"))
    tens = lambda a, via: F.filter(F.transform(a, lambda m: tag(via)(ten_to_thirteen(F.upper(m)))), lambda x: x["isbn13"].isNotNull())
    return F.concat(good, tens(path, "amazon_dp"), tens(bare, "isbn10"))


def from_url(c: Column) -> Column:
    """The first thirteen digits from 978 or 979 in a URL (IS10)."""
    found = F.regexp_extract(text(c), "(97[89][0-9]{10})", 1)
    return F.when(found != "", found)


def synthetic(number: Column) -> Column:
    """A valid book number made from a row number, for fixtures."""
    return _with_check(F.concat(F.lit("978"), F.lpad(F.pmod(number, F.lit(1_000_000_000)).cast("string"), 9, "0")))


# --- the same over whole columns of a frame. Lambdas are interpreted for each row; here each step is bound as a column, so
# that the arithmetic on whole numbers is compiled.


def _bound(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with the columns, each computed once: Catalyst copies no expression through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))))


def _place(n: Column, i: int) -> Column:
    """Digit i (from 1) of the twelve of a whole number."""
    return F.call_function("div", n, F.lit(10 ** (12 - i))) % 10


def _check13(n: Column) -> Column:
    total = sum((_place(n, i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    return F.pmod(F.lit(10) - total, F.lit(10)).cast("string")


def _sum10(n: Column) -> Column:
    """Weighted sum of the last nine digits."""
    return sum((_place(n, i + 3) * (11 - i) for i in range(1, 10)), F.lit(0))


def with_normal(df: DataFrame, c: Column, name: str) -> DataFrame:
    """``df`` with :func:`normalize` of ``c`` as the column ``name``."""
    s, n, end = (F.col(f"__{x}") for x in ("s", "n", "end"))
    kept = df.columns
    df = _bound(df, __s=clean(c))
    long, short = s.rlike("^[0-9]{13}$"), s.rlike("^[0-9]{9}[0-9X]$")
    whole = F.when(long, F.substring(s, 1, 12).cast("long")).when(short, F.substring(s, 1, 9).cast("long") + 978_000_000_000)
    last = F.when(long, F.substring(s, 13, 1)).when(short, F.substring(s, 10, 1))
    df = _bound(df, __n=whole, __end=last)
    df = _bound(df, __check=_check13(n), __sum=_sum10(n))
    ten = F.pmod(F.col("__sum") + F.when(end == "X", 10).otherwise(end.try_cast("int")), F.lit(11)) == 0
    of = F.when(F.length(s) == 13, F.when(F.col("__check") == end, s)).when(ten, F.concat(n.cast("string"), F.col("__check")))
    return _bound(df, **{name: of}).select(*kept, name)


def with_synthetic(df: DataFrame, number: Column, name: str) -> DataFrame:
    """``df`` with :func:`synthetic` of ``number`` as the column ``name``."""
    kept, n = df.columns, F.col("__n")
    df = _bound(df, __n=F.pmod(number.cast("long"), F.lit(1_000_000_000)) + 978_000_000_000)
    return _bound(df, **{name: F.concat(n.cast("string"), _check13(n))}).select(*kept, name)


def with_ten(df: DataFrame, c: Column, name: str) -> DataFrame:
    """``df`` with :func:`thirteen_to_ten` of ``c`` as the column ``name``."""
    kept, n, d = df.columns, F.col("__n"), F.col("__d")
    df = _bound(df, __s=c.cast("string"))
    df = _bound(df, __n=F.when(F.col("__s").rlike("^978[0-9]{10}$"), F.substring("__s", 1, 12).cast("long")), __end=F.substring("__s", 13, 1))
    df = _bound(df, __check=_check13(n), __d=F.pmod(F.lit(11) - F.pmod(_sum10(n), F.lit(11)), F.lit(11)))
    of = F.when(F.col("__check") == F.col("__end"), F.concat(F.substring(n.cast("string"), 4, 9), F.when(d == 10, F.lit("X")).otherwise(d.cast("string"))))
    return _bound(df, **{name: of}).select(*kept, name)
