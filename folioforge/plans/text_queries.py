"""Registered queries of text normalisers, similarities and book numbers, over whole documents and made titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isbn, misc, similarity
from ..functions import text as T
from .ladder_queries import SIMILARITY_STOP, prefix_sql, similarity_sql, words_sql
from .registry import made, made_sql, query, share, turn
from .tables import each_once, read, spread

_PLAIN = "strip_accents(replace(replace(lower(text), 'œ', 'oe'), 'æ', 'ae'))"
_AZ = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, sha256({_AZ(_PLAIN)}) AS title, sha256({_AZ('strip_accents(lower(text))')}) AS author, sha256({_SQUEEZE("regexp_replace(lower(strip_accents(text)), '[''’]', ' ', 'g')")}) AS wording, sha256({_SQUEEZE('text')}) AS clean,
  sha256(' ' || {_AZ('lower(strip_accents(text))')} || ' ') AS corpus FROM documents""")
def text_normalisers(spark: SparkSession, d: str) -> DataFrame:
    """TX3, TX4, TX6, TX7, TX8, TX9, as digests of whole texts."""
    t = F.col("text")
    each = {"title": T.normalize_title(t), "author": T.normalize_author(t), "wording": T.normalize_wording(t), "clean": T.clean_text(t), "corpus": T.padded_corpus(t)}
    return read(spark, d, "documents").select("doc_id", *[F.sha2(c, 256).alias(n) for n, c in each.items()])


_MAIN = "string_split_regex(text, '[:;(\\[]')[1]"
_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TOKENS = f"list_distinct(list_filter(string_split({_NORM}, ' '), lambda t: length(t) >= 2 AND NOT list_contains({list(SIMILARITY_STOP)!r}, t)))"


@query(f"""SELECT doc_id, sha256({_MAIN}) AS main, sha256(CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END) AS clipped, CAST(len({_TOKENS}) AS INT) AS tokens, sha256(array_to_string(list_sort({_TOKENS}), ' ')) AS token_key,
  sha256(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g')) AS path FROM documents""")
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    """TX11, TX12, TX13, TX14 of whole texts."""
    t = F.col("text")
    digest = lambda c: F.sha2(c, 256)
    return read(spark, d, "documents").select(
        "doc_id", digest(T.main_title(t)).alias("main"), digest(T.clip(t, 200)).alias("clipped"), F.size(T.similarity_tokens(t)).alias("tokens"), digest(T.token_key(t)).alias("token_key"), digest(T.safe_path(t)).alias("path"),
    )


_RAW = {"raw": turn(1, "Le titre  Author(s): X", "Le titre ISBN-13: 978", "Seul titre", "", None, "auteur authors: y"), "bullet": turn(3, "  - • Un titre", "— deux", "sans", None), "name": turn(5, "Été à la mer !", "a--b c", None)}


@query(f"""WITH {made_sql(_RAW)} SELECT ads_id, line, CASE raw WHEN 'Le titre  Author(s): X' THEN 'Le titre' WHEN 'Le titre ISBN-13: 978' THEN 'Le titre' WHEN 'Seul titre' THEN 'Seul titre' WHEN 'auteur authors: y' THEN 'auteur' ELSE '' END AS title,
  CASE bullet WHEN '  - • Un titre' THEN 'Un titre' WHEN '— deux' THEN 'deux' ELSE coalesce(bullet, '') END AS unbulleted, CASE name WHEN 'Été à la mer !' THEN 'ete-a-la-mer' WHEN 'a--b c' THEN 'a-b-c' ELSE '' END AS slug,
  rtrim(replace(replace(to_base64(encode(coalesce(name, ''))), '+', '-'), '/', '_'), '=') AS code FROM r""")
def raw_titles(spark: SparkSession, d: str) -> DataFrame:
    """TX10, TX14, UR2."""
    return made(spark, d, _RAW).select("ads_id", "line", T.raw_text_title(F.col("raw")).alias("title"), T.strip_bullets(F.col("bullet")).alias("unbulleted"), T.slug(F.col("name")).alias("slug"), misc.url_safe_base64(F.coalesce("name", F.lit(""))).alias("code"))


_A = ("le petit prince rouge", "le petit prince rouge et bleu", "les chats du port", "prince rouge petit", "chats", "histoire du port des chats", "petit", "")
_PAIR = {"a": turn(1, *_A), "b": turn(3, *_A), "c": turn(11, "abc", "abcdef", "", None), "e": turn(13, "xyzt", "xyztuvwx", "", None), "score": share(2), "author": turn(5, 0, 0.5, 1, None), "has_author": turn(7, True, False), "lang": turn(17, "fr", "en")}
_STOP_PROVIDER = ("le", "la", "les", "un", "une", "des", "de", "du", "et", "au", "aux", "en", "dans", "tome", "vol", "volume", "the", "of", "and")


def _jaccard_sql(x: str, y: str) -> str:
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({x}, {y})) AS DOUBLE) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)"


_PX, _PY = (f"list_distinct({words_sql(c, 3, _STOP_PROVIDER)})" for c in "ab")
_UX, _UY = (f"list_distinct({words_sql(c, 2)})" for c in "ab")
_TX, _TY = (f"list_distinct({words_sql(c, 3)})" for c in "ab")
_KX, _KY = (f"array_to_string(list_sort(list_distinct({words_sql(c, 2, SIMILARITY_STOP)})), ' ')" for c in "ab")


@query(f"""WITH {made_sql(_PAIR)} SELECT ads_id, line, {similarity_sql('a', 'b')} AS tokens, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE {_jaccard_sql(_PX, _PY)} END AS provider, round({_jaccard_sql(_UX, _UY)}, 3) AS jaccard,
  {prefix_sql('a', 'b')} AS prefix, CASE WHEN greatest(len({_TX}), len({_TY})) = 0 THEN 0.0 ELSE floor(CAST(len(list_intersect({_TX}, {_TY})) AS DOUBLE) / greatest(len({_TX}), len({_TY})) * 100 + 0.5) / 100 END AS title_only,
  a = b AND a <> '' AS exact, {_KX} = {_KY} AND {_KX} <> '' AS same_words FROM r""")
def title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SIM1, SIM2, SIM4, SIM7, SIM10, SIM13."""
    a, b, s = F.col("a"), F.col("b"), similarity
    return each_once(
        made(spark, d, _PAIR).select("ads_id", "line", "a", "b"), ["a", "b"],
        s.token_similarity(a, b).alias("tokens"), s.provider_title_similarity(a, b).alias("provider"), s.union_title_similarity(a, b).alias("jaccard"), s.work_prefix_match(a, b).alias("prefix"),
        s.title_only_score(a, b).alias("title_only"), s.exact_title(b, a).alias("exact"), s.article_insensitive_title(b, a).alias("same_words"),
    ).drop("a", "b")


@query(f"""WITH {made_sql(_PAIR)} SELECT ads_id, line, CASE WHEN coalesce(e, '') = '' THEN c WHEN coalesce(c, '') = '' OR length(e) > length(c) + 2 THEN e ELSE c END AS better,
  floor(least(1.0, score * 0.8 + CASE WHEN has_author THEN coalesce(author, 0) * 0.2 WHEN score >= 0.9 THEN 0.1 ELSE 0 END) * 100 + 0.5) / 100 AS candidate FROM r""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """SIM3, SIM12."""
    return made(spark, d, _PAIR).select("ads_id", "line", similarity.better_text(F.col("c"), F.col("e")).alias("better"), similarity.candidate_score([F.col("score")], F.col("author"), F.col("has_author")).alias("candidate"))


# --- book numbers

_CORE10 = "lpad(CAST(p_partkey AS VARCHAR), 9, '0')"
_SUM10 = f"list_sum(list_transform(range(1, 10), lambda i: CAST(substr({_CORE10}, CAST(i AS INT), 1) AS INT) * (11 - i)))"
_TEN = f"{_CORE10} || CASE WHEN (11 - {_SUM10} % 11) % 11 = 10 THEN 'X' ELSE CAST((11 - {_SUM10} % 11) % 11 AS VARCHAR) END"


def _sum13(x: str) -> str:
    return f"list_sum(list_transform(range(1, 14), lambda i: CAST(substr({x}, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))"


_ANY13 = "('978' || lpad(CAST(p_partkey * 7919 % 10000000000 AS VARCHAR), 10, '0'))"
_ANY10 = "lpad(CAST(p_partkey * 104729 % 10000000000 AS VARCHAR), 10, '0')"


@query(f"""SELECT p_partkey AS part, {_sum13(_ANY13)} % 10 = 0 AS valid13, list_sum(list_transform(range(1, 11), lambda i: CAST(substr({_ANY10}, CAST(i AS INT), 1) AS INT) * (11 - i))) % 11 = 0 AS valid10, {_TEN} AS made10, true AS made10_valid,
  substr({_TEN}, 10, 1) = 'X' AS ends_in_x, {_ANY13} AS from_url FROM part""")
def number_checks(spark: SparkSession, d: str) -> DataFrame:
    """IS2, IS3, IS10: any thirteen and ten digits, of which the check digit is right by chance."""
    key = F.col("p_partkey").cast("long")
    thirteen = F.concat(F.lit("978"), F.lpad(F.pmod(key * 7919, F.lit(10_000_000_000)).cast("string"), 10, "0"))
    ten = F.lpad(F.pmod(key * 104729, F.lit(10_000_000_000)).cast("string"), 10, "0")
    mine = isbn.thirteen_to_ten(isbn.synthetic(key))
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("part"), isbn.valid13(thirteen).alias("valid13"), isbn.valid10(ten).alias("valid10"), mine.alias("made10"), isbn.valid10(mine).alias("made10_valid"),
        F.endswith(mine, F.lit("X")).alias("ends_in_x"), isbn.from_url(F.concat(F.lit("https://x.test/cover/"), thirteen, F.lit(".jpg"))).alias("from_url"),
    )


_CHECK13 = "CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({c}, CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR)"
_CORE13 = f"('978' || {_CORE10})"
_ISBN = f"({_CORE13} || {_CHECK13.format(c=_CORE13)})"


@query(f"SELECT p_partkey AS part, unnest(['isbn13', 'amazon_dp', 'isbn10']) AS via, {_ISBN} AS isbn13 FROM part UNION ALL SELECT p_partkey, 'isbn10', '9781234567897' FROM part WHERE p_partkey % 2 = 0")
def numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    """IS8 with all its rules: thirteen digits with hyphens, a product path, bare tens, and numbers that are not valid."""
    n = isbn.synthetic(F.col("p_partkey"))
    ten = isbn.thirteen_to_ten(n)
    more = F.when(F.col("p_partkey") % 2 == 0, "; 123456789X").otherwise("; 1234567890")
    said = F.concat(F.lit("ISBN "), F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 10), F.lit(" https://x.test/dp/"), ten, F.lit("?a=b, ou ("), ten, F.lit(")"), more)
    rows = spread(read(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("part"), F.explode(isbn.find_in_text(said)).alias("f"))
    # the product path's number also stands alone
    return rows.select("part", "f.via", "f.isbn13").distinct()
