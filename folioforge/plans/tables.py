"""The driver's tables in the roles of listings, books, jobs, events and costs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isbn, similarity
from ..functions import text as T
from ..operators.merge import best_offer
from ..shipping import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to four tasks for each core, for work that costs much for each row: the few megabytes of a table of
    millions of short rows are read by one task or two, which would then do all of it."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def each_once(df: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """Adds ``columns``, which cost much and depend on ``keys`` alone: they are made once for each different combination of
    keys, nulls included, and joined back."""
    made = df.select(*keys).distinct().select(*[F.col(k).alias(f"__{k}") for k in keys], *columns)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(made, same).drop(*[f"__{k}" for k in keys])


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ads_id, part, supplier, line, price): line items as provider offers; price is extended price × discount."""
    price = F.round(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ads_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"), price.alias("price")
    )


def priced_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ads_id, part, a, b, cost): each book's price at providers A (even suppliers) and B (odd), its cost."""
    rows = offers(spark, sf_dir)
    sides = rows.groupBy("ads_id", "part").agg(F.max(F.when(F.col("supplier") % 2 == 0, F.col("price"))).alias("a"), F.max(F.when(F.col("supplier") % 2 == 1, F.col("price"))).alias("b"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round(F.col("p_retailprice").cast("decimal(12,2)") / 100, 2).cast("decimal(12,2)").alias("cost"))
    return sides.join(parts, "part")


def best_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: best offer, platform and profit of each book of each listing."""
    rows = priced_books(spark, sf_dir).withColumn("o", best_offer(F.col("a"), F.col("b")))
    return rows.select("ads_id", "part", F.col("o.price").cast("decimal(12,2)").alias("best_price"), F.col("o.platform").alias("platform"), (F.col("o.price").cast("decimal(12,2)") - F.col("cost")).cast("decimal(12,2)").alias("profit"))


def book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as book rows in every state that the ladders know, derived from their numbers."""
    li = read(spark, sf_dir, "lineitem")
    k = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")).cast("long")
    pick = lambda m, *v: F.get(F.array(*[F.lit(x) for x in v]), F.pmod(F.floor(k / m).cast("long"), F.lit(len(v))).cast("int"))
    price = F.round(F.col("l_discount").cast("decimal(4,2)") * 100, 2).cast("decimal(10,2)")
    return li.select(
        F.col("l_orderkey").alias("ads_id"), F.col("l_linenumber").alias("line"),
        F.when(F.pmod(k, F.lit(11)) != 0, isbn.synthetic(F.col("l_partkey"))).alias("isbn"),
        pick(1, "isbn_strong", "isbn_medium", "isbn_weak", "momox_pending", "isbn_invalid").alias("status"),
        pick(2, "not_sent", "momox_pending", "momox_price_found", "momox_no_offer", "momox_failed").alias("momox_status"),
        pick(3, "not_sent", "gibert_pending", "gibert_price_found", "gibert_non_repris", "gibert_failed", "gibert_missing", "").alias("gibert_status"),
        F.lit(None).cast("timestamp").alias("gibert_checked_at"),
        F.when(F.col("l_linenumber") % 2 == 0, price).alias("momox_price"), F.when(F.col("l_linenumber") % 3 == 0, price).alias("gibert_price"),
        pick(5, "strong_candidate", "medium_candidate", "weak_candidate", "duplicate_selected", "rejected").alias("candidate_status"),
        pick(7, "new", "validated", "pending", "pending_edition_choice", "new", "new", "rejected").alias("admin_status"),
        pick(4, "match", "likely_match", "mismatch", "uncertain", "not_checked", "not_checked").alias("provider_match_status"),
        pick(6, "catalog_no_match", "visible_isbn", "not_eligible").alias("not_sent_reason"),
    )


def token_sides(spark: SparkSession, sf_dir: str, tokens: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(l, tokens) of the documents and (r, tokens) of the benchmark items: whole texts; ids are distinct and not null."""
    each = lambda name, key, to: read(spark, sf_dir, name).filter(F.col(key).isNotNull()).select(F.col(key).alias(to), tokens(F.col("text")).alias("tokens"))
    return each("documents", "doc_id", "l"), each("benchmark", "item_id", "r")


def line_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines of documents and benchmark items as token sets, for :mod:`folioforge.operators.set_join`.

    (l, tokens) of the distinct lines, (r, tokens) of the items, (g, l) of the documents that have a line, and (l, r, score) of
    the pairs of which one's main title is the other's start; these meet on its first 12 characters.
    """
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("title")).withColumn("l", F.xxhash64("title"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("r"), F.col("text").alias("title"))

    def sided(df: DataFrame, key: str) -> DataFrame:
        title, normal = F.col("title"), F.col("normal")
        # the main title is most often the whole one, which is normalised already
        main = F.when(title.rlike("[:;(\\[]"), T.normalize_unicode(T.main_title(title))).otherwise(normal)
        return df.withColumn("normal", T.normalize_unicode(title)).select(key, T.normal_similarity_tokens(normal).alias("tokens"), main.alias("main"))

    # lines are cut into tokens once: every step below reads them several times
    left = stored(sided(lines.select("l", "title").distinct(), "l"), "lines")
    right = stored(sided(items, "r"), "items")
    members = stored(lines.select(F.col("doc_id").alias("g"), "l").distinct(), "members")
    long = lambda df, key, size, main: df.filter((F.length("main") >= 12) & (F.size("tokens") > 0)).select(key, F.size("tokens").alias(size), F.col("tokens").alias(f"{size}_tokens"), F.col("main").alias(main), F.substring("main", 1, 12).alias("start"))
    started = long(left, "l", "n", "x").join(long(right, "r", "m", "y"), "start").filter(similarity.prefix_match(F.col("x"), F.col("y")))
    shared = F.size(F.array_intersect("n_tokens", "m_tokens"))
    scored = started.select("l", "r", similarity.counted_similarity(shared, F.col("n"), F.col("m"), F.lit(True)).alias("score"))
    return left.select("l", "tokens"), right.select("r", "tokens"), members, stored(scored, "started")


def line_measure(shared: Column, n: Column, m: Column) -> Column:
    """SIM1 of two lines by the tokens they share; pairs that start alike are scored beside it."""
    return similarity.counted_similarity(shared, n, m, F.lit(False))
