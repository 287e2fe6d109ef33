"""Prices in text: single values, description lines, title fallbacks and their match to books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T


def listing_price(c: Column) -> Column:
    """PR1: the leading number of the text without other signs; null if there is none."""
    kept = F.regexp_replace(F.replace(T.text(c), F.lit(","), F.lit(".")), "[^0-9.]", "")
    return F.regexp_extract(kept, "^[0-9]*\\.?[0-9]*", 0).try_cast("double")


def french_price(c: Column) -> Column:
    """PR2: strictly digits and at most two decimals, with or without the euro sign; else null."""
    bare = F.regexp_replace(F.replace(F.trim(T.text(c)), F.lit("€"), F.lit("")), "\\s+", "")
    dotted = F.regexp_replace(bare, "^([^,]*),", "$1.")
    return F.when(dotted.rlike("^[0-9]+(\\.[0-9]{1,2})?$"), dotted).try_cast("decimal(10,2)")


def lax_price(c: Column) -> Column:
    """PR3: first comma as a point, all signs but digits and points dropped; empty text is 0, null stays null."""
    kept = F.regexp_replace(F.regexp_replace(T.text(c), "^([^,]*),", "$1."), "[^0-9.]", "")
    return F.when(c.isNull(), F.lit(None).cast("double")).when(kept == "", 0.0).otherwise(kept.try_cast("double"))


def number_or_zero(c: Column) -> Column:
    """PR4."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(n)


def profit(price: Column, cost: Column) -> Column:
    """PR9: price less cost, 2 decimals; null if either is."""
    return F.round(price.cast("decimal(10,2)") - cost.cast("decimal(10,2)"), 2).cast("decimal(10,2)")


#: Volume wording: "tome 1", "tome 1 et 2", "tomes 1 à 3", "t1" (PR6).
VOLUME = "(?i)\\b(?:tomes?|vol(?:umes?)?)\\.?\\s*([0-9]{1,3})(?:\\s*(et|&|,|à|a|-)\\s*([0-9]{1,3}))?|\\bt([0-9]{1,3})\\b"
PER_UNIT = "\\b(?:chacun|chacune|piece|unite)\\b|/\\s*(?:u|piece)\\b"
LONGEST_RANGE = 12


def volumes(c: Column) -> Column:
    """array<int> of the volumes that a text names first; empty without any (PR6)."""
    part = lambda s, i: F.regexp_extract(s, VOLUME, i)
    found = lambda s: F.struct(part(s, 1).try_cast("int").alias("one"), F.lower(part(s, 2)).alias("sep"), part(s, 3).try_cast("int").alias("two"), part(s, 4).try_cast("int").alias("short"))

    def listed(f: Column) -> Column:
        one, two = f["one"], f["two"]
        span = F.when((two > one) & (two - one <= LONGEST_RANGE), F.sequence(one, F.greatest(one, two))).otherwise(F.array(one))
        many = F.when(two.isNull(), F.array(one)).when(f["sep"].isin("et", "&", ","), F.array(one, two)).otherwise(span)
        return F.when(f["short"].isNotNull(), F.array(f["short"])).when(one.isNotNull(), many).otherwise(F.array().cast("array<int>"))

    return T.let(T.let(T.text(c), found), listed)


def first_volume(c: Column) -> Column:
    return F.get(volumes(c), F.lit(0))


def strip_volume(c: Column) -> Column:
    return T.squeeze(F.regexp_replace(T.text(c), VOLUME, " "))


QUOTED = "[\"“«]\\s*([^\"“«”»]+?)\\s*[\"”»]"
NUMBER = "[0-9]{1,4}(?:[.,][0-9]{1,2})?"
AMOUNT = f"({NUMBER})\\s*€"


def line_entries(line: Column) -> Column:
    """array<struct<title, author, volume, price, raw_line, distributed, group_size>> of one description line (PR5).

    The last price of the line counts. A quoted title stands alone, with the author behind it. Without quotes
    the text before the volume, or before a separator, is the title; a group price is shared out over the
    volumes unless the wording is per unit.
    """
    return T.let(F.trim(T.text(line)), _entries)


SEPARATOR = "^(.*?)(?:\\s*[:/]\\s*|\\s+[-–—]\\s+)"


def _entries(s: Column) -> Column:
    amounts = F.regexp_extract_all(s, F.lit(AMOUNT), F.lit(1))
    price = T.let(amounts, lambda a: french_price(F.get(a, F.size(a) - 1)))
    head = F.regexp_extract(s, f"^(.*?)(?={NUMBER}\\s*€)", 1)
    behind = F.regexp_extract(s, f"{QUOTED}(.*)$", 2)
    author = F.regexp_replace(F.get(F.split(behind, "/"), F.lit(0)), "(?i)(?<![\\p{L}0-9_])(ed|éd|éditions?|editions?)(?![\\p{L}0-9_]).*$", "")
    facts = F.struct(
        price.alias("price"), F.trim(F.regexp_extract(s, QUOTED, 1)).alias("quoted"), F.trim(F.regexp_replace(author, "[0-9€].*$", "")).alias("author"), head.alias("head"),
        volumes(head).alias("found"), T.normalize_wording(s).rlike(PER_UNIT).alias("per_unit"),
    )
    return T.let(facts, lambda f: _listed(s, f))


def _listed(s: Column, f: Column) -> Column:
    """Entries from a line's facts."""
    has_volume, none = F.size(f["found"]) > 0, F.lit(None).cast("string")
    before = F.when(has_volume, F.get(F.split(f["head"], VOLUME), F.lit(0))).when(f["head"].rlike(SEPARATOR), F.regexp_extract(f["head"], SEPARATOR, 1)).otherwise(F.lit(""))
    shared = (F.size(f["found"]) > 1) & ~f["per_unit"]
    each = F.when(shared, F.round(f["price"] / F.size(f["found"]), 2)).otherwise(f["price"])

    def of(volume: Column, title: Column, author: Column, price: Column, distributed: Column, size: Column) -> Column:
        money = price.cast("decimal(10,2)")
        return F.struct(title.alias("title"), author.alias("author"), volume.cast("int").alias("volume"), money.alias("price"), s.alias("raw_line"), distributed.alias("distributed"), size.cast("int").alias("group_size"))

    alone = F.array(of(F.lit(None), f["quoted"], F.when(f["author"] != "", f["author"]), f["price"], F.lit(False), F.lit(1)))

    def titled(title: Column) -> Column:
        plain = F.array(of(F.lit(None), title, none, f["price"], F.lit(False), F.lit(1)))
        many = F.transform(f["found"], lambda v: of(v, title, none, each, shared, F.size(f["found"])))
        return F.when(F.length(title) < 2, F.slice(plain, 1, 0)).when(has_volume, many).otherwise(plain)

    listed = F.when(f["quoted"] != "", alone).otherwise(T.let(T.strip_bullets(before), titled))
    return F.when(f["price"].isNull(), F.slice(alone, 1, 0)).otherwise(listed)


def description_entries(listings: DataFrame, key: str = "ads_id", description: str = "description") -> DataFrame:
    """(key, ord, title, author, volume, price, ...) of all priced lines of all descriptions (PR5)."""
    lines = listings.select(key, F.posexplode(F.split(T.text(F.col(description)), "\\r?\\n")).alias("line_no", "line"))
    rows = lines.select(key, "line_no", F.posexplode(line_entries(F.col("line"))).alias("pos", "e"))
    return rows.select(key, (F.col("line_no") * 1000 + F.col("pos")).alias("ord"), "e.*")


def match_prices(books: DataFrame, entries: DataFrame, key: str = "ads_id", book: str = "book_no") -> DataFrame:
    """(key, book, price): the price that a listing's priced lines give each book, null if unclear (JN15, AG19).

    ``books`` has title, possible_corrected_title, lookup_title, raw_visible_text, author, lookup_authors.
    The listing is the equi key of the join; title containment, volume and author decide within it.
    """
    name = T.first_filled(F.col("title"), F.col("possible_corrected_title"), F.col("lookup_title"))
    b = books.select(
        key, book, T.normalize_ascii(strip_volume(name)).alias("t"),
        T.normalize_ascii(T.first_filled(F.col("author"), F.col("lookup_authors"))).alias("a"),
        F.coalesce(first_volume(name), first_volume(F.col("raw_visible_text"))).alias("v"),
    )
    e = entries.select(key, F.col("ord").alias("e_ord"), T.normalize_ascii(strip_volume(F.col("title"))).alias("e_t"), T.normalize_ascii(F.col("author")).alias("e_a"), F.col("volume").alias("e_v"), F.col("price").alias("e_p"))
    inside = (F.least(F.length("t"), F.length("e_t")) >= 4) & (F.contains("t", "e_t") | F.contains("e_t", "t"))
    hit = b.filter("t <> ''").join(e.filter("e_t <> ''"), key).filter((F.col("t") == F.col("e_t")) | inside)
    share = F.exists(T.token_list(F.col("a"), 4), lambda x: F.array_contains(T.token_list(F.col("e_a"), 4), x))
    overlap = (F.col("a") != "") & (F.col("e_a") != "") & (F.contains("a", "e_a") | F.contains("e_a", "a") | share)
    flags = {"vol": F.col("e_v") == F.col("v"), "exact": (F.col("a") != "") & (F.col("a") == F.col("e_a")), "near": overlap}
    of = []
    for n, f in flags.items():
        p = F.when(f, F.col("e_p"))
        of += [F.count_if(f).alias(f"{n}_n"), F.count_distinct(p).alias(f"{n}_d"), F.max(p).alias(f"{n}_p")]
    g = hit.groupBy(key, book).agg(F.max("v").alias("v"), F.count("*").alias("n"), F.count_distinct("e_p").alias("d"), F.max("e_p").alias("p"), F.count_if(F.col("e_v").isNotNull()).alias("with_v"), *of)
    by_volume = F.when(F.col("vol_d") == 1, F.col("vol_p"))
    rest = F.when(F.col("n") == 1, F.col("p")).when(F.col("exact_n") == 1, F.col("exact_p")).when(F.col("near_n") == 1, F.col("near_p")).when(F.col("d") == 1, F.col("p"))
    price = F.when(F.col("v").isNotNull() & (F.col("vol_n") > 0), by_volume).when(F.col("v").isNotNull() & (F.col("with_v") > 0), F.lit(None)).otherwise(rest)
    return g.select(key, book, price.cast("decimal(10,2)").alias("price"))


def title_fallback(title: Column, detected: Column) -> Column:
    """struct(price, mode): a price per unit in the listing's title, or a lot's price over as many books as were
    detected (PR7)."""
    w = T.normalize_wording(title)
    unit = w.rlike("\\b(?:chacun|chacune|piece|unite)\\b")
    beside = french_price(F.regexp_extract(w, "([0-9]{1,4}(?:[.,][0-9]{1,2})?)\\s*€?\\s*(?:la\\s+|/\\s*)?(?:piece|chacun|chacune|unite|l\\s+unite)", 1))
    all_prices = F.filter(F.transform(F.regexp_extract_all(w, F.lit(AMOUNT), F.lit(1)), french_price), lambda p: p > 0)
    per_unit = F.coalesce(beside, F.when(F.size(all_prices) == 1, F.get(all_prices, F.lit(0))))
    lot = "lot\\s+de\\s+([0-9]{1,4})\\b[^€]*?([0-9]{1,4}(?:[.,][0-9]{1,2})?)\\s*€"
    n, total = F.regexp_extract(w, lot, 1).try_cast("int"), french_price(F.regexp_extract(w, lot, 2))
    lot_price = F.when((n > 0) & (total > 0) & (n == detected), F.round(total / n, 2))
    price = F.when(unit, F.when(per_unit > 0, per_unit)).otherwise(lot_price).cast("decimal(10,2)")
    mode = F.when(price.isNull(), "none").when(unit, "title_per_unit").otherwise("title_lot_distributed")
    return F.struct(price.alias("price"), mode.alias("mode"))


def seller_prices(books: DataFrame, listings: DataFrame, key: str = "ads_id", book: str = "book_no") -> DataFrame:
    """(key, book, price, source) of each detected book: the price of a listing with one book, else of its
    description, else of its title (PR8)."""
    counted = books.withColumn("detected", F.count("*").over(Window.partitionBy(key)).cast("int"))
    found = match_prices(books, description_entries(listings, key), key, book).withColumnRenamed("price", "described")
    rows = counted.select(key, book, "detected").join(listings.select(key, "price_amount", F.col("title").alias("ad_title")), key, "left").join(found, [key, book], "left")
    amount = F.col("price_amount").cast("decimal(10,2)")
    single = F.when((F.col("detected") == 1) & (amount > 0), amount)
    rows = rows.withColumn("fallback", title_fallback(F.col("ad_title"), F.col("detected")))
    source = F.when(single.isNotNull(), "single_ad_price").when(F.col("described").isNotNull(), "description").otherwise(F.col("fallback.mode"))
    return rows.select(key, book, F.coalesce(single, "described", "fallback.price").alias("price"), source.alias("source"))
