"""Pages of the sources to rows, by rules over :mod:`folioforge.sources.html`'s elements and texts.

Everything is joins of positions, aggregates and columns. A page that holds nothing a rule asks for gives no
rows; keys are distinct.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import isbn as I
from ..functions.misc import absolute_url
from .html import END, Pages, attr, has_class, squeezed


def number(c: Column) -> Column:
    """Digits and X of a text in upper case; null for none."""
    n = F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))
    return F.when(n != "", n)


def _stated(text: Column, digits: int) -> Column:
    """The number behind its label."""
    return number(F.regexp_extract(text, rf"(?i)ISBN-?{digits}:\s*([0-9Xx-]+)", 1))


def _labelled(text: Column, label: str, *stops: str) -> Column:
    """What follows "label:" on the line, up to a stop word."""
    line = F.regexp_extract(text, rf"(?i){label}:[ \t]*([^\n\r]+)", 1)
    for s in stops:
        line = F.regexp_replace(line, rf"(?is){s}.*$", "")
    return squeezed(line)


def _link(url: Column, base: str) -> Column:
    return absolute_url(url, base)


def search_pages(df: DataFrame, key: str, html: str, base: str = "https://isbnsearch.org") -> DataFrame:
    """SRC3: list items that name a book number: numbers, title, authors, picture, link; the first of each number.

    Items of the element ``searchresults`` where there is one, else of the page. The link is the first to a book's page
    inside the item's ``bookinfo``, else inside the item.
    """
    p = Pages(df, key, html)
    where = p.first(attr("id") == "searchresults", "r", p.whole())
    items = p.inside(where, p.find(F.col("tag") == "li"), "r").select("k", F.col("pos").alias("li_pos"), F.col("end").alias("li_end"))
    items = p.text(items, "li", "text").filter(F.col("text").rlike("(?i)ISBN-?1[03]:"))
    info = p.first_inside(items, "li", has_class("bookinfo"), F.struct("pos", "end").alias("info"))
    items = items.join(info, ["k", "li_pos"], "left")
    a = p.find((F.col("tag") == "a") & F.contains(F.coalesce(attr("href"), F.lit("")), F.lit("/isbn/"))).select("k", "pos", "end", attr("href").alias("href"))
    found = p.inside(items.select("k", "li_pos", "li_end", "info"), a, "li")
    first = F.struct(~F.coalesce((F.col("pos") > F.col("info.pos")) & (F.col("pos") < F.col("info.end")), F.lit(False)), "pos")
    link = found.groupBy("k", "li_pos").agg(F.min_by(F.struct("href", "pos", "end"), first).alias("a")).select("k", "li_pos", F.col("a.href").alias("href"), F.col("a.pos").alias("a_pos"), F.col("a.end").alias("a_end"))
    link = p.text(link, "a", "link_text").drop("a_pos", "a_end")
    img = p.first_inside(items, "li", F.col("tag") == "img", attr("src").alias("src"), attr("alt").alias("alt"))
    rows = items.join(link, ["k", "li_pos"], "left").join(img, ["k", "li_pos"], "left")
    text, from_link = F.col("text"), number(F.regexp_extract("href", "/isbn/([0-9Xx-]+)", 1))
    thirteen, ten = _stated(text, 13), _stated(text, 10)
    before = F.get(F.split(text, "(?i)Authors?:|ISBN-?1[03]:", 2), F.lit(0))
    rows = rows.select(
        "k", "li_pos", F.coalesce(thirteen, from_link, ten).alias("isbn"), F.coalesce(thirteen, from_link).alias("isbn13"), ten.alias("isbn10"),
        F.coalesce(F.when(F.col("info").isNotNull(), squeezed(F.col("link_text"))), squeezed(before), squeezed(F.col("alt"))).alias("title"),
        _labelled(text, "Authors?", "ISBN-?1[03]:", "View This Book").alias("authors"), _link(F.col("src"), base).alias("image_url"), _link(F.col("href"), base).alias("result_url"),
    ).filter("isbn is not null")
    return _ordered(rows, key, "li_pos")


def _ordered(rows: DataFrame, key: str, at: str, number: str = "isbn") -> DataFrame:
    """The first row of each number of a page, numbered from 0."""
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy("k", number).orderBy(at))).filter("__n = 1").drop("__n")
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy(at)) - 1).drop(at).withColumnRenamed("k", key)


def detail_pages(df: DataFrame, key: str, html: str, requested: str | None = None, base: str = "https://isbnsearch.org") -> DataFrame:
    """SRC4: the one book of a page, or no row; where the page has no number of thirteen, the requested one stands in."""
    p = Pages(df, key, html)
    info = p.text(p.first(has_class("bookinfo"), "i", p.whole()), "i", "text")
    h1 = F.col("tag") == "h1"
    inner = p.first_inside(info, "i", h1, F.struct("pos", "end").alias("h")).select("k", "h")
    head = p.first(h1, "h").join(inner, "k", "left").select("k", F.coalesce("h.pos", "h_pos").alias("h_pos"), F.coalesce("h.end", "h_end").alias("h_end"))
    head = p.text(head, "h", "head").select("k", "head")
    holder = p.find(has_class("image")).select("k", F.col("pos").alias("d_pos"), F.col("end").alias("d_end"))
    img = p.inside(holder, p.find(F.col("tag") == "img"), "d").groupBy("k").agg(F.min_by(attr("src"), F.col("pos")).alias("src"))
    rows = info.join(head, "k", "left").join(img, "k", "left")
    if requested is not None:
        rows = rows.join(df.select(F.col(key).alias("k"), F.col(requested).alias("__r")), "k")
    asked = F.lit(None).cast("string") if requested is None else F.col("__r")
    text = F.col("text")
    rows = rows.select("k", "src", _stated(text, 13).alias("isbn13"), _stated(text, 10).alias("isbn10"), squeezed(F.col("head")).alias("title"), text, number(asked).alias("asked")).filter("title is not null or isbn13 is not null or isbn10 is not null")
    best = F.coalesce("isbn13", "asked", "isbn10")
    return rows.select(
        F.col("k").alias(key), F.lit(0).alias("ord"), best.alias("isbn"), "isbn13", "isbn10", "title", _labelled(text, "Authors?", "Binding:", "Publisher:", "Published:").alias("authors"), _labelled(text, "Publisher", "Published:").alias("publisher"),
        _labelled(text, "Published").alias("published"), _link(F.col("src"), base).alias("image_url"), F.concat(F.lit(f"{base}/isbn/"), best).alias("result_url"),
    )


def euro(c: Column) -> Column:
    """A French price: the first comma is the point; all but digits and points goes; empty is 0, two points are none."""
    kept = F.regexp_replace(F.regexp_replace(c, "^([^,]*),", "$1."), "[^0-9.]", "")
    return F.when(kept == "", 0.0).otherwise(F.when(kept.rlike("[0-9]"), kept.try_cast("double")))


def offer_pages(df: DataFrame, key: str, html: str, held: Pages | None = None) -> DataFrame:
    """SRC6: rows of the offer table: number, title, picture, price or an explicit refusal; the first of each number.

    ``held`` are the pages' elements where they are known already.
    """
    p = held or Pages(df, key, html)
    listed = p.first(attr("id") == "product_list", "t")
    rows = p.inside(listed, p.find(F.col("tag") == "tr"), "t").select("k", F.col("pos").alias("tr_pos"), F.col("end").alias("tr_end"))
    rows = p.text(rows, "tr", "said").withColumn("text", F.coalesce(squeezed(F.col("said")), F.lit("")))
    isbn = F.regexp_extract("text", r"\b97[89][0-9]{10}\b", 0)
    rows = rows.withColumn("isbn", F.when(isbn != "", isbn)).filter("isbn is not null")

    def part(outer: DataFrame, name: str, test: Column, into: str) -> DataFrame:
        """Text of the first such element inside ``outer``, by row."""
        e = p.first_inside(outer, name, test, F.struct("pos", "end").alias("e")).select("k", f"{name}_pos", F.col("e.pos").alias("p_pos"), F.col("e.end").alias("p_end"))
        return p.text(e, "p", into).select("k", F.col(f"{name}_pos"), into)

    td = F.col("tag") == "td"
    cell = p.first_inside(rows, "tr", td & has_class("repris"), F.struct("pos", "end").alias("c")).select("k", "tr_pos", F.col("c.pos").alias("c_pos"), F.col("c.end").alias("c_end"))
    price = cell.join(part(cell, "c", has_class("price"), "price_said"), ["k", "c_pos"]).select("k", "tr_pos", "price_said")
    img = p.first_inside(rows, "tr", (F.col("tag") == "img") & has_class("product-image-photo"), attr("src").alias("image_url"))
    for other in (price, part(rows, "tr", td & has_class("non-repris"), "refusal"), part(rows, "tr", has_class("product-item-name"), "name"), img):
        rows = rows.join(other, ["k", "tr_pos"], "left")
    text = squeezed(F.col("price_said"))
    out = rows.select(
        "k", "tr_pos", "isbn", squeezed(F.col("name")).alias("title"), "image_url", F.coalesce(euro(text), F.lit(0.0)).alias("price"), text.alias("price_text"),
        F.when(F.coalesce(squeezed(F.col("refusal")), F.col("text")).rlike("(?i)non repris"), "gibert_non_repris").otherwise("gibert_price_found").alias("status"),
    )
    return _ordered(out, key, "tr_pos")


def offer_totals(df: DataFrame, key: str, html: str, held: Pages | None = None) -> DataFrame:
    """SRC6, SRC7: totals and count that an offer page states; a row a page. ``held`` as in :func:`offer_pages`."""
    p = held or Pages(df, key, html)
    out = p.pages.distinct()

    def said(holder: DataFrame, name: str, into: str) -> DataFrame:
        return p.text(holder, name, "__s").select("k", squeezed(F.col("__s")).alias(into))

    for box, into in (("total_amount", "total_text"), ("totalTirelire", "voucher_text")):
        holder = p.first(attr("id") == box, "b")
        shown = p.first_inside(holder, "b", has_class("price"), F.struct("pos", "end").alias("e")).select("k", F.col("e.pos").alias("s_pos"), F.col("e.end").alias("s_end"))
        out = out.join(said(shown, "s", into), "k", "left")
    for test, into in ((attr("id") == "itemscount", "item_count"), (has_class("remaining-amount"), "remaining")):
        out = out.join(said(p.first(test, "e"), "e", into), "k", "left")
    return out.select(F.col("k").alias(key), F.lit(0).alias("ord"), euro(F.col("total_text")).alias("total"), "total_text", euro(F.col("voucher_text")).alias("voucher"), "voucher_text", "item_count", "remaining")


#: Attributes of a picture that may hold its address.
PICTURES = ("src", "data-src", "data-original", "data-lazy", "srcset", "data-srcset")


def catalog_pages(df: DataFrame, key: str, html: str, base: str = "https://www.abebooks.fr", cover_host: str = "pictures.abebooks.com") -> DataFrame:
    """SRC10: covers of a catalogue search page with what stands beside them; bare cover URLs only fill in.

    What stands beside a cover is inside the innermost list item, article, row or result around it, else inside the innermost
    element. A value is that of the first name that has any, and of the first such element.
    """
    p = Pages(df, key, html)
    cover = rf"(?i){re.escape(cover_host)}/isbn/([0-9Xx]{{10,13}})-[^\s\"'<>,]*"
    raw = F.flatten(F.array(*[F.transform(F.split(F.coalesce(attr(a), F.lit("")), ","), lambda x: F.split(F.trim(x), " ")[0]) for a in PICTURES]))
    covers = F.filter(raw, lambda u: u.rlike(cover))
    jpg = F.filter(covers, lambda u: u.rlike(r"(?i)\.jpe?g(\?|$)"))
    thirteen = lambda u: _thirteen(F.regexp_extract(u, cover, 1))
    imgs = p.find(F.col("tag") == "img").select("k", F.col("pos").alias("img_pos"), F.coalesce(F.get(jpg, F.lit(0)), F.get(covers, F.lit(0))).alias("url"), attr("alt").alias("alt")).filter("url is not null")
    imgs = imgs.withColumn("isbn13", thirteen(F.col("url"))).filter("isbn13 is not null")
    around = p.elements.filter(F.col("end") > F.col("pos")).select("k", "pos", "end", F.coalesce(F.col("tag").isin("li", "article", "tr") | has_class("result") | (attr("data-cy") == "listing-item"), F.lit(False)).alias("good"))
    boxes = imgs.join(around, "k", "left").filter("pos < img_pos and end > img_pos").groupBy("k", "img_pos", "url", "alt", "isbn13").agg(F.max(F.struct("good", "pos", "end")).alias("b"))
    boxes = imgs.join(boxes.select("k", "img_pos", "b"), ["k", "img_pos"], "left").select("*", F.coalesce("b.pos", F.lit(-1)).alias("box_pos"), F.coalesce("b.end", F.lit(END)).alias("box_end")).drop("b")
    boxes = p.text(boxes, "box", "said")

    def value(names: tuple[str, ...], into: str) -> DataFrame:
        rank = F.lit(None).cast("int")
        for i, n in reversed(list(enumerate(names))):
            rank = F.when(F.coalesce((attr("data-cy") == f"listing-{n}") | (attr("itemprop") == n) | has_class(n), F.lit(False)), i).otherwise(rank)
        e = p.elements.withColumn("rank", rank).filter("rank is not null").select("k", F.col("pos").alias("v_pos"), F.col("end").alias("v_end"), "rank", attr("content").alias("content"))
        e = p.text(e, "v", "v_said").withColumn("v", squeezed(F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.col("v_said")))).filter("v is not null")
        own = boxes.select("k", "box_pos", "box_end").distinct().join(e, "k").filter("v_pos > box_pos and v_pos < box_end")
        return own.groupBy("k", "box_pos").agg(F.min_by("v", F.struct("rank", "v_pos")).alias(into))

    rows = boxes
    for names, into in ((("title", "name", "result-title"), "title"), (("author", "result-author"), "author"), (("publisher", "result-publisher"), "publisher"), (("language", "inLanguage"), "language")):
        rows = rows.join(value(names, into), ["k", "box_pos"], "left")
    wanted = F.contains(F.coalesce(attr("href"), F.lit("")), F.lit("/servlet/")) | (attr("itemprop") == "url") | has_class("title")
    link = p.first_inside(boxes, "box", (F.col("tag") == "a") & F.coalesce(wanted, F.lit(False)), attr("href").alias("href"))
    rows = rows.join(link, ["k", "box_pos"], "left")
    year = lambda c: F.regexp_extract(c, r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b", 1).try_cast("int")
    shown = rows.select(
        "k", "img_pos", "isbn13", F.coalesce("title", squeezed(F.col("alt"))).alias("title"), "author", "publisher", F.coalesce(year("publisher"), year("said")).alias("year"), "language",
        F.col("url").alias("image_url"), _link(F.col("href"), base).alias("listing_url"),
    )
    bare = df.select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all(html, F.lit(cover), F.lit(0))).alias("at", "u")).filter(F.col("u").rlike(r"(?i)\.jpe?g$"))
    bare = bare.select("k", (F.col("at") + END).alias("img_pos"), thirteen(F.col("u")).alias("isbn13"), F.concat(F.lit("https://"), "u").alias("image_url")).filter("isbn13 is not null")
    return _ordered(shown.unionByName(bare, allowMissingColumns=True), key, "img_pos", "isbn13")


def _thirteen(c: Column) -> Column:
    """A number of ten or thirteen characters as thirteen digits, unchecked."""
    n = F.upper(c)
    return F.when(n.rlike("^[0-9]{13}$"), n).when(n.rlike("^[0-9]{9}[0-9X]$"), I.ten_to_thirteen(n, check=False))


# --- what needs no tree stays a column


def page_title(html: Column) -> Column:
    """Text of the first title element, white space squeezed; null without one."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "\\s+", " "))
    return F.when(t != "", t)


def page_links(html: Column) -> Column:
    """Targets of all links in order, repeats included."""
    return F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))


def host(url: Column) -> Column:
    """Host without a leading www; null for what is no URL."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", "")
