"""HTML pages as rows: tokens, elements with their extent, texts.

One pattern cuts a page into tokens, which never fails: comments, elements whose
content is raw, declarations, tags with quoted attributes, texts, in that order;
what is left open runs to the end of the page. A token's place in its page is its
position. An element reaches from its start tag to its end: the end tag of the
same name at the same level, or for list items, paragraphs, rows and cells the
next one of the same name at the same depth of lists and tables, or the end of
that list; what has none of these ends with the innermost element that ends
around it, or with the page. End tags without a start count for nothing. What is
inside an element is then a join of positions. All of it is built-in expressions and
windows; no Python runs.
"""

from __future__ import annotations

import uuid
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shared_dir

#: Elements without content; elements that a new one of the same kind closes; what these are counted in.
VOID = tuple("area base br col embed hr img input link meta source track wbr".split())
SELF_CLOSING = tuple("li p tr td th option dt dd".split())
SCOPES = tuple("ul ol table tbody dl select".split())

TOKEN = (
    r"<!--.*?(?:-->|\z)"
    r"|<(?:script|style|xmp|iframe|noembed|noframes)\b[^>]*+(?:>.*?(?:</(?:script|style|xmp|iframe|noembed|noframes)\s*+>|\z)|\z)"
    r"|<[!?][^>]*+(?:>|\z)"
    r"""|</?[a-zA-Z](?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
    r"|[^<]++|<"
)
ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?"""
END = 1 << 30


def decoded(c: Column) -> Column:
    """Character references resolved: decimal, hexadecimal, and the names of Latin-1, Greek and symbols, with or without
    their semicolon. Others stay as they are."""
    names = F.from_json(F.lit("{" + ",".join(f'"{n}":"\\u{p:04x}"' for n, p in sorted(name2codepoint.items())) + "}"), "map<string,string>")
    parts = F.regexp_extract_all(c, F.lit("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*+);?|[^&]++|&"), F.lit(0))

    def one(t: Column) -> Column:
        body = F.regexp_replace(t, "^&#?[xX]?|;$", "")
        code = F.when(t.rlike("^&#[xX]"), F.conv(body, 16, 10)).when(t.rlike("^&#"), body).cast("long")
        point = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")
        return F.when(~F.startswith(t, F.lit("&")) | (t == "&"), t).when(code.isNotNull(), point).otherwise(F.coalesce(F.try_element_at(names, F.regexp_replace(t, "^&|;$", "")), t))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _attributes(tag: Column) -> Column:
    """map of a start tag's attributes, names in lower case, the first of equal names; values decoded."""
    body = F.regexp_replace(tag, r"^<[a-zA-Z][^\s/>]*+|/?>$", "")
    names = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(2)), lambda v: decoded(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x, i: F.array_position(names, x["n"]) == i + 1)
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["n"], x["v"])))


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(k, pos, kind, tag, attrs, said) of each page: kinds start, end, text; comments, raw content and declarations go."""
    rows = pages.select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all(html, F.lit(f"(?is){TOKEN}"), F.lit(0))).alias("pos", "t"))
    tagged = F.col("t").rlike("^</?[a-zA-Z]")
    tag = F.lower(F.regexp_extract("t", r"^</?([a-zA-Z][^\s/>]*+)", 1))
    raw = F.col("t").rlike(r"(?i)^<(?:script|style|xmp|iframe|noembed|noframes)\b")
    kind = F.when(F.col("t").rlike("^<[!?]") | raw, F.lit(None)).when(tagged & F.startswith("t", F.lit("</")), "end").when(tagged, "start").otherwise("text")
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    return rows.select("k", "pos", "kind", F.when(tagged, tag).alias("tag"), F.when(F.col("kind") == "start", _attributes(F.col("t"))).alias("attrs"), F.when(F.col("kind") == "text", decoded(F.col("t"))).alias("said"), (tagged & F.col("t").rlike("/>$")).alias("closed"))


def _level(rows: DataFrame, keys: list[str], up: Column, down: Column, name: str) -> DataFrame:
    """Adds the number of open ones after each row; an end without a start leaves it at 0."""
    w = Window.partitionBy(*keys).orderBy("pos")
    sum_ = F.sum(F.when(up, 1).when(down, -1).otherwise(0)).over(w)
    rows = rows.withColumn("__s", sum_)
    least = F.least(F.lit(0), F.min("__s").over(w))
    return rows.withColumn(name, F.col("__s") - least).withColumn("__least", least).drop("__s")


class Pages:
    """Elements (k, pos, end, tag, attrs, classes) and texts (k, pos, said) of pages, stored once."""

    def __init__(self, pages: DataFrame, key: str, html: str) -> None:
        held = self._stored(tokens(pages, key, html))
        self.key, self.pages = key, pages.select(F.col(key).alias("k"))
        self.texts = held.filter("kind = 'text'").select("k", "pos", "said")
        tags = held.filter("kind <> 'text'")
        start, end = F.col("kind") == "start", F.col("kind") == "end"
        alone = F.col("tag").isin(*VOID) | F.col("closed")
        each = Window.partitionBy("k", "tag", "at").orderBy("pos")
        # ordinary elements: the next row of the same name and level is the end tag; stray end tags do not count
        plain = _level(tags.filter(~alone & ~F.col("tag").isin(*SELF_CLOSING)), ["k", "tag"], start, end, "open")
        stray = end & (F.col("__least") < F.coalesce(F.lag("__least").over(Window.partitionBy("k", "tag").orderBy("pos")), F.lit(0)))
        plain = plain.withColumn("stray", stray).filter("not stray").withColumn("at", F.when(start, F.col("open")).otherwise(F.col("open") + 1))
        plain = plain.withColumn("end", F.lead("pos").over(each)).filter(start)
        # items: the next row of the same name at the same depth of lists, or the end of that list
        scope = F.col("tag").isin(*SCOPES)
        deep = _level(tags.filter(F.col("tag").isin(*SCOPES, *SELF_CLOSING) & ~F.col("closed")), ["k"], scope & start, scope & end, "open")
        for_all = F.explode(F.array(*map(F.lit, SELF_CLOSING)))
        leave = deep.filter(scope & end).withColumn("tag", for_all).withColumn("at", F.col("open") + 1)
        item = deep.filter(~scope).withColumn("at", F.col("open")).unionByName(leave)
        item = item.withColumn("end", F.lead("pos").over(each)).filter(start & F.col("attrs").isNotNull())
        columns = ["k", "pos", "tag", "attrs", "end"]
        void = tags.filter(start & alone).withColumn("end", F.col("pos"))
        known = plain.select(*columns).unionByName(item.select(*columns)).unionByName(void.select(*columns))
        known = self._stored(known)
        # what has no end of its own ends with the innermost element around it that has
        around = known.filter("end > pos").select("k", F.col("pos").alias("a"), F.col("end").alias("b"))
        loose = known.filter("end is null").drop("end").join(around, "k", "left").groupBy("k", "pos").agg(F.min(F.when((F.col("a") < F.col("pos")) & (F.col("b") > F.col("pos")), F.col("b"))).alias("last"))
        all_ = known.join(loose, ["k", "pos"], "left").withColumn("end", F.coalesce("end", "last", F.lit(END))).drop("last")
        classes = F.filter(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), lambda c: c != "")
        self.elements = self._stored(all_.withColumn("classes", classes))

    @staticmethod
    def _stored(df: DataFrame) -> DataFrame:
        path = f"{shared_dir(df.sparkSession)}/folioforge-html-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def find(self, test: Column) -> DataFrame:
        """Elements for which ``test`` holds."""
        return self.elements.filter(F.coalesce(test, F.lit(False)))

    def whole(self) -> DataFrame:
        """(k, pos, end): each page as an element around all others."""
        return self.pages.distinct().select("k", F.lit(-1).alias("pos"), F.lit(END).alias("end"))

    def first(self, test: Column, name: str, default: DataFrame | None = None) -> DataFrame:
        """(k, name_pos, name_end): each page's first such element, or the one of ``default``."""
        found = self.find(test).groupBy("k").agg(F.min_by(F.struct("pos", "end"), "pos").alias("e")).select("k", F.col("e.pos").alias(f"{name}_pos"), F.col("e.end").alias(f"{name}_end"))
        if default is None:
            return found
        base = default.select("k", "pos", "end").join(found, "k", "left")
        return base.select("k", F.coalesce(f"{name}_pos", "pos").alias(f"{name}_pos"), F.coalesce(f"{name}_end", "end").alias(f"{name}_end"))

    def inside(self, outer: DataFrame, inner: DataFrame, name: str) -> DataFrame:
        """Pairs of ``outer`` rows (k, name_pos, name_end, ...) and ``inner`` rows that stand inside them."""
        return outer.join(inner, "k").filter((F.col("pos") > F.col(f"{name}_pos")) & (F.col("pos") < F.col(f"{name}_end")))

    def text(self, outer: DataFrame, name: str, into: str) -> DataFrame:
        """``outer`` with all text inside each, '' for none."""
        said = self.inside(outer.select("k", f"{name}_pos", f"{name}_end").distinct(), self.texts, name)
        joined = said.groupBy("k", f"{name}_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "").alias(into))
        return outer.join(joined, ["k", f"{name}_pos"], "left").withColumn(into, F.coalesce(into, F.lit("")))

    def first_inside(self, outer: DataFrame, name: str, test: Column, *take: Column) -> DataFrame:
        """(k, name_pos, the columns taken): the first such element inside each of ``outer``."""
        pairs = self.inside(outer.select("k", f"{name}_pos", f"{name}_end").distinct(), self.find(test), name)
        taken = [F.min_by(c, F.col("pos")).alias(f"__t{i}") for i, c in enumerate(take)]
        names = [c._jc.toString().split(" AS ")[-1].strip("`") for c in take]
        return pairs.groupBy("k", f"{name}_pos").agg(*taken).select("k", f"{name}_pos", *[F.col(f"__t{i}").alias(n) for i, n in enumerate(names)])


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has_class(name: str) -> Column:
    return F.array_contains("classes", name)


def squeezed(c: Column) -> Column:
    """White space squeezed; null for nothing."""
    t = F.trim(F.regexp_replace(c, r"[\s \u0085  -     　\x1C-\x1F]+", " "))
    return F.when(t != "", t)


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, href, text): every link of a page in order. A link ends where the next begins."""
    p = Pages(pages, key, html)
    a = p.find((F.col("tag") == "a") & attr("href").isNotNull()).select("k", F.col("pos").alias("a_pos"), F.col("end"), attr("href").alias("href"))
    after = F.lead("a_pos").over(Window.partitionBy("k").orderBy("a_pos"))
    a = a.withColumn("a_end", F.least(F.col("end"), F.coalesce(after, F.lit(END)))).drop("end")
    out = p.text(a, "a", "said").withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy("a_pos")) - 1)
    return out.select(F.col("k").alias(key), "ord", "href", squeezed(F.col("said")).alias("text"))


def blocks(pages: DataFrame, key: str, html: str, tag: str = "p") -> DataFrame:
    """(key, ord, text): the texts of a page's elements ``tag`` in order; empty ones are left out but counted."""
    p = Pages(pages, key, html)
    e = p.find(F.col("tag") == tag).select("k", F.col("pos").alias("e_pos"), F.col("end").alias("e_end"))
    out = p.text(e, "e", "said").withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy("e_pos")) - 1)
    return out.select(F.col("k").alias(key), "ord", squeezed(F.col("said")).alias("text")).filter("text is not null")


def outline(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, heading, language, elements, images): one row a page; what a page lacks is null or 0."""
    p = Pages(pages, key, html)
    count = p.elements.groupBy("k").agg(F.count("*").alias("elements"), F.count_if(F.col("tag") == "img").alias("images"), F.min_by(attr("lang"), F.when(F.col("tag") == "html", F.col("pos"))).alias("language"))
    said = lambda tag, name: p.text(p.first(F.col("tag") == tag, "e"), "e", name).select("k", squeezed(F.col(name)).alias(name))
    out = p.pages.distinct().join(count, "k", "left").join(said("title", "title"), "k", "left").join(said("h1", "heading"), "k", "left")
    return out.select(F.col("k").alias(key), "title", "heading", "language", F.coalesce("elements", F.lit(0)).alias("elements"), F.coalesce("images", F.lit(0)).alias("images"))
