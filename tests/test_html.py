"""HTML as rows: broken pages, references, extents; tag soup against the standard library's tokenizer."""

from __future__ import annotations

import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from folioforge.sources import html, pages


def frame(spark, *said):
    return spark.createDataFrame(list(enumerate(said)), "id long, h string")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_pages_that_are_broken(spark):
    df = frame(spark, None, "", "plain", "<", "<p>broken <b", "<!-- never closed <a href=x>", "<script>var a = '<a href=z>';", "a < b > c", "</div></p>", "<p/><br/>x", "<a href='unclosed>text")
    got = Counter((r.k, r.kind, r.tag, r.said) for r in html.tokens(df, "id", "h").collect())
    assert got == Counter([
        (2, "text", None, "plain"), (3, "text", None, "<"), (4, "start", "p", None), (4, "text", None, "broken "), (4, "start", "b", None), (7, "text", None, "a "), (7, "text", None, "<"), (7, "text", None, " b > c"),
        (8, "end", "div", None), (8, "end", "p", None), (9, "start", "p", None), (9, "start", "br", None), (9, "text", None, "x"), (10, "start", "a", None),
    ])
    assert bag(html.links(df, "id", "h")) == Counter([(10, 0, "unclosed>text", None)])
    assert html.outline(df, "id", "h").count() == 11


def test_references_and_attributes(spark):
    df = frame(spark, '<a HREF="/x?a=1&amp;b=2" href=no class=\'q  r\' data-x="href=y">A &amp;amp; B&#233;&eacute &#x1F600; &nope; &#0; &#xD800; &</a>')
    (r,) = html.links(df, "id", "h").collect()
    assert (r.href, r.text) == ("/x?a=1&b=2", "A &amp; Béé 😀 &nope; � � &")
    (e,) = html.Pages(df, "id", "h").elements.collect()
    assert e.classes == ["q", "r"] and e.attrs["data-x"] == "href=y"


def test_extents(spark):
    df = frame(spark, "<div><b>one<p>two<p>three</div>four", "<ul><li>1<ul><li>in</ul>more<li>2</ul>out", "<b><i>x</b>y</i>z", "<div>a</div></div><div>b</div>", "<p>x<span>y</p>z", "<table><tr><td>1<td>2<tr><td>3</table>t")
    p = html.Pages(df, "id", "h")
    e = p.elements.selectExpr("k", "tag", "pos AS e_pos", "end AS e_end")
    got = Counter((r.k, r.tag, r.said) for r in p.text(e, "e", "said").collect())
    assert got == Counter([
        (0, "div", "onetwothree"), (0, "b", "onetwothree"), (0, "p", "two"), (0, "p", "three"), (1, "ul", "1inmore2"), (1, "li", "1inmore"), (1, "ul", "in"), (1, "li", "in"), (1, "li", "2"), (2, "b", "x"), (2, "i", "xy"),
        (3, "div", "a"), (3, "div", "b"), (4, "p", "xy"), (4, "span", "y"), (5, "table", "123"), (5, "tr", "12"), (5, "tr", "3"), (5, "td", "1"), (5, "td", "2"), (5, "td", "3"),
    ])


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.text = [], ""

    def handle_starttag(self, tag, attrs):
        self.tags.append(("start", tag))

    def handle_endtag(self, tag):
        self.tags.append(("end", tag))

    def handle_startendtag(self, tag, attrs):
        self.tags.append(("start", tag))

    def handle_data(self, data):
        self.text += data


def test_soup_against_the_standard_library(spark):
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<b>", "</b>", "<li class='x'>", "</li>", "<ul>", "</ul>", "<br/>", "<img src=a>", "<!-- c <p> -->", "<script>if (a<b) x</script>", "<!DOCTYPE html>", "word ", "1 &lt; 2 ", "&eacute;", "<div id=\"q>r\">", "</div>", "\n"]
    soups = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(300)]
    seen = {}
    for r in html.tokens(frame(spark, *soups), "id", "h").orderBy("k", "pos").collect():
        tags, text = seen.setdefault(r.k, ([], []))
        (text.append(r.said) if r.kind == "text" else tags.append((r.kind, r.tag)))
    for i, soup in enumerate(soups):
        plain = Plain()
        plain.feed(soup.replace("<script>if (a<b) x</script>", ""))
        plain.close()
        tags, text = seen.get(i, ([], []))
        assert tags == plain.tags and "".join(text) == plain.text, soup


def test_rules_know_tables_and_covers(spark):
    shop = (
        '<div class="result"><img data-src="https://pictures.abebooks.com/isbn/2070368226-us.png, https://pictures.abebooks.com/isbn/9782070368228-us.jpg" alt="Alt"><span itemprop="author" content="C. D."></span><span class="publisher">Gallimard, 1954</span></div>'
        '<p><img src="https://pictures.abebooks.com/isbn/9782092553343-fr.jpg" alt="Lone"></p><img src="x.png">'
    )
    got = {r.isbn13: (r.title, r.author, r.publisher, r.year, r.image_url[-10:]) for r in pages.catalog_pages(frame(spark, shop), "id", "h").collect()}
    assert got == {"9782070368228": ("Alt", "C. D.", "Gallimard, 1954", 1954, "228-us.jpg"), "9782092553343": ("Lone", None, None, None, "343-fr.jpg")}
    offers = '<table id="product_list"><tr><td>9782092553343 9782092553343<td class="repris">?<tr><td>no number</table><tr><td>9782070368228</td></tr>'
    assert [(r.isbn, r.title, r.price, r.status) for r in pages.offer_pages(frame(spark, offers), "id", "h").collect()] == [("9782092553343", None, 0.0, "gibert_price_found")]
    assert pages.search_pages(frame(spark, None, "<p>none</p>"), "id", "h").count() == 0 and pages.detail_pages(frame(spark, None, "<p>none</p>"), "id", "h").count() == 0


@pytest.mark.parametrize("rule", ["search_pages", "detail_pages", "offer_pages", "offer_totals", "catalog_pages"])
def test_no_python_in_the_plan(spark, rule):
    plan = getattr(pages, rule)(frame(spark, "<p>x</p>"), "id", "h")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
