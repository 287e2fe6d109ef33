"""Registered queries of the sources: recorded responses made from the driver's tables, read back by the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import isbn
from ..sources import payloads
from .registry import query
from .tables import read, spread
from .text_queries import _ISBN


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the columns that all bodies are made of."""
    return spread(read(spark, d, "part"), "p_partkey").select(F.col("p_partkey").cast("long").alias("part"), "p_name", "p_brand", "p_size", F.pmod(F.col("p_partkey"), F.lit(6)).alias("m"), isbn.synthetic(F.col("p_partkey")).alias("isbn"))


def js(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def joined(*c: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])


_M = "p_partkey % 6"


@query(f"""SELECT p_partkey AS part, CAST(p_partkey AS VARCHAR) AS ads_id, p_name AS title, CAST(CASE {_M} WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.5 END AS DECIMAL(10,2)) AS price,
  CASE WHEN {_M} IN (0, 2) THEN 2 WHEN {_M} = 1 THEN 1 ELSE 0 END AS pictures, CASE WHEN {_M} IN (0, 2) THEN 'a' WHEN {_M} = 1 THEN 'first' END AS first_picture, CASE WHEN {_M} = 0 THEN 'Lyon' WHEN {_M} = 1 THEN 'Paris' END AS location FROM part WHERE {_M} < 4""")
def listing_payloads(spark: SparkSession, d: str) -> DataFrame:
    """SRC1, PR1, JS2: bare arrays, items and data envelopes, bodies without any, pictures with blanks."""
    p, m = parts(spark, d), F.col("m")
    price = F.when(m == 0, joined(F.col("p_size").cast("string"), " €")).when(m == 1, joined(F.col("p_size").cast("string"), ",50 EUR")).when(m == 2, "prix à voir")
    item = js(id=F.col("part").cast("string"), title=F.col("p_name"), price=price, pictureUrls=F.when(m.isin(0, 2), F.array(F.lit(" "), F.lit("a"), F.lit("b"))), firstPictureUrl=F.when(m == 1, "first"), tags=F.when(m == 0, F.array(F.lit("x"), F.lit("À Lyon"))), locationText=F.when(m == 1, "Paris"))
    body = F.when(m == 0, joined("[", item, "]")).when(m == 1, joined('{"items":[', item, "]}")).when(m.isin(2, 3), joined('{"data":[', item, "]}")).when(m == 4, "{}").otherwise('[{"title":"no id"}]')
    rows = payloads.listings(p.select("part", body.alias("body")), "part")
    return rows.select("part", "ads_id", "title", F.col("price_amount").alias("price"), F.size("picture_urls").alias("pictures"), F.col("first_picture_url").alias("first_picture"), F.col("location_text").alias("location"))


@query(f"SELECT p_partkey AS part, 'L' || p_partkey || ',' || 'M' || p_partkey AS ids, CASE {_M} WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' WHEN 2 THEN 'r3' WHEN 3 THEN 'r4' END AS run_id, CASE WHEN {_M} = 3 THEN 'd4' WHEN {_M} = 2 THEN 'd3' END AS dataset_id FROM part")
def payload_run_info(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: ids and run facts under any of their names."""
    m = F.col("m")
    ids = [F.when(m % 3 == i, joined(f'{{"{a}":"L', F.col("part").cast("string"), f'"}},{{"{b}":"M', F.col("part").cast("string"), f'"}},{{"{a}":"L', F.col("part").cast("string"), '"}')) for i, (a, b) in enumerate((("id", "adsId"), ("ads_id", "listId"), ("listId", "id")))]
    run = F.when(m == 0, '"apifyRunId":"r1",').when(m == 1, '"actorRunId":"","runId":"r2",').when(m == 2, '"runId":"r3","defaultDatasetId":"d3",').when(m == 3, '"resource":{"id":"r4","defaultDatasetId":"d4"},').otherwise("")
    body = joined("{", run, '"items":[', F.coalesce(*ids), "]}")
    rows = parts(spark, d).select("part", body.alias("body")).withColumn("run", payloads.run_info(F.col("body")))
    return rows.select("part", F.array_join(payloads.listing_ids(F.col("body")), ",").alias("ids"), "run.run_id", "run.dataset_id")


@query(f"""SELECT p_partkey AS part, {_ISBN} AS isbn, CASE {_M} WHEN 0 THEN 'offer' WHEN 1 THEN 'no_offer' WHEN 2 THEN 'no_offer' WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' ELSE 'offer' END AS status,
  CAST(CASE WHEN {_M} IN (0, 5) THEN p_size + 0.25 WHEN {_M} IN (1, 2) THEN 0 END AS DECIMAL(10,2)) AS price, CASE {_M} WHEN 3 THEN 'boom' WHEN 4 THEN 'provider returned HTTP 429' END AS error, CASE WHEN {_M} NOT IN (3, 4) THEN 'small' END AS image FROM part""")
def provider_a_responses(spark: SparkSession, d: str) -> DataFrame:
    """SRC8: offers, answers without offer, failures; results in the first execute step or beside it."""
    m = F.col("m")
    price = F.when(m == 2, "0").otherwise(joined(F.col("p_size").cast("string"), ",25"))
    data = F.struct(F.when(m.isin(0, 2, 5), "offer").otherwise("no_offer").alias("status"), price.alias("price"), F.struct(F.col("p_name").alias("title"), F.lit("").alias("full_size_image_url"), F.lit("small").alias("image_url")).alias("product"))
    entry = js(code=joined(F.substring("isbn", 1, 3), "-", F.substring("isbn", 4, 10)), ok=~m.isin(3, 4), status=F.when(m == 4, 429).otherwise(200), error=F.when(m == 3, "boom"), data=F.when(~m.isin(3, 4), data))
    result = joined('{"results":[', entry, "]}")
    steps = joined('{"result":{"browser_data":{"js_scenario":{"steps":[{"action":"wait"},{"action":"execute","result":', result, '},{"action":"execute","result":{"results":[]}}]}}}}')
    beside = joined('{"result":{"browser_data":{"javascript_evaluation_result":', result, "}}}")
    rows = payloads.offers_a(parts(spark, d).select("part", F.when(m == 5, beside).otherwise(steps).alias("body")), "part")
    return rows.select("part", "isbn", "status", "price", "error", F.col("image_url").alias("image"))


@query(f"SELECT p_partkey AS part, 'ad' || p_partkey AS ads_id, {_ISBN} AS isbn, p_name AS title, CAST(p_size AS DOUBLE) + 0.5 AS price, 'u' AS url FROM part")
def single_result_webhooks(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: each value under each of its names."""
    m, ad, money = F.col("m"), joined("ad", F.col("part").cast("string")), joined(F.col("p_size").cast("string"), ",5 €")
    bodies = [js(adsId=ad, isbn=F.col("isbn"), title=F.col("p_name"), price=money, finalUrl=F.lit("u")), js(ads_id=ad, isbn13=F.col("isbn"), momoxTitle=F.col("p_name"), momoxPrice=money, final_url=F.lit("u")), js(adsId=F.lit(""), adId=ad, code=F.col("isbn"), product=F.struct(F.col("p_name").alias("title")), offer=F.struct(money.alias("price")), url=F.lit("u"))]
    body = F.coalesce(*[F.when(m % 3 == i, b) for i, b in enumerate(bodies)])
    return parts(spark, d).select("part", payloads.offer_identity(body).alias("o")).select("part", "o.*")


@query(f"SELECT p_partkey AS part, ord, {_ISBN} AS isbn13, CASE WHEN ord = 0 THEN p_name || ': ' || p_brand ELSE p_name END AS title, CASE WHEN ord = 0 THEN 'A, B' ELSE '' END AS authors, CASE WHEN ord = 0 THEN 'fr' END AS lang FROM part, (SELECT unnest([0, 1]) AS ord)")
def volume_responses(spark: SparkSession, d: str) -> DataFrame:
    """SRC12: identifiers by type, title with and without subtitle, authors or none."""
    number = F.array(F.struct(F.lit("OTHER").alias("type"), F.lit("x").alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier")))
    full = js(volumeInfo=F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("subtitle"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.lit("fr").alias("language"), number.alias("industryIdentifiers")))
    bare = js(volumeInfo=F.struct(F.col("p_name").alias("title"), number.alias("industryIdentifiers")))
    rows = payloads.volumes(parts(spark, d).select("part", joined('{"items":[', full, ",", bare, "]}").alias("body")), "part")
    return rows.select("part", "ord", "isbn13", "title", F.coalesce("authors", F.lit("")).alias("authors"), F.col("language").alias("lang"))


@query("SELECT user_id, count(*) FILTER (n < b) AS items, min(event_id) FILTER (n < b) AS first_item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, coalesce(min(CASE WHEN event_type = 'error' THEN nr END) OVER (PARTITION BY user_id), 1000000) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events)) GROUP BY 1 HAVING count(*) FILTER (n < b) > 0")
def lookup_items_until_blocked(spark: SparkSession, d: str) -> DataFrame:
    """SRC13: items of a run up to the first that says blocked (the cap of 1000 is the feature and not reached)."""
    ev = read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("blocked"), F.col("user_id"), F.col("event_id").alias("item"))
    rows = payloads.lookup_dataset(ev, "user_id", 1_000_000)
    return rows.select("user_id", F.size("items").cast("long").alias("items"), F.get("items", F.lit(0)).alias("first_item"))


@query("SELECT count(DISTINCT l_partkey) FILTER (l_partkey % 3 = 0) AS answered, count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) AS open, true AS chunks_fit FROM lineitem")
def cached_lookups(spark: SparkSession, d: str) -> DataFrame:
    """SRC14, QS14: requests that a recorded response answers, and the rest in chunks of ten."""
    asked = read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"))
    known = read(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("part"), "p_name")
    answered, left = payloads.cached_first(asked, known, "part")
    sizes = left.groupBy("chunk").count().agg(F.max("count").alias("most"), F.sum("count").alias("open"))
    return answered.agg(F.count("*").alias("answered")).join(F.broadcast(sizes), F.lit(True)).select("answered", "open", (F.col("most") <= 10).alias("chunks_fit"))


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN 'first' ELSE 'second' END AS source_name, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -p_size END AS v FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def source_failover(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: the second source answers what the first has not."""
    from ..operators import relational

    p = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_size").alias("v"))
    return relational.first_source((p.filter("part % 2 = 0"), "first"), (p.filter("part % 3 = 0").withColumn("v", -F.col("v")), "second"), keys=["part"]).select("part", "source_name", "v")


@query("SELECT p_partkey AS part, ord, title, author, CAST(x1 AS DOUBLE) AS x1 FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(title), lower(coalesce(author, '')) ORDER BY ord) AS n FROM (SELECT p_partkey, 0 AS ord, p_name AS title, 'Ann' AS author, 1.0 AS x1 FROM part UNION ALL SELECT p_partkey, 1, p_name, 'ann', 0.5 FROM part UNION ALL SELECT p_partkey, 3, p_brand, NULL, 0.0 FROM part)) WHERE n = 1")
def detected_book_responses(spark: SparkSession, d: str) -> DataFrame:
    """SRC16: trimmed, boxes clamped, equal books once, books without title left out."""
    box = lambda *v: F.array(*[F.lit(x) for x in v])
    books = [js(title=joined(" ", F.col("p_name"), " "), author=F.lit("Ann"), bbox=box(-0.5, 0.0, 1.5, 1.0)), js(title=F.upper("p_name"), author=F.lit("ann"), bbox=box(0.0, 0.0, 0.5, 1.0)), js(author=F.lit("nobody")), js(title=F.lit(""), possible_corrected_title=F.col("p_brand"), bbox=box(0.0, 0.0, -1.0, 1.0))]
    body = joined('{"books":[', *[x for b in books for x in (b, ",")][:-1], "]}")
    rows = payloads.detected_books(parts(spark, d).select("part", body.alias("body")), "part")
    return rows.select("part", "ord", F.coalesce("title", "possible_corrected_title").alias("title"), "author", F.get("bbox", F.lit(2)).alias("x1"))


@query(f"SELECT p_partkey AS part, p_partkey % 7 AS idx, p_name AS title, {_ISBN} AS isbn13, p_partkey % 2 = 1 AS repaired FROM part")
def model_readings(spark: SparkSession, d: str) -> DataFrame:
    """SRC17, SRC18: second readings of crops by index, suggested numbers with a check digit set right."""
    p = parts(spark, d)
    reads = payloads.crop_reads(p.select("part", joined('{"books":[', js(index=(F.col("part") % 7).cast("int"), title=F.col("p_name")), "]}").alias("body")), "part").select("part", F.col("index").alias("idx"), "title")
    wrong = joined(F.substring("isbn", 1, 12), F.pmod(F.substring("isbn", 13, 1).cast("int") + 3, F.lit(10)).cast("string"))
    said = js(isbn=F.when(F.col("part") % 2 == 1, wrong).otherwise(F.col("isbn")), title=F.col("p_name"), confidence=F.lit(0.5))
    found = payloads.suggested_numbers(p.select("part", joined('{"candidates":[', said, "]}").alias("body")), "part").select("part", "isbn13", "repaired")
    return reads.join(found, "part").select("part", "idx", "title", "isbn13", "repaired")


@query(f"""SELECT p_partkey AS part, {_ISBN} AS isbn13, CASE p_partkey % 3 WHEN 0 THEN 'lens_url' WHEN 1 THEN 'amazon_dp' ELSE 'lens_title' END AS via, CASE p_partkey % 3 WHEN 0 THEN 'books.test' WHEN 1 THEN 'shop.test' ELSE 'news.test' END AS source, CASE WHEN p_partkey % 3 = 2 THEN 'exact' ELSE 'visual' END AS match_type FROM part
  UNION ALL SELECT p_partkey, '9780000000002', 'lens_ai_summary', 'ai_summary', 'ai_summary' FROM part WHERE p_partkey <> 0""")
def visual_search_numbers(spark: SparkSession, d: str) -> DataFrame:
    """SRC19, IS9, CLS31: numbers of three match lists and the summary, noise left out, the first finding of a number kept."""
    m, n = F.pmod(F.col("part"), F.lit(3)), F.col("isbn")
    of = lambda link, title: F.struct(link.alias("link"), title.alias("title"), F.lit("s").alias("source"))
    noise = of(joined("https://www.google.com/search?q=", n), joined("nothing"))
    visual = F.when(m == 0, F.array(noise, of(joined("https://www.books.test/p/", n), F.lit("t")))).when(m == 1, F.array(of(joined("https://shop.test/dp/", isbn.thirteen_to_ten(n)), joined("x ", n)))).otherwise(F.array(noise))
    exact = F.when(m == 2, F.array(of(F.lit("https://news.test/a"), joined("livre ", n))))
    body = js(visualMatches=visual, exactMatches=exact, aiSummary=joined("voir 978-0-00-000000-2 et ", n))
    rows = payloads.matched_numbers(payloads.visual_matches(parts(spark, d).select("part", body.alias("body")), "part"), "part")
    return rows.select("part", "isbn13", "via", "source", "match_type")


@query(f"SELECT p_partkey AS part, CAST(CASE {_M} WHEN 0 THEN 1.5 WHEN 1 THEN 0.25 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS DOUBLE) AS cost, 'q' AS request_id, CASE WHEN {_M} < 3 THEN 200 ELSE 429 END AS code, {_M} < 3 AS success FROM part")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    """SRC20, SRC21: the first cost that is a number of 0 or more, request facts under their names."""
    m = F.col("m")
    body = F.when(m == 0, '{"usageTotalUsd":"x","usageUsd":1.5}').when(m == 1, '{"usageTotalUsd":-1,"stats":{"usageTotalUsd":0.25}}').when(m == 2, '{"usage":{"usd":2}}').when(m == 3, '{"usageUsd":0,"stats":{"usageUsd":9}}').otherwise("{}")
    facts = payloads.scrape_facts(F.when(m < 3, '{"context":{"uuid":"q"},"result":{"status_code":200,"success":true}}').otherwise('{"request_id":"q","status_code":"429"}'))
    return parts(spark, d).select("part", payloads.run_cost(body).cast("double").alias("cost"), facts.alias("f")).select("part", "cost", "f.request_id", F.col("f.status_code").alias("code"), "f.success")


@query("SELECT l_partkey AS part, min(l_linenumber) AS try_no FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity * 100 >= 2000 GROUP BY 1")
def probed_covers(spark: SparkSession, d: str) -> DataFrame:
    """SRC11: of a number's probes the first image of enough bytes."""
    li = read(spark, d, "lineitem")
    probes = li.select(F.col("l_partkey").alias("isbn"), F.col("l_linenumber").alias("try_no"), F.lit(200).alias("status"), F.when(F.col("l_returnflag") != "R", "image/jpeg").otherwise("text/html").alias("content_type"), (F.col("l_quantity") * 100).alias("bytes"))
    return payloads.probe_covers(probes).select(F.col("isbn").alias("part"), "try_no")


@query("SELECT p_partkey AS part, p_size, CAST(NULL AS VARCHAR) AS review_note, p_name LIKE 'a%' AS named FROM part")
def optional_columns(spark: SparkSession, d: str) -> DataFrame:
    """SRC23, SRC24, PRD2: a column that the table lacks is null."""
    p = payloads.with_optional(read(spark, d, "part"), {"p_size": "int", "review_note": "string"})
    return p.select(F.col("p_partkey").alias("part"), "p_size", "review_note", F.col("p_name").like("a%").alias("named"))


# --- pages


@query(f"SELECT p_partkey AS part, {_ISBN} AS isbn, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'Ann Bee' END AS authors, CASE WHEN p_partkey % 3 = 0 THEN 'https://isbnsearch.org/isbn/' || {_ISBN} END AS result_url FROM part")
def search_result_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC3: list items that name a number, the first of each; numbers from a label or the link."""
    from ..sources import pages

    m, n = F.pmod(F.col("part"), F.lit(3)), F.col("isbn")
    full = joined('<li><div class="bookinfo"><h2><a href="/isbn/', n, '">', F.col("p_name"), "</a></h2><p>Author: Ann Bee</p><p>ISBN-13: ", n, "</p></div></li>")
    plain = joined("<li>", F.col("p_name"), " ISBN-13: ", n, "</li>")
    bare = joined("<li>ISBN-13: ", n, "</li>")
    page = joined('<html><body><ul id="searchresults"><li>nothing here</li>', F.when(m == 0, full).when(m == 1, plain).otherwise(bare), "<li>again ISBN-13: ", n, "</li></ul></body></html>")
    return pages.search_pages(parts(spark, d).select("part", page.alias("html")), "part", "html").select("part", "isbn", "title", "authors", "result_url")


@query(f"SELECT p_partkey AS part, {_ISBN} AS isbn, p_name AS title, 'Ann Bee' AS authors, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS publisher, CASE WHEN p_partkey % 2 = 0 THEN '2011' END AS published FROM part WHERE p_partkey % 5 <> 4")
def detail_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC4: the one book of a page; pages without any give no row."""
    from ..sources import pages

    n = F.col("isbn")
    more = F.when(F.col("part") % 2 == 0, joined("<p>Publisher: ", F.col("p_brand"), "</p><p>Published: 2011</p>")).otherwise("")
    page = F.when(F.col("part") % 5 == 4, "<html><body><p>Not found</p></body></html>").otherwise(joined('<html><body><div class="bookinfo"><h1>', F.col("p_name"), "</h1><p>ISBN-13: ", n, "</p><p>Author: Ann Bee</p>", more, "</div></body></html>"))
    return pages.detail_pages(parts(spark, d).select("part", page.alias("html")), "part", "html").select("part", "isbn", "title", "authors", "publisher", "published")


_OFFER_PRICE = "CAST(CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_size + 0.5 END AS DOUBLE)"


@query(f"SELECT p_partkey AS part, {_ISBN} AS isbn, p_name AS title, {_OFFER_PRICE} AS price, CASE WHEN p_partkey % 3 = 0 THEN 'gibert_non_repris' ELSE 'gibert_price_found' END AS status, CAST(p_size + 0.5 AS DOUBLE) AS total, CAST(2.25 AS DOUBLE) AS voucher, '1' AS item_count FROM part")
def provider_b_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC6, SRC7: rows of the offer table with price or refusal, and the totals that the page states."""
    from ..sources import pages

    money = joined(F.col("p_size").cast("string"), ",50 €")
    cell = F.when(F.col("part") % 3 == 0, '<td class="non-repris">Produit non repris</td>').otherwise(joined('<td class="repris"><span class="price">', money, "</span></td>"))
    row = joined("<tr><td>", F.col("isbn"), '</td> <td class="product-item-name">', F.col("p_name"), "</td> ", cell, "</tr>")
    page = joined('<html><body><table id="product_list"><tr><th>x</th></tr>', row, row, '</table><div id="total_amount"><span class="price">', money, '</span></div><div id="totalTirelire"><span class="price">2,25 €</span></div><span id="itemscount">1</span></body></html>')
    p = parts(spark, d).select("part", page.alias("html"))
    held = pages.Pages(p, "part", "html")
    rows = pages.offer_pages(p, "part", "html", held).select("part", "isbn", "title", "price", "status")
    return rows.join(pages.offer_totals(p, "part", "html", held).select("part", "total", "voucher", "item_count"), "part")


@query(f"SELECT p_partkey AS part, {_ISBN} AS isbn13 FROM part WHERE p_partkey % 4 <> 3")
def catalogue_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC10: covers of a catalogue page with thirteen or ten characters, in any image attribute."""
    from ..sources import pages

    n, m = F.col("isbn"), F.pmod(F.col("part"), F.lit(4))
    url = joined("https://pictures.abebooks.com/isbn/", F.when(m == 1, isbn.thirteen_to_ten(n)).otherwise(n), "-us-300.jpg")
    img = F.when(m == 2, joined('<img srcset="', url, ' 1x, https://x.test/a.jpg 2x">')).when(m == 3, '<img src="https://x.test/logo.png">').otherwise(joined('<img src="', url, '">'))
    page = joined("<html><body><ul><li>", img, '<span data-cy="listing-title">', F.col("p_name"), "</span></li></ul></body></html>")
    return pages.catalog_pages(parts(spark, d).select("part", page.alias("html")), "part", "html").select("part", "isbn13")


@query(f"SELECT p_partkey AS part, {_ISBN} AS isbn, CAST(CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.95 END AS DOUBLE) AS score FROM part")
def scored_detail_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC5, SIM3: detail pages scored against what was asked: title and author, title with another author, title alone."""
    from ..sources import pages
    from . import pipelines

    name = joined("grand livre numero", F.col("part").cast("string"))
    page = joined('<html><body><div class="bookinfo"><h1>', name, "</h1><p>ISBN-13: ", F.col("isbn"), "</p><p>Author: Ann Bee</p></div></body></html>")
    p = parts(spark, d).select("part", page.alias("html"), name.alias("asked_title"), F.when(F.col("part") % 3 == 0, "Ann Bee").when(F.col("part") % 3 == 1, "Zoe Cay").alias("asked_author"))
    rows = pages.detail_pages(p, "part", "html")
    return pipelines.scored_pages(rows, p.select("part", "asked_title", "asked_author"), "part", 0.85, 0.15).select("part", "isbn", "score")


@query("""WITH e AS (SELECT user_id % 40 AS batch, event_id, value, event_type, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS pos FROM events),
b AS (SELECT batch, min(pos) AS stop FROM e WHERE event_type = 'error' AND value < 5 GROUP BY 1)
SELECT CAST(batch AS VARCHAR) AS batch, CAST(pos AS INT) AS place, CAST(pos // 25 AS INT) AS page, event_id, coalesce(event_type = 'error' AND value < 5, false) AS blocked FROM e LEFT JOIN b USING (batch) WHERE pos < 200 AND pos <= coalesce(stop, pos) AND batch IN (3, 7, 11, 12, 13, 39)""")
def paged_dataset_items(spark: SparkSession, d: str) -> DataFrame:
    """SRC13, SRC14: recorded pages read in order by a data source, to the first block or 200 items (the cap is the feature); the filter chooses datasets before they are read."""
    import uuid

    from ..shipping import shared_dir
    from ..sources import paged

    ev = read(spark, d, "events")
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    path = path if "://" in path or path.startswith("/") else "/" + path.split(":", 1)[1].lstrip("/")
    batch = (F.col("user_id") % 40).cast("string")
    at = F.row_number().over(Window.partitionBy("batch").orderBy("event_id")) - 1
    rows = ev.select(batch.alias("batch"), "event_id", F.to_json(F.struct("event_id", F.coalesce((F.col("event_type") == "error") & (F.col("value") < 5), F.lit(False)).alias("blocked"))).alias("item")).withColumn("page", F.floor(at / 25).cast("int"))
    paged.record(rows, path, "batch", "page", "event_id", "item")
    paged.register(spark)
    got = spark.read.format("paged_dataset").option("path", path).option("most", 200).load().filter(F.col("batch").isin("3", "7", "11", "12", "13", "39"))
    return got.select("batch", F.col("at").alias("place"), "page", F.get_json_object("item", "$.event_id").cast("long").alias("event_id"), "blocked")
