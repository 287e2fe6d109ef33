"""JSON payloads and recorded responses to rows. External calls are tables of what they returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.isbn import clean, find_in_text
from ..functions.price import lax_price, listing_price
from ..functions.text import first_filled
from ..operators.classify import noise_url

LISTING = (
    "id string, url string, title string, description string, price string, firstPictureUrl string, pictureUrls array<string>, tags array<string>, locationText string,"
    "locationCity string, locationPostalCode string, dateOfPost string, dateOfPostVisible string, deliveryModes array<string>, deliveryText string, source string, searchTitle string, scrapedAt string"
)


def enveloped(body: Column, item: str) -> Column:
    """Items of a bare array, of {items: [...]} or of {data: [...]}; an empty array for anything else."""
    kind = f"array<struct<{_struct(item)}>>"
    bare = F.when(F.startswith(F.ltrim(body), F.lit("[")), F.from_json(body, kind))
    inside = F.from_json(F.when(F.startswith(F.ltrim(body), F.lit("{")), body), f"items {kind}, data {kind}")
    return F.coalesce(bare, inside["items"], inside["data"], F.array().cast(kind))


def _struct(fields: str) -> str:
    """Column definitions as fields of a struct."""
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in fields.split(","))


def listings(payloads: DataFrame, key: str = "payload_id", body: str = "body") -> DataFrame:
    """SRC1: listings with an id, pictures without blanks (else the first picture), price text as a number."""
    rows = payloads.select(key, F.posexplode(enveloped(F.col(body), LISTING)).alias("ord", "i")).filter("i.id is not null and i.id <> ''")
    pictures = F.filter("i.pictureUrls", lambda u: F.trim(u) != "")
    none = F.array().cast("array<string>")
    pictures = F.when(F.size(F.coalesce(pictures, none)) > 0, pictures).when(F.col("i.firstPictureUrl") != "", F.array("i.firstPictureUrl")).otherwise(none)
    return rows.select(
        key, "ord", F.col("i.id").alias("ads_id"), "i.url", "i.title", "i.description", F.col("i.price").alias("price_text"), listing_price(F.col("i.price")).cast("decimal(10,2)").alias("price_amount"),
        F.coalesce(first_filled(F.col("i.firstPictureUrl")), F.get(pictures, F.lit(0))).alias("first_picture_url"), pictures.alias("picture_urls"), F.coalesce("i.tags", none).alias("tags"),
        location(F.col("i.tags"), F.col("i.locationText")).alias("location_text"), F.col("i.locationCity").alias("location_city"), F.col("i.locationPostalCode").alias("location_postal_code"),
        F.col("i.dateOfPost").try_cast("timestamp").alias("date_of_post"), F.col("i.source").alias("source"), F.col("i.searchTitle").alias("search_title"), F.col("i.scrapedAt").try_cast("timestamp").alias("scraped_at"),
    )


def location(tags: Column, text: Column) -> Column:
    """JS2: the stated location, else the first tag that names a place."""
    named = F.get(F.filter(tags, lambda t: F.startswith(F.trim(t), F.lit("À "))), F.lit(0))
    return F.coalesce(first_filled(text), F.regexp_replace(F.trim(named), "^À ", ""))


def listing_ids(body: Column) -> Column:
    """SRC2: distinct ids of a payload in order, whatever their name."""
    items = enveloped(body, "id string, adsId string, ads_id string, listId string")
    return F.array_distinct(F.filter(F.transform(items, lambda i: first_filled(i["adsId"], i["ads_id"], i["id"], i["listId"])), lambda x: x.isNotNull()))


def run_info(body: Column) -> Column:
    """SRC2: struct(run_id, actor_id, dataset_id) from the first name that is filled."""
    of = lambda *names: first_filled(*[F.get_json_object(body, f"$.{n}") for n in names])
    return F.struct(
        of("apifyRunId", "actorRunId", "runId", "resource.id").alias("run_id"), of("apifyActorId", "actorId", "resource.actId").alias("actor_id"),
        of("apifyDatasetId", "defaultDatasetId", "datasetId", "resource.defaultDatasetId").alias("dataset_id"),
    )


ENTRY = "code: string, ok: boolean, status: int, error: string, data: struct<status: string, price: string, demand_rating: string, product: struct<title: string, full_size_image_url: string, image_url: string, thumbnail_image_url: string>>"
RESPONSE = f"result struct<browser_data: struct<js_scenario: struct<steps: array<struct<action: string, result: struct<results: array<struct<{ENTRY}>>>>>>, javascript_evaluation_result: struct<results: array<struct<{ENTRY}>>>>>"


def offers_a(responses: DataFrame, key: str = "batch_id", body: str = "body") -> DataFrame:
    """SRC8: offers of provider A from the first execute step with a result: offer, no_offer or failed."""
    r = F.from_json(body, RESPONSE)["result"]["browser_data"]
    step = F.get(F.filter(r["js_scenario"]["steps"], lambda s: (s["action"] == "execute") & s["result"].isNotNull()), F.lit(0))
    results = F.coalesce(step["result"]["results"], r["javascript_evaluation_result"]["results"])
    rows = responses.select(key, F.posexplode(results).alias("ord", "e")).withColumn("isbn", clean(F.col("e.code"))).filter("isbn is not null")
    price = lax_price(F.col("e.data.price"))
    bad = ~F.coalesce(F.col("e.ok"), F.lit(False)) | F.col("e.data").isNull()
    offer = ~bad & F.coalesce((F.col("e.data.status") == "offer") & (price > 0), F.lit(False))
    error = F.coalesce(first_filled(F.col("e.error")), F.concat(F.lit("provider returned HTTP "), F.coalesce(F.col("e.status").cast("string"), F.lit("unknown"))))
    image = first_filled(F.col("e.data.product.full_size_image_url"), F.col("e.data.product.image_url"), F.col("e.data.product.thumbnail_image_url"))
    return rows.select(
        key, "ord", "isbn", F.when(bad, "failed").when(offer, "offer").otherwise("no_offer").alias("status"), F.when(~bad, F.col("e.data.status")).alias("provider_status"),
        F.when(bad, F.lit(None)).when(offer, price).otherwise(0.0).cast("decimal(10,2)").alias("price"), F.when(~bad, F.col("e.data.product.title")).alias("title"), F.when(~bad, image).alias("image_url"),
        F.when(~bad, F.col("e.data.demand_rating")).alias("demand_rating"), F.col("e.status").alias("http_status"), F.when(bad, error).alias("error"),
    )


def offer_identity(body: Column) -> Column:
    """SRC9: struct(ads_id, isbn, title, price, url) of a single-result payload, by alias."""
    of = lambda *names: first_filled(*[F.get_json_object(body, f"$.{n}") for n in names])
    return F.struct(
        of("adsId", "ads_id", "adId").alias("ads_id"), clean(of("isbn", "isbn13", "code")).alias("isbn"), of("title", "momoxTitle", "product.title").alias("title"),
        lax_price(of("price", "momoxPrice", "offer.price")).alias("price"), of("finalUrl", "final_url", "url").alias("url"),
    )


VOLUMES = (
    "items array<struct<id: string, volumeInfo: struct<title: string, subtitle: string, authors: array<string>, publisher: string, publishedDate: string, language: string,"
    "industryIdentifiers: array<struct<type: string, identifier: string>>, imageLinks: struct<thumbnail: string>>>>"
)


def volumes(responses: DataFrame, key: str = "query_key", body: str = "body") -> DataFrame:
    """SRC12: books of the volumes source with their identifiers."""
    rows = responses.select(key, F.posexplode(F.from_json(body, VOLUMES)["items"]).alias("ord", "v"))
    by = lambda t: clean(F.get(F.filter("v.volumeInfo.industryIdentifiers", lambda i: i["type"] == t), F.lit(0))["identifier"])
    return rows.select(
        key, "ord", by("ISBN_13").alias("isbn13"), by("ISBN_10").alias("isbn10"), F.concat_ws(": ", first_filled(F.col("v.volumeInfo.title")), first_filled(F.col("v.volumeInfo.subtitle"))).alias("title"),
        F.array_join("v.volumeInfo.authors", ", ").alias("authors"), "v.volumeInfo.publisher", F.col("v.volumeInfo.publishedDate").alias("published"), "v.volumeInfo.language", F.col("v.volumeInfo.imageLinks.thumbnail").alias("image_url"),
    )


def lookup_dataset(items: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """SRC13: items of a lookup run up to the first that says blocked, 1000 at most, in order (run_id, ord)."""
    w = Window.partitionBy("run_id").orderBy("ord")
    blocked = F.coalesce(F.max(F.col("blocked").cast("int")).over(w), F.lit(0))
    rows = items.withColumn("__b", blocked).withColumn("__n", F.row_number().over(w)).filter((F.col("__b") == 0) & (F.col("__n") <= most))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("run_id", "ord", "item"))), lambda x: x["item"]).alias("items"))


def cached_first(requests: DataFrame, responses: DataFrame, key: str, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """SRC14, QS14: (answered, open): distinct requests that a recorded response answers, and the rest in chunks."""
    once = requests.select(key).distinct()
    answered = once.join(responses, key)
    open_ = once.join(responses, key, "left_anti")
    chunk = F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)) - 1) / size)
    return answered, open_.withColumn("chunk", F.concat_ws("-", F.pmod(F.xxhash64(key), F.lit(64)), chunk))


DETECTED = (
    "title string, raw_visible_text string, possible_corrected_title string, title_candidates array<string>, author string, publisher_or_collection string, language_hint string,"
    "visible_isbn string, ai_confidence double, image_index int, position string, bbox array<double>, orientation string, is_partial_or_occluded boolean, series_name string, reason string"
)


def detected_books(responses: DataFrame, key: str = "ads_id", body: str = "body") -> DataFrame:
    """SRC16: detected books of a vision response, trimmed, boxes clamped to the image, the first of equal ones.

    Books are equal by normalised title and author; books without any title are left out.
    """
    from ..functions.numbers import clamp01
    from ..functions.text import normalize_unicode
    from ..operators.relational import first_wins

    books = F.from_json(body, f"books array<struct<{_struct(DETECTED)}>>")["books"]
    rows = responses.select(key, F.posexplode(books).alias("ord", "b")).select(key, "ord", "b.*")
    text = ["title", "raw_visible_text", "possible_corrected_title", "author", "publisher_or_collection", "visible_isbn", "series_name"]
    rows = rows.withColumns({c: first_filled(F.trim(F.col(c))) for c in text}).withColumn("bbox", F.transform("bbox", clamp01))
    best = first_filled(F.col("possible_corrected_title"), F.col("title"), F.col("raw_visible_text"))
    rows = rows.filter(best.isNotNull()).withColumn("__t", normalize_unicode(best)).withColumn("__a", normalize_unicode(F.col("author")))
    return first_wins(rows, [key, "__t", "__a"], ["ord"]).drop("__t", "__a")


def crop_reads(responses: DataFrame, key: str = "ads_id", body: str = "body") -> DataFrame:
    """SRC17: second readings of crops by index."""
    rows = F.from_json(body, "books array<struct<index: int, title: string, author: string, raw_visible_text: string, confidence: double>>")["books"]
    return responses.select(key, F.explode(rows).alias("b")).select(key, "b.*")


def suggested_numbers(responses: DataFrame, key: str = "book_id", body: str = "body") -> DataFrame:
    """SRC18: numbers that a model suggests, repaired where only the check digit is wrong."""
    from ..functions.isbn import resolve

    rows = F.from_json(body, "candidates array<struct<isbn: string, title: string, confidence: double>>")["candidates"]
    out = responses.select(key, F.posexplode(rows).alias("ord", "c")).withColumn("n", resolve(F.col("c.isbn")))
    return out.select(key, "ord", F.col("c.isbn").alias("raw_isbn"), "n.isbn13", "n.repaired", "c.title", "c.confidence")


MATCH = "array<struct<link: string, url: string, title: string, source: string>>"


def visual_matches(items: DataFrame, key: str = "crop_id", body: str = "body") -> DataFrame:
    """SRC19: the three match lists of a visual search, tagged, in one order; ``summary`` in a column of its own."""
    j = F.from_json(body, f"visualMatches {MATCH}, exactMatches {MATCH}, aiMatches {MATCH}, aiSummary string")
    tag = lambda n, t: F.transform(F.coalesce(j[n], F.array().cast(MATCH)), lambda m: F.struct(F.coalesce(first_filled(m["link"]), m["url"]).alias("link"), m["title"].alias("title"), m["source"].alias("source"), F.lit(t).alias("match_type")))
    return items.select(key, j["aiSummary"].alias("summary"), F.concat(tag("visualMatches", "visual"), tag("exactMatches", "exact"), tag("aiMatches", "ai")).alias("matches"))


def matched_numbers(matches: DataFrame, key: str = "crop_id") -> DataFrame:
    """IS9: distinct valid numbers of visual matches, link before title before summary; the first finding counts."""
    from ..operators.relational import first_wins
    from .pages import host

    m = matches.select(key, F.posexplode("matches").alias("p", "m")).filter(~noise_url(F.col("m.link")))
    source = F.coalesce(host(F.col("m.link")), F.col("m.source"))
    of = lambda c, place, via: m.select(key, (F.col("p") * 2 + place).alias("p"), F.posexplode(find_in_text(F.col(c))).alias("q", "f"), source.alias("source"), F.col("m.link").alias("source_url"), "m.match_type", via)
    link = of("m.link", 0, F.lit(None).cast("string").alias("how"))
    title = of("m.title", 1, F.lit("lens_title").alias("how"))
    summary = matches.select(key, F.lit(1 << 30).alias("p"), F.posexplode(find_in_text(F.col("summary"))).alias("q", "f"), F.lit("ai_summary").alias("source"), F.lit(None).cast("string").alias("source_url"), F.lit("ai_summary").alias("match_type"), F.lit("lens_ai_summary").alias("how"))
    rows = link.union(title).union(summary)
    via = F.coalesce("how", F.when(F.col("f.via") == "amazon_dp", "amazon_dp").otherwise("lens_url"))
    return first_wins(rows.select(key, "p", "q", "f.isbn13", via.alias("via"), "source", "source_url", "match_type"), [key, "isbn13"], ["p", "q"]).drop("p", "q")


def run_cost(body: Column) -> Column:
    """SRC20: the first cost of six places that is a number of 0 or more, 6 decimals."""
    paths = ("usageTotalUsd", "usageUsd", "stats.usageTotalUsd", "stats.usageUsd", "usage.totalUsd", "usage.usd")
    found = [F.get_json_object(body, f"$.{p}").try_cast("decimal(18,6)") for p in paths]
    return F.coalesce(*[F.when(c >= 0, c) for c in found])


def scrape_facts(body: Column) -> Column:
    """SRC21: struct(cost, request_id, status_code, success) of a scrape response, by alias."""
    of = lambda *names: first_filled(*[F.get_json_object(body, f"$.{n}") for n in names])
    return F.struct(
        of("context.cost.total", "result.cost", "cost").try_cast("decimal(18,4)").alias("cost"), of("context.uuid", "uuid", "request_id").alias("request_id"),
        of("result.status_code", "status_code").try_cast("int").alias("status_code"), F.coalesce(of("result.success").try_cast("boolean"), F.lit(False)).alias("success"),
    )


def probe_covers(probes: DataFrame, least_bytes: int = 2000) -> DataFrame:
    """SRC11: the first of a number's cover URLs (isbn, try_no) that answered with an image of enough bytes."""
    from ..operators.relational import first_wins

    good = probes.filter((F.col("status") == 200) & F.startswith(F.col("content_type"), F.lit("image/")) & (F.col("bytes") >= least_bytes))
    return first_wins(good, ["isbn"], ["try_no"])


def images(spark, path: str, most_bytes: int = 20_000_000, glob: str | None = None) -> DataFrame:
    """SRC22: downloaded image files as rows: path, length, content, its content name, and what the folders' names say.

    Files above ``most_bytes`` are not opened: the test of the length reaches the source. Each file is listed and opened
    by itself; many small ones are better kept as rows, see :func:`downloads`.
    """
    from ..functions.misc import content_name

    reader = spark.read.format("binaryFile")
    files = (reader if glob is None else reader.option("pathGlobFilter", glob)).load(path).filter(F.col("length") <= most_bytes)
    return files.withColumn("name", content_name(F.col("content")))


def downloads(rows: DataFrame, most_bytes: int = 20_000_000, content: str = "content") -> DataFrame:
    """SRC22: downloads that are kept as rows of a table, with length and content name; those above ``most_bytes`` and those
    without content are left out. As many rows lie in a file as the table has, so nothing is done for each download."""
    from ..functions.misc import content_name

    sized = rows.withColumn("length", F.octet_length(content).cast("long")).filter(F.col("length") <= most_bytes)
    return sized.withColumn("name", content_name(F.col(content)))


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SRC23, SRC24, PRD2: optional columns that the table lacks, as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})
