"""URLs, dates, hashes and JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_filled, let, text


def absolute_url(url: Column, base: str) -> Column:
    """UR1: full URLs stay, scheme-less and rooted ones are completed; null for empty."""
    u = F.trim(text(url))
    return F.when(u == "", F.lit(None)).when(u.rlike("^https?://"), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(F.lit(base), u)).otherwise(F.concat(F.lit(base + "/"), u))


def search_url(base: str, *words: Column) -> Column:
    """UR1: keyword search by title and author."""
    return F.concat(F.lit(base + "?kn="), F.url_encode(F.concat_ws(" ", *[first_filled(F.trim(text(w))) for w in words])), F.lit("&sortby=17"))


def url_safe_base64(c: Column) -> Column:
    """UR2: without padding."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "\\s", ""), "+/", "-_"), "=+$", "")


def year_in(c: Column) -> Column:
    """DT1: the first year from 1500 to 2099 that stands alone."""
    return F.regexp_extract(text(c), "(?<![0-9A-Za-z_])(1[5-9][0-9]{2}|20[0-9]{2})(?![0-9A-Za-z_])", 1).try_cast("int")


def content_name(c: Column) -> Column:
    """HS1: 16 hex digits of SHA-1."""
    return F.substring(F.sha1(c), 1, 16)


def idempotency_key(run_id: Column, body: Column) -> Column:
    """HS2: by run id, else by the hash of the body with its fields in order; a body that is no JSON is hashed as it is."""
    ordered = F.coalesce(F.to_json(F.try_parse_json(body)), body, F.lit(""))
    return F.coalesce(F.concat(F.lit("apify-webhook-run:"), first_filled(run_id)), F.concat(F.lit("apify-webhook-body:"), F.sha2(ordered, 256)))


#: Names of fields whose values are never kept, and the caps of kept metadata.
SENSITIVE = "(?i)(token|secret|cookie|authorization|auth|password|passwd|api[-_]?key|bearer|credential|webhookurl)"
MOST_CHARS, MOST_ITEMS, MOST_DEPTH, MOST_JSON = 500, 25, 4, 6000


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _safe(v: Column, depth: int) -> Column:
    """JSON of a variant without secrets, its containers at most :data:`MOST_DEPTH` deep."""
    kind = F.schema_of_variant(v)
    said = F.try_variant_get(v, "$", "string")
    short = F.when(F.length(said) > MOST_CHARS, _quoted(F.concat(F.substring(said, 1, MOST_CHARS), F.lit("…[truncated]")))).otherwise(F.to_json(v))
    if depth >= MOST_DEPTH:
        return F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), '"[depth-capped]"').when(kind == "STRING", short).otherwise(F.to_json(v))
    fields, items = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.slice(F.try_variant_get(v, "$", "array<variant>"), 1, MOST_ITEMS)
    field = lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.when(e["key"].rlike(SENSITIVE), F.lit('"[redacted]"')).otherwise(_safe(e["value"], depth + 1)))
    inside = lambda lo, parts, hi: F.concat(F.lit(lo), F.array_join(parts, ","), F.lit(hi))
    return (
        F.when(F.startswith(kind, F.lit("OBJECT")), inside("{", F.transform(fields, field), "}"))
        .when(F.startswith(kind, F.lit("ARRAY")), inside("[", F.transform(items, lambda x: _safe(x, depth + 1)), "]"))
        .when(kind == "STRING", short)
        .otherwise(F.to_json(v))
    )


def safe_metadata(c: Column) -> Column:
    """JS1: JSON metadata with secrets redacted, long texts and lists cut and deep values left out; fields in order of name.

    What is no object or list, or no JSON (a field twice included), is ``{}``; what is still too long says so. Lengths are in
    characters. Variants all the way, so no Python runs.
    """
    held = F.try_parse_json(c)
    kind = F.schema_of_variant(held)
    whole = F.when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), _safe(held, 0)).otherwise("{}")
    return let(whole, lambda j: F.when(F.length(j) > MOST_JSON, '{"note":"metadata exceeded size cap","truncated":true}').otherwise(j))


def best_title(corrected: Column, title: Column, raw: Column) -> Column:
    """JS3."""
    return first_filled(corrected, title, raw)


def comparison_title(lookup: Column, corrected: Column, title: Column) -> Column:
    """JS3: the title that a provider's is compared with."""
    return first_filled(lookup, corrected, title)


def provider_image(a: Column, b: Column) -> Column:
    """JS3."""
    return first_filled(a, b)


def image_by_index(urls: Column, index: Column, first: Column) -> Column:
    """JN24: the picture at a 1-based index, else the first picture."""
    return F.coalesce(F.when(index > 0, F.get(urls, (index - 1).cast("int"))), first)


def query_strings(most: int, *parts: Column) -> Column:
    """TK13: distinct trimmed queries in order, the first ``most``."""
    all_ = F.filter(F.transform(F.array(*parts), lambda q: F.trim(text(q))), lambda q: q != "")
    return F.slice(F.array_distinct(all_), 1, most)


def strong_lookups(candidates: Column, least: float = 0.5) -> Column:
    """JS4: candidates with a number and enough score; the first of each number."""
    good = F.filter(candidates, lambda c: (text(F.coalesce(c["isbn"], c["isbn13"])) != "") & (F.coalesce(c["score"], F.lit(0.0)) >= least))
    numbers = F.transform(good, lambda c: first_filled(c["isbn"], c["isbn13"]))
    return F.filter(good, lambda c, i: F.array_position(numbers, first_filled(c["isbn"], c["isbn13"])) == i + 1)


def exact_alternatives(candidates: Column, own: Column, least: float = 0.5) -> Column:
    """JS4: strong candidates of the same title with another number."""
    return F.filter(
        strong_lookups(candidates, least),
        lambda c: (F.coalesce(c["exact_title_match"], F.lit(False)) | F.coalesce(c["article_insensitive_title_match"], F.lit(False))) & (first_filled(c["isbn"], c["isbn13"]) != text(own)),
    )
