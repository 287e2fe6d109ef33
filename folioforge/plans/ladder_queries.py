"""Registered queries of the classifiers: every branch of a ladder, over line items with columns made from their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import misc, numbers, price
from ..operators import classify
from .registry import made, made_sql, query, share, turn

def cols(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def words_sql(x: str, least: int, stop: tuple[str, ...] = ()) -> str:
    """Words of a text that is normalised already."""
    return f"list_filter(string_split(coalesce({x}, ''), ' '), lambda t: length(t) >= {least}" + (f" AND NOT list_contains({list(stop)!r}, t))" if stop else ")")


def prefix_sql(a: str, b: str) -> str:
    return f"(least(length({a}), length({b})) >= 12 AND ({a} = {b} OR starts_with({b}, {a} || ' ') OR starts_with({a}, {b} || ' ')))"


_REASON = {"reason": turn(1, None, "", "needs_verification_low", "needs_verification_medium", "no_isbn", "catalog_no_match")}


@query(f"WITH {made_sql(_REASON)} SELECT ads_id, line, CASE WHEN coalesce(reason, '') = '' THEN 'not_eligible' WHEN starts_with(reason, 'needs_verification') THEN 'isbn_confidence_below_threshold' ELSE reason END AS reason FROM r")
def not_sent_reasons(spark: SparkSession, d: str) -> DataFrame:
    """CLS4."""
    return made(spark, d, _REASON).select("ads_id", "line", classify.not_sent_reason(F.col("reason")).alias("reason"))


_TITLES = ("le petit prince rouge", "le petit prince rouge et bleu", "les chats du port", "petit prince", None, "")
_AUTHORS = ("anne martin", "martin anne dupont", "paul", "", None)
_GATE = {
    "isbn": turn(1, "9780000000019", None, "9780000000026", ""), "isbn_is_valid": turn(4, True, None, False), "isbn_confidence": share(3), "possible_corrected_title": turn(2, None, *_TITLES),
    "title": turn(5, *_TITLES), "raw_visible_text": turn(7, "les chats du port", None), "lookup_title": turn(11, *_TITLES), "author": turn(13, *_AUTHORS), "lookup_authors": turn(17, *_AUTHORS),
    "raw_text_similarity": share(19), "best_title_similarity": share(23),
}
_DETECTED = "coalesce(nullif(possible_corrected_title, ''), nullif(title, ''), nullif(raw_visible_text, ''))"


def _author_sql() -> str:
    x, y = "coalesce(author, '')", "coalesce(lookup_authors, '')"
    parts = f"len({words_sql('author', 1)}) >= 2 AND len({words_sql('lookup_authors', 1)}) >= 2 AND len(list_filter({words_sql('lookup_authors', 1)}, lambda t: list_contains({words_sql('author', 1)}, t))) >= 2"
    return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x}) OR ({parts})))"


_PROMOTED = f"(coalesce(isbn, '') <> '' AND coalesce(isbn_is_valid, true) AND isbn_confidence >= 0.5 AND isbn_confidence < 0.85 AND {prefix_sql(f'coalesce({_DETECTED}, chr(0))', 'coalesce(lookup_title, chr(0))')} AND {_author_sql()})"


@query(f"WITH {made_sql(_GATE)} SELECT ads_id, line, {_PROMOTED} AS promoted, coalesce(isbn, '') <> '' AND coalesce(isbn_is_valid, true) AND (isbn_confidence >= 0.85 OR {_PROMOTED}) AS accepted FROM r")
def accept_gate(spark: SparkSession, d: str) -> DataFrame:
    """CLS5, SIM7, SIM8."""
    df = made(spark, d, _GATE)
    return df.select("ads_id", "line", classify.medium_promoted(cols(df)).alias("promoted"), classify.accepted_number(cols(df)).alias("accepted"))


_WORK_STOP = ("le", "la", "les", "un", "une", "des", "de", "du", "d", "l", "et", "a", "au", "aux", "en", "the", "of", "and", "edition", "french", "tome", "vol")


def _contained_sql(a: str, b: str) -> str:
    x, y = words_sql(a, 3, _WORK_STOP), words_sql(b, 3, _WORK_STOP)
    return f"(CASE WHEN len({x}) < 2 OR len({y}) = 0 THEN 0.0 ELSE CAST(len(list_filter({x}, lambda t: list_contains({y}, t))) AS DOUBLE) / len({x}) END)"


_BEST = "coalesce(nullif(possible_corrected_title, ''), nullif(title, ''))"


@query(
    f"WITH {made_sql(_GATE)} SELECT ads_id, line, coalesce(lookup_title, '') <> '' AND (raw_text_similarity >= 0.85 OR best_title_similarity >= 0.85 OR {prefix_sql(f'coalesce({_BEST}, chr(0))', 'lookup_title')}"
    f" OR {prefix_sql('coalesce(raw_visible_text, chr(0))', 'lookup_title')} OR {_contained_sql(_BEST, 'lookup_title')} >= 0.85 OR {_contained_sql('raw_visible_text', 'lookup_title')} >= 0.85) AS strong FROM r"
)
def work_match(spark: SparkSession, d: str) -> DataFrame:
    """CLS6, SIM7, SIM9."""
    df = made(spark, d, _GATE)
    return df.select("ads_id", "line", classify.strong_work_match(cols(df)).alias("strong"))


_RESOLVED = {
    "title": turn(1, "cupidon", "un livre", None, "alex cross", ""), "possible_corrected_title": turn(2, None, "un autre", ""), "raw_visible_text": turn(3, None, "texte"), "isbn": turn(5, "9780000000019", "9780000000019", None),
    "isbn_is_valid": turn(7, True, True, False, None), "lookup_title": turn(4, "un livre", "un livre", ""), "lookup_score": share(6), "isbn_confidence": share(3), "author": turn(11, "anne", "", None),
    "author_similarity": turn(13, 0, 0.5, 1), "best_title_similarity": share(17), "strong": turn(19, 0, 1, 2), "exact": turn(23, True, False),
}


@query(f"""WITH {made_sql(_RESOLVED)} SELECT ads_id, line, CASE WHEN {_DETECTED} IS NULL THEN 'no_title' WHEN coalesce(isbn, '') = '' OR NOT coalesce(isbn_is_valid, false) THEN 'no_valid_isbn'
  WHEN coalesce(lookup_title, '') = '' OR lookup_score <= 0 THEN 'no_lookup' WHEN isbn_confidence < 0.5 THEN 'low_confidence' WHEN coalesce(author, '') <> '' AND author_similarity = 0 THEN 'author_mismatch'
  WHEN coalesce(author, '') = '' AND strong > 1 AND NOT exact THEN 'ambiguous_without_author' WHEN coalesce(author, '') = '' AND best_title_similarity < 0.9 THEN 'title_below_0.9_without_author'
  WHEN coalesce(author, '') <> '' AND best_title_similarity < 0.65 THEN 'title_below_0.65' WHEN title IN ('alex cross', 'cupid', 'cupidon') THEN 'generic_title' END AS refused FROM r""")
def resolution_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """CLS7."""
    df = made(spark, d, _RESOLVED)
    return df.select("ads_id", "line", classify.accepted_resolution(cols(df), F.col("strong"), F.col("exact")).alias("refused"))


_CROP = {
    "isbn_source": turn(1, "isbnsearch", "visible_isbn", None), "boxed": turn(2, True, True, False), "isbn": turn(3, "9780000000019", None), "isbn_is_valid": turn(5, None, True, False), "isbn_confidence": share(7),
    "is_partial_or_occluded": turn(11, False, None, True), "raw_visible_text": turn(13, "un titre entier", "abc", "un titre coupé…", None, ""), "series_name": turn(17, None, "serie", "autre"),
    "title": turn(19, "serie", "titre", None), "possible_corrected_title": turn(23, None, "titre"),
}


@query(f"""WITH {made_sql(_CROP)} SELECT ads_id, line, coalesce(isbn_source, '') <> 'visible_isbn' AND boxed AND (coalesce(isbn, '') = '' OR NOT coalesce(isbn_is_valid, true) OR isbn_confidence < 0.5 OR coalesce(is_partial_or_occluded, false)
  OR (coalesce(raw_visible_text, '') <> '' AND (length(raw_visible_text) <= 4 OR right(raw_visible_text, 1) IN ('-', '–', '—', '…'))) OR (coalesce(series_name, '') <> '' AND coalesce(possible_corrected_title, title, '') IN ('', series_name))) AS retry FROM r""")
def crop_retry(spark: SparkSession, d: str) -> DataFrame:
    """CLS8."""
    df = made(spark, d, _CROP).withColumn("bbox", F.when(F.col("boxed"), F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])))
    return df.select("ads_id", "line", classify.needs_crop_retry(cols(df)).alias("retry"))


_READS = {"old_title": turn(1, *_TITLES), "new_title": turn(7, *_TITLES), "level": turn(3, "good", "poor"), "old_confidence": share(5), "new_confidence": share(11)}
SIMILARITY_STOP = ("le", "la", "les", "un", "une", "des", "du", "de", "d", "l", "et", "a", "au", "aux", "en", "the", "of", "and")


def similarity_sql(a: str, b: str) -> str:
    """Token similarity of normalised texts: shared over the larger set, a safe prefix or containment may raise it."""
    x, y = (f"list_distinct({words_sql(c, 2, SIMILARITY_STOP)})" for c in (a, b))
    both, low, high = f"CAST(len(list_intersect({x}, {y})) AS DOUBLE)", f"least(len({x}), len({y}))", f"greatest(len({x}), len({y}))"
    inside = f"(CASE WHEN {low} >= 2 THEN {both} / {low} ELSE 0.0 END)"
    match = prefix_sql(f"coalesce({a}, '')", f"coalesce({b}, '')")
    return f"(CASE WHEN {low} = 0 THEN 0.0 WHEN {match} THEN greatest({both} / {high}, 0.9) WHEN {inside} >= 0.85 THEN greatest({both} / {high}, {inside}) ELSE {both} / {high} END)"


_SHARED = f"len(list_intersect(list_distinct({words_sql('old_title', 3, SIMILARITY_STOP)}), list_distinct({words_sql('new_title', 3, SIMILARITY_STOP)})))"
_COMPATIBLE = f"(coalesce(old_title, '') = '' OR coalesce(new_title, '') = '' OR {similarity_sql('old_title', 'new_title')} >= 0.35 OR {_SHARED} >= 2)"


@query(f"WITH {made_sql(_READS)} SELECT ads_id, line, {_COMPATIBLE} AS compatible, NOT {_COMPATIBLE} AND level = 'good' AND old_confidence < 0.5 AND new_confidence >= 0.7 AS override FROM r")
def crop_reads_compared(spark: SparkSession, d: str) -> DataFrame:
    """CLS9, SIM1, SIM11."""
    df = made(spark, d, _READS).withColumn("compatible", classify.crop_compatible(F.col("old_title"), F.col("new_title")))
    return df.select("ads_id", "line", "compatible", classify.crop_may_override(F.col("compatible"), F.col("level"), F.col("old_confidence"), F.col("new_confidence")).alias("override"))


_AI = {"ai": share(1), "title_sim": share(3), "author_sim": turn(5, 0, 0.4, None), "has_author": turn(7, True, False)}


@query(f"WITH {made_sql(_AI)} SELECT ads_id, line, ai >= 0.3 AND title_sim >= CASE WHEN has_author AND coalesce(author_sim, 0) = 0 THEN 0.9 ELSE 0.65 END AS safe FROM r")
def ai_candidate_gate(spark: SparkSession, d: str) -> DataFrame:
    """CLS10."""
    return made(spark, d, _AI).select("ads_id", "line", classify.ai_candidate_safe(F.col("ai"), F.col("title_sim"), F.col("author_sim"), F.col("has_author")).alias("safe"))


_STRICT = {"title": turn(1, "cupidon", "un long titre entier", "petit"), "s1": share(2), "s2": share(3), "e1": turn(5, True, False, None), "a1": turn(7, True, False), "e2": turn(11, False, True), "a2": turn(13, None, True)}


@query(f"""WITH {made_sql(_STRICT)}, c AS (SELECT rid, ads_id, line, title, 1 AS n, s1 AS score, coalesce(e1, false) AS e, coalesce(a1, false) AS a FROM r UNION ALL SELECT rid, ads_id, line, title, 2, s2, coalesce(e2, false), coalesce(a2, false) FROM r),
k AS (SELECT *, title <> 'un long titre entier' AS strict FROM c WHERE title = 'un long titre entier' OR e OR a), m AS (SELECT *, CASE WHEN strict AND NOT e THEN greatest(0.0, floor((score - 0.05) * 100 + 0.5) / 100) ELSE score END AS lowered FROM k)
SELECT ads_id, line, CAST(row_number() OVER (PARTITION BY rid ORDER BY CASE WHEN strict THEN -lowered ELSE n END, n) - 1 AS INT) AS place, n, lowered AS score FROM m""")
def strict_title_candidates(spark: SparkSession, d: str) -> DataFrame:
    """CLS11."""
    of = lambda n: F.struct(F.lit(n).alias("n"), F.col(f"s{n}").alias("score"), F.col(f"e{n}").alias("exact_title_match"), F.col(f"a{n}").alias("article_insensitive_title_match"))
    df = made(spark, d, _STRICT).withColumn("c", classify.strict_candidates(F.array(of(1), of(2)), F.col("title")))
    return df.select("ads_id", "line", F.posexplode("c").alias("place", "c")).select("ads_id", "line", "place", "c.n", "c.score")


_ASKED = {"q": turn(1, "aucune idee", "Titre inconnu", "le petit prince", "le la les", "ab cd", "prince", "histoire naturelle", None, "")}


@query(f"WITH {made_sql(_ASKED)} SELECT ads_id, line, q IN ('le petit prince', 'histoire naturelle') AS useful FROM (SELECT *, coalesce(q, '') AS q2 FROM r) WHERE q2 <> '' UNION ALL SELECT ads_id, line, false FROM r WHERE coalesce(q, '') = ''")
def useful_queries(spark: SparkSession, d: str) -> DataFrame:
    """CLS12."""
    return made(spark, d, _ASKED).select("ads_id", "line", classify.useful_query(F.col("q")).alias("useful"))


_HOLD = {"isbn": turn(1, "9780000000019", None), "conf": share(3), "candidate_status": turn(2, "strong_candidate", "weak_candidate", None), "status": turn(5, "isbn_weak", "isbn_medium", None), "reason": turn(7, "no_isbn", "catalog_no_match", "crop_retry_mismatch", "else", None)}


@query(f"WITH {made_sql(_HOLD)} SELECT ads_id, line, coalesce(isbn, '') <> '' AND coalesce(reason, '') <> 'no_isbn' AND (coalesce(candidate_status, '') = 'strong_candidate' OR coalesce(status, '') = 'isbn_medium' OR conf >= 0.5 OR coalesce(reason, '') IN ('catalog_no_match', 'crop_retry_mismatch')) AS hold FROM r")
def held_for_review(spark: SparkSession, d: str) -> DataFrame:
    """CLS16."""
    return made(spark, d, _HOLD).select("ads_id", "line", classify.hold_needs_review(*[F.col(c) for c in ("isbn", "conf", "candidate_status", "status", "reason")]).alias("hold"))


_STATES = {"status": turn(1, "momox_no_price", "momox_not_real_offer", "momox_error", "momox_title_mismatch", "momox_price_found", None), "price": turn(7, 0, 2.5, None), "score": share(3), "row_status": turn(5, "failed", "no_offer", "offer")}


@query(f"""WITH {made_sql(_STATES)} SELECT ads_id, line, CASE status WHEN 'momox_no_price' THEN 'resale_no_price' WHEN 'momox_not_real_offer' THEN 'resale_not_real_offer' WHEN 'momox_error' THEN 'resale_error' WHEN 'momox_title_mismatch' THEN 'resale_title_mismatch' ELSE 'resale_price_found' END AS candidate,
  CASE WHEN price > 0 THEN 'new' WHEN status IN ('momox_no_price', 'momox_not_real_offer', 'momox_error', 'momox_title_mismatch') THEN 'failed' ELSE 'pending' END AS admin,
  CASE WHEN status = 'momox_price_found' AND score >= 0.85 THEN 'pending' ELSE 'manual_review' END AS review, CASE WHEN row_status = 'failed' THEN 'momox_failed' WHEN row_status = 'no_offer' OR status = 'momox_title_mismatch' THEN 'momox_no_offer' ELSE 'momox_price_found' END AS provider FROM r""")
def status_translations(spark: SparkSession, d: str) -> DataFrame:
    """CLS19."""
    st, pr = F.col("status"), F.col("price")
    return made(spark, d, _STATES).select("ads_id", "line", classify.candidate_status_of(st).alias("candidate"), classify.admin_status_of(st, pr).alias("admin"), classify.review_status_of(st, F.col("score")).alias("review"), classify.provider_status_of(F.col("row_status"), st).alias("provider"))


_VISION = {"same": turn(1, True, False, None), "conf": share(3)}


@query(f"WITH {made_sql(_VISION)} SELECT ads_id, line, CASE WHEN same THEN CASE WHEN conf >= 0.85 THEN 'match' WHEN conf >= 0.6 THEN 'likely_match' ELSE 'uncertain' END WHEN NOT same AND conf >= 0.6 THEN 'mismatch' ELSE 'uncertain' END AS verdict FROM r")
def vision_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """CLS20."""
    return made(spark, d, _VISION).select("ads_id", "line", classify.vision_status(F.col("same"), F.col("conf")).alias("verdict"))


_CATALOG = {
    "visible_sendable": turn(1, False, False, False, True), "strong_sendable": turn(2, True, False), "medium_sendable": turn(3, False, True), "crop_mismatch": turn(5, False, False, True), "budget_left": turn(7, True, True, False),
    "level": turn(11, "good", "poor", "risky"), "decision": turn(13, "selected_exact_isbn", "selected_cover_ambiguous_isbn", "no_match", "needs_verification", None), "selected_sendable": turn(17, True, False), "selected_valid": turn(19, True, True, False),
    "selected_confidence": share(4), "selected_title_ok": turn(23, True, True, False), "selected_contradiction": turn(29, False, False, True), "own_valid": turn(31, True, False), "own_confidence": share(6),
    "own_cover_status": turn(37, "match", "likely_match", "mismatch", None), "own_cover_similarity": share(8), "own_cover_confidence": share(9), "own_title_ok": turn(41, True, False),
}


@query(f"""WITH {made_sql(_CATALOG)}, x AS (SELECT *, CASE WHEN crop_mismatch AND NOT visible_sendable THEN 'poor' ELSE level END AS lv FROM r), g AS (SELECT *, CASE
  WHEN visible_sendable THEN 'visible_isbn' WHEN NOT strong_sendable AND NOT medium_sendable THEN CASE WHEN lv = 'poor' THEN 'crop_too_small' ELSE 'needs_verification' END
  WHEN lv = 'good' AND NOT budget_left THEN CASE WHEN strong_sendable THEN 'strong_isbn_budget' ELSE 'medium_fallback' END
  WHEN lv = 'good' AND decision IN ('selected_exact_isbn', 'selected_cover_ambiguous_isbn') AND selected_sendable THEN decision WHEN lv = 'good' AND strong_sendable THEN 'strong_isbn_catalog_unconfirmed' WHEN lv = 'good' THEN 'medium_fallback'
  WHEN NOT budget_left THEN CASE WHEN crop_mismatch THEN 'crop_retry_mismatch' ELSE 'catalog_budget_no_cover_proof' END
  WHEN decision = 'selected_exact_isbn' AND selected_sendable THEN CASE WHEN NOT selected_valid OR selected_confidence < 0.5 THEN 'poor_crop_selected_exact_low_confidence' WHEN NOT selected_title_ok OR selected_contradiction THEN 'poor_crop_selected_exact_title_conflict' ELSE 'poor_crop_cover_verified' END
  WHEN own_valid AND own_confidence >= 0.9 AND own_cover_status IN ('match', 'likely_match') AND own_cover_confidence >= 0.7 AND own_cover_similarity >= 0.8 AND own_title_ok THEN 'cover_verified_edition_ambiguous'
  WHEN own_cover_status = 'mismatch' AND own_cover_confidence >= 0.7 THEN 'cover_mismatch_needs_review' WHEN crop_mismatch THEN 'crop_retry_mismatch' WHEN lv = 'poor' THEN 'tiny_crop_cover_unconfirmed' ELSE 'poor_crop_needs_cover_match' END AS reason FROM x),
o AS (SELECT *, reason IN ('visible_isbn', 'strong_isbn_budget', 'medium_fallback', 'selected_exact_isbn', 'selected_cover_ambiguous_isbn', 'strong_isbn_catalog_unconfirmed', 'poor_crop_cover_verified', 'cover_verified_edition_ambiguous') AS eligible FROM g)
SELECT ads_id, line, eligible, reason, CASE WHEN NOT eligible OR reason = 'cover_verified_edition_ambiguous' THEN reason ELSE coalesce(decision, reason) END AS label FROM o""")
def catalog_gate_ladder(spark: SparkSession, d: str) -> DataFrame:
    """CLS23, CLS24."""
    df = made(spark, d, _CATALOG)
    df = df.withColumn("v", classify.catalog_gate(cols(df)))
    return df.select("ads_id", "line", "v.eligible", "v.reason", classify.gate_label(F.col("v.eligible"), F.col("decision"), F.col("v.reason")).alias("label"))


_PROOF = {
    "possible_corrected_title": turn(1, None, "petit prince rouge", "animaux ferme"), "title": turn(3, "petit prince rouge", "couleurs jardin", "autre"), "raw_visible_text": turn(5, None, "texte"), "lookup_title": turn(7, "petit prince rouge et bleu", "couleurs jardin", "chiffres jardin", "loin"),
    "isbn_is_valid": turn(11, True, None, False), "isbn_confidence": share(2), "author": turn(13, "anne martin", "", "paul"), "lookup_authors": turn(17, "anne martin", None, "marie"),
}
_D, _K = "coalesce(possible_corrected_title, title)", "lookup_title"
_TITLE_STOP = ("le", "la", "les", "un", "une", "des", "de", "du", "d", "l", "et", "au", "aux", "en", "dans", "sur", "the", "of", "to", "and", "a", "an")
_TX, _TY = (f"list_distinct({words_sql(c, 1, _TITLE_STOP)})" for c in (_D, _K))
_TOPICS = "['chiffres', 'couleurs', 'animaux']"
_TITLE_OK = f"(len(list_intersect({_TX}, {_TY})) * 2 >= least(len({_TX}), len({_TY})))"
_CONTRA = f"(len(list_intersect({_TOPICS}, {_TX})) > 0 AND len(list_intersect({_TOPICS}, {_TY})) > 0 AND len(list_intersect(list_intersect({_TOPICS}, {_TX}), {_TY})) = 0)"
_SAME = "(coalesce(author, '') <> '' AND coalesce(author, '') = coalesce(lookup_authors, ''))"
_TITLE_PROOF = f"(NOT {_CONTRA} AND ({_TITLE_OK} OR {prefix_sql(_D, _K)}))"


@query(f"""WITH {made_sql(_PROOF)} SELECT ads_id, line, {_TITLE_PROOF} AS title_proof, {_CONTRA} AS contradiction, coalesce(isbn_is_valid, true) AND isbn_confidence >= 0.9 AND {_TITLE_PROOF} AND (coalesce(author, '') = '' OR coalesce(lookup_authors, '') = '' OR {_SAME}) AS strong_text,
  coalesce(isbn_is_valid, true) AND isbn_confidence >= 0.6 AND {prefix_sql(_D, _K)} AND {_SAME} AS medium_text FROM r""")
def gate_proofs(spark: SparkSession, d: str) -> DataFrame:
    """CLS24, SIM6, SIM8."""
    from ..functions import similarity

    df = made(spark, d, _PROOF)
    row = cols(df)
    detected = F.coalesce("possible_corrected_title", "title")
    return df.select("ads_id", "line", classify.title_proof(row).alias("title_proof"), similarity.semantic_contradiction(detected, F.col("lookup_title")).alias("contradiction"), classify.strong_text_proof(row).alias("strong_text"), classify.medium_text_proof(row).alias("medium_text"))


_FALLBACK = {"enabled": turn(1, True, True, False), "detected": turn(2, 0, 3, 5, 9), "eligible": turn(11, 0, 1, 2)}


@query(f"WITH {made_sql(_FALLBACK)} SELECT ads_id, line, enabled AND (eligible = 0 OR (detected >= 5 AND eligible <= 1)) AS trigger, CASE WHEN NOT enabled THEN 'disabled' WHEN eligible = 0 THEN 'zero_eligible' WHEN detected >= 5 AND eligible <= 1 THEN 'sparse(' || detected || '/' || eligible || ')' ELSE 'ok(' || detected || '/' || eligible || ')' END AS reason FROM r")
def fallback_triggers(spark: SparkSession, d: str) -> DataFrame:
    """CLS26."""
    v = classify.fallback_trigger(F.col("enabled"), F.col("detected"), F.col("eligible"))
    return made(spark, d, _FALLBACK).select("ads_id", "line", v.alias("v")).select("ads_id", "line", "v.trigger", "v.reason")


_FAILED = {
    "stage": turn(1, "input_missing", "fill_error", "fill_unverified", "submit_missing", "post_submit", "no_rows", "consent_modal_blocked", None), "fill_stage": turn(3, None, None, "consent_modal_blocked"), "cookie": turn(5, False, None, None, True),
    "reason": turn(7, None, "Cookie banner", "No product rows", "#add_sao gone", "input[name=x] absent", "socket hang up"), "code": turn(11, 200, 403, 429, 500, 503, None), "html": turn(13, "<p>ok</p>", "Just a moment", "Please verify to continue", "cloudflare challenge", "cloudflare", None),
}
_MODAL = "(coalesce(stage, '') = 'consent_modal_blocked' OR coalesce(fill_stage, '') = 'consent_modal_blocked' OR coalesce(cookie, false))"
_KIND = f"CASE WHEN {_MODAL} THEN 'consent_modal_blocked' WHEN stage IN ('input_missing', 'fill_error', 'fill_unverified', 'submit_missing') THEN 'scenario_form_failure' WHEN reason = 'Cookie banner' THEN 'consent_modal_blocked' WHEN reason IN ('No product rows', '#add_sao gone', 'input[name=x] absent') THEN 'scenario_form_failure' ELSE 'http_error' END"


@query(f"WITH {made_sql(_FAILED)}, f AS (SELECT *, {_KIND} AS kind FROM r) SELECT ads_id, line, kind, kind <> 'consent_modal_blocked' AND NOT {_MODAL} AND coalesce(stage, '') = 'post_submit' AS retriable, coalesce(code IN (403, 429, 503), false) OR coalesce(html IN ('Just a moment', 'Please verify to continue', 'cloudflare challenge'), false) AS blocked FROM f")
def failure_kinds(spark: SparkSession, d: str) -> DataFrame:
    """CLS27."""
    diag = [F.col("stage"), F.col("fill_stage"), F.col("cookie")]
    df = made(spark, d, _FAILED).withColumn("kind", classify.failure_kind(*diag, F.col("reason")))
    return df.select("ads_id", "line", "kind", classify.retriable_failure(F.col("kind"), *diag).alias("retriable"), classify.looks_blocked(F.col("code"), F.col("html")).alias("blocked"))


_HOOKS = {"failed": turn(1, False, True, None), "status": turn(3, "ok", "failed", None), "mode": turn(5, "manual_ad", "manual_ad_failed", "search_page_failed", "dataset", None), "source": turn(7, "manual_ad_x", "crawl", None)}


@query(f"WITH {made_sql(_HOOKS)} SELECT ads_id, line, coalesce(failed, false) OR coalesce(status, '') = 'failed' OR coalesce(mode, '') IN ('manual_ad_failed', 'search_page_failed') AS failure, starts_with(coalesce(mode, ''), 'manual_ad') OR starts_with(coalesce(source, ''), 'manual_ad') AS manual FROM r")
def webhook_kinds(spark: SparkSession, d: str) -> DataFrame:
    """CLS29."""
    return made(spark, d, _HOOKS).select("ads_id", "line", classify.failure_webhook(F.col("failed"), F.col("status"), F.col("mode")).alias("failure"), classify.manual_payload(F.col("mode"), F.col("source")).alias("manual"))


_GOOD = ("https://site.test/ad/livres/123", "http://www.site.test/ad/jeux/9/", "HTTPS://a.b.site.test/ad/x/1?y=2")
_BAD = ("https://site.test.evil/ad/livres/123", "ftp://site.test/ad/livres/1", "https://site.test/ad/livres/12a", "https://mysite.test/ad/livres/1", "https://site.test/ad/1", "not a url", "", None)
_LINKS = {"url": turn(1, *_GOOD, *_BAD), "link": turn(3, "https://www.google.com/search?q=x", "https://google.fr/", "https://encrypted.gstatic.com/i", "https://x.test/doodle/1", "https://books.test/9780000000019", "https://www.google.com/books/1", "", None)}


@query(f"WITH {made_sql(_LINKS)} SELECT ads_id, line, coalesce(url IN {_GOOD!r}, false) AS direct, coalesce(link, '') NOT IN ('https://books.test/9780000000019', 'https://www.google.com/books/1') AS noise FROM r")
def url_tests(spark: SparkSession, d: str) -> DataFrame:
    """CLS30, CLS31."""
    return made(spark, d, _LINKS).select("ads_id", "line", classify.direct_listing_url(F.col("url"), "site.test").alias("direct"), classify.noise_url(F.col("link")).alias("noise"))


_FINAL = {"a": turn(1, "momox_price_found", "momox_no_offer", "momox_pending", "not_sent", None), "b": turn(5, "gibert_price_found", "gibert_non_repris", "gibert_missing", "gibert_pending", None), "candidate": turn(2, "no_isbn", "weak_candidate", "medium_candidate", "strong_candidate", None), "review": turn(3, "pending", "manual_review", None)}


@query(f"""WITH {made_sql(_FINAL)}, t AS (SELECT *, coalesce(a IN ('momox_price_found', 'momox_no_offer'), false) AS fa FROM r) SELECT ads_id, count(*) FILTER (fa) AS final_a, count(*) FILTER (fa OR b IN ('gibert_price_found', 'gibert_non_repris', 'gibert_missing')) AS with_result,
  count(*) FILTER (a = 'momox_pending' OR b = 'gibert_pending') AS pending, count(*) FILTER (review = 'manual_review' OR candidate IN ('no_isbn', 'weak_candidate', 'medium_candidate')) AS to_review FROM t GROUP BY 1""")
def final_state_counts(spark: SparkSession, d: str) -> DataFrame:
    """CLS33, CLS34."""
    a, b = F.col("a"), F.col("b")
    return made(spark, d, _FINAL).groupBy("ads_id").agg(
        F.count_if(classify.final_provider_a(a)).alias("final_a"), F.count_if(classify.has_provider_result(a, b)).alias("with_result"),
        F.count_if(classify.provider_pending(a, b)).alias("pending"), F.count_if(classify.needs_review_row(F.col("candidate"), F.col("review"))).alias("to_review"),
    )


_BOXES = {"x0": share(1), "y0": share(7), "x1": share(3), "y1": share(11), "orientation": turn(5, "vertical_up", "vertical_down", "horizontal", "tilted", "", None), "w": turn(13, 800, 1200), "h": turn(17, 600, 1000), "boxed": turn(19, True, True, True, False)}
_AREA = "abs(x1 - x0) * abs(y1 - y0)"
_SIGNED = "greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0)"



@query(f"""WITH {made_sql(_BOXES)}, z AS (SELECT *, CASE WHEN boxed THEN {_AREA} END AS area, CASE WHEN boxed THEN {_SIGNED} END AS signed, CASE WHEN boxed THEN least(x0, x1) ELSE 0.0 END AS a, CASE WHEN boxed THEN greatest(x0, x1) ELSE 1.0 END AS b,
  CASE WHEN boxed THEN least(y0, y1) ELSE 0.0 END AS c, CASE WHEN boxed THEN greatest(y0, y1) ELSE 1.0 END AS e FROM r),
p AS (SELECT *, greatest(0.0, least(1.0, a - (b - a) * 0.15)) AS pa, greatest(0.0, least(1.0, b + (b - a) * 0.15)) AS pb, greatest(0.0, least(1.0, c - (e - c) * 0.15)) AS pc, greatest(0.0, least(1.0, e + (e - c) * 0.15)) AS pe FROM z),
q AS (SELECT *, CAST(least(floor(pa * w + 0.5), w - 1) AS INT) AS lx, CAST(least(floor(pc * h + 0.5), h - 1) AS INT) AS ty FROM p)
SELECT ads_id, line, round(area, 9) AS area, coalesce(area >= 0.003 AND area < 0.98, false) AS worthy,
  CASE WHEN coalesce(area, 0) < 0.05 THEN 'poor' WHEN area < 0.3 THEN 'risky' ELSE 'good' END AS level, CASE WHEN coalesce(signed, 0) < 0.05 THEN 'tiny' WHEN signed < 0.3 THEN 'borderline' ELSE 'large' END AS size,
  lx AS "left", ty AS top, CAST(least(greatest(1, floor((pb - pa) * w + 0.5)), w - lx) AS INT) AS width, CAST(least(greatest(1, floor((pe - pc) * h + 0.5)), h - ty) AS INT) AS height,
  CASE orientation WHEN 'vertical_up' THEN -90 WHEN 'vertical_down' THEN 90 ELSE 0 END AS turn FROM q""")
def box_measures(spark: SparkSession, d: str) -> DataFrame:
    """CLS25, CLS35, NM5: each row's own box."""
    df = made(spark, d, _BOXES).withColumn("box", F.when(F.col("boxed"), F.array("x0", "y0", "x1", "y1")))
    box = F.col("box")
    return df.select(
        "ads_id", "line", F.round(numbers.bbox_area(box), 9).alias("area"), classify.crop_worthy(box).alias("worthy"), classify.crop_level(box).alias("level"), classify.crop_class(box).alias("size"),
        numbers.crop_rectangle(box, F.col("w"), F.col("h")).alias("crop"), numbers.rotation(F.col("orientation")).alias("turn"),
    ).select("ads_id", "line", "area", "worthy", "level", "size", "crop.*", "turn")


_MONEY = {"credits": turn(1, 0, 30, 45, None), "usd": turn(3, 0.004, 1, None), "units": turn(5, 0, 1, 7, 30), "tokens_in": turn(2, 1000, 123456, None), "tokens_out": turn(7, 10, 9999, None), "raw": turn(11, "12.5", "abc", "NaN", "", None, "1e3")}


@query(f"""WITH {made_sql(_MONEY)} SELECT ads_id, line, CAST(round(CAST(credits AS DECIMAL(18,6)) / nullif(units, 0), 4) AS DOUBLE) AS credits_per_unit, CAST(round(CAST(usd AS DECIMAL(18,6)) / nullif(units, 0), 6) AS DOUBLE) AS usd_per_unit,
  round((coalesce(tokens_in, 0) * 0.4 + coalesce(tokens_out, 0) * 1.6) / 1000000, 6) AS token_usd, CAST(CASE raw WHEN '12.5' THEN 12.5 WHEN '1e3' THEN 1000.0 END AS DOUBLE) AS number, CAST(CASE raw WHEN '12.5' THEN 12.5 WHEN '1e3' THEN 1000.0 ELSE 0.0 END AS DOUBLE) AS or_zero FROM r""")
def unit_costs(spark: SparkSession, d: str) -> DataFrame:
    """AG18, NM2, NM4, PR4."""
    from ..operators import ledger

    df = made(spark, d, _MONEY).withColumn("u", ledger.per_unit(F.col("credits"), F.col("usd"), F.col("units")))
    tokens = numbers.token_usd(F.col("tokens_in"), F.col("tokens_out"), 0.4, 1.6)
    return df.select("ads_id", "line", F.col("u.credits_per_unit").cast("double").alias("credits_per_unit"), F.col("u.usd_per_unit").cast("double").alias("usd_per_unit"), tokens.cast("double").alias("token_usd"), numbers.to_number(F.col("raw")).alias("number"), price.number_or_zero(F.col("raw")).alias("or_zero"))


_ALIASES = {"a": turn(1, None, "", "un"), "b": turn(3, "deux", None, ""), "c": turn(5, "trois", None), "idx": turn(2, 0, 1, 2, 3, None), "said": turn(7, "né en 1984", "1499", "20150", "paru 2011.", None, "x2001")}


@query(f"""WITH {made_sql(_ALIASES)} SELECT ads_id, line, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) AS best, coalesce(nullif(c, ''), nullif(a, ''), nullif(b, '')) AS compared, coalesce(nullif(a, ''), nullif(b, '')) AS image,
  CASE idx WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' ELSE 'first' END AS picture, CASE said WHEN 'né en 1984' THEN 1984 WHEN 'paru 2011.' THEN 2011 END AS year FROM r""")
def alias_picks(spark: SparkSession, d: str) -> DataFrame:
    """JS3, JN24, DT1."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    picture = misc.image_by_index(F.array(F.lit("p1"), F.lit("p2")), F.col("idx"), F.lit("first"))
    return made(spark, d, _ALIASES).select("ads_id", "line", misc.best_title(a, b, c).alias("best"), misc.comparison_title(c, a, b).alias("compared"), misc.provider_image(a, b).alias("image"), picture.alias("picture"), misc.year_in(F.col("said")).alias("year"))
