"""Classifiers: ladders of conditions over one row. The order of the branches is part of the result.

Every function takes Columns (or a dict of Columns, ``row``) and gives a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import similarity as S
from ..functions import text as T
from ..functions.numbers import bbox_area, bbox_signed_area, confidence, round_half_up


def s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return s(c) != ""


def is_in(c: Column, *values: str) -> Column:
    return s(c).isin(*values)


# --- listings

#: Words that speak for a book, weakly for a book, and for other goods.
STRONG_BOOK = (
    "livre", "livres", "roman", "romans", "bd", "bande dessinee", "bandes dessinees",
    "tome", "tomes", "isbn", "dictionnaire", "dictionnaires", "encyclopedie", "encyclopedies",
    "manuel", "manuels", "scolaire", "recueil", "biographie", "autobiographie",
    "auteur", "autrice", "romanesque",
)
WEAK_BOOK = (
    "manga", "mangas", "collection", "coffret", "poche", "edition", "editions",
    "lot", "enfant", "enfants", "histoire", "histoires", "volume", "volumes", "culturel",
)
NON_BOOK = (
    "dvd", "dvds", "blu ray", "bluray", "cd", "cds", "cd audio", "vinyle", "vinyles", "vinyl",
    "jeu video", "jeux video", "jeu de societe", "ps2", "ps3", "ps4", "ps5", "xbox", "switch",
    "nintendo", "wii", "console", "consoles", "manette",
    "puzzle", "puzzles", "jouet", "jouets", "figurine", "figurines", "peluche", "peluches", "lego",
    "pokemon", "affiche", "affiches", "poster", "posters", "meuble", "meubles",
    "cassette", "cassettes", "vhs", "magazine", "magazines", "journaux",
)


def _signals(corpus: Column, tokens: Column, words: tuple[str, ...]) -> Column:
    """The words that a corpus holds, in the order of ``words``: single ones by its set of tokens, phrases by search."""
    listed = F.array(*map(F.lit, words))
    phrases = [w for w in words if " " in w]
    one = F.array_intersect(listed, tokens)
    if not phrases:
        return one
    said = F.filter(F.array(*map(F.lit, phrases)), lambda w: F.contains(corpus, F.concat(F.lit(" "), w, F.lit(" "))))
    return T.let(F.concat(one, said), lambda hit: F.when(F.size(hit) < 2, hit).otherwise(F.array_intersect(listed, hit)))


def book_relevance(corpus: Column, strong=STRONG_BOOK, weak=WEAK_BOOK, other=NON_BOOK) -> Column:
    """CLS1: struct(relevant, confidence, reason, signals) of a padded corpus."""
    both = T.let(corpus, lambda c: F.struct(c.alias("c"), F.split(F.trim(c), " ").alias("t")))
    found = lambda x: F.struct(*[_signals(x["c"], x["t"], w).alias(n) for n, w in (("strong", strong), ("other", other), ("weak", weak))])
    return T.let(T.let(both, found), _verdict)


def _verdict(found: Column) -> Column:
    hit = [found["strong"], found["other"], found["weak"]]
    has = [F.size(h) > 0 for h in hit]
    none = F.array().cast("array<string>")
    reason = lambda name, h: F.concat(F.lit(name + ":"), F.get(h, F.lit(0)))
    return F.struct(
        F.when(has[0], True).when(has[1], False).otherwise(True).alias("relevant"),
        F.when(has[0] | has[1], "high").when(has[2], "medium").otherwise("low").alias("confidence"),
        F.when(has[0], reason("book_signal", hit[0])).when(has[1], reason("non_book_signal", hit[1])).when(has[2], reason("weak_book_signal", hit[2])).otherwise("no_clear_signal").alias("reason"),
        F.when(has[0], F.concat(hit[0], hit[2])).when(has[1], hit[1]).when(has[2], hit[2]).otherwise(none).alias("signals"),
    )


def rejected_as_non_book(verdict: Column) -> Column:
    return ~verdict["relevant"] & (verdict["confidence"] == "high")


# --- book numbers


def medium_promoted(row: dict[str, Column], cfg: Config = DEFAULT) -> Column:
    """A medium confidence is promoted if main title prefix and author agree (CLS5)."""
    conf = F.coalesce(row["isbn_confidence"], F.lit(0.0))
    detected = T.first_filled(row["possible_corrected_title"], row["title"], row["raw_visible_text"])
    ok = filled(row["isbn"]) & F.coalesce(row["isbn_is_valid"], F.lit(True)) & (conf >= cfg.weak_isbn) & (conf < cfg.strong_isbn)
    return ok & S.work_prefix_match(detected, row["lookup_title"]) & S.same_author_any_part(row["author"], row["lookup_authors"])


def accepted_number(row: dict[str, Column], cfg: Config = DEFAULT) -> Column:
    """CLS5: valid and strong, or promoted."""
    conf = F.coalesce(row["isbn_confidence"], F.lit(0.0))
    return filled(row["isbn"]) & F.coalesce(row["isbn_is_valid"], F.lit(True)) & ((conf >= cfg.strong_isbn) | medium_promoted(row, cfg))


#: Why a candidate is not simply sent: no number, a bad one, low confidence, promoted from the middle. Fixed values.
SKIP_REASONS = ("No valid ISBN found", "Invalid ISBN", "ISBN confidence below Momox threshold", "Medium ISBN promoted: main title prefix + author match")


def candidate_class(isbn: Column, valid: Column, conf: Column, promoted: Column | None = None, cfg: Config = DEFAULT) -> Column:
    """CLS2: struct(status, candidate_status, review_status, skip_reason) by confidence; medium and strong candidates have no skip reason."""
    c = F.coalesce(conf, F.lit(0.0))
    promoted = F.lit(False) if promoted is None else promoted
    ladder = lambda a, b, w, p, m, st: F.when(~filled(isbn), a).when(~F.coalesce(valid, F.lit(True)), b).when(c < cfg.weak_isbn, w).when((c < cfg.strong_isbn) & promoted, p).when(c < cfg.strong_isbn, m).otherwise(st)
    return F.struct(
        ladder("isbn_not_found", "isbn_invalid", "isbn_weak", "isbn_medium_promoted", "isbn_medium", "isbn_strong").alias("status"),
        ladder("no_isbn", "no_isbn", "weak_candidate", "medium_candidate", "medium_candidate", "strong_candidate").alias("candidate_status"),
        ladder("manual_review", "manual_review", "manual_review", "manual_review", "manual_review", "pending").alias("review_status"),
        ladder(*SKIP_REASONS, F.lit(None), F.lit(None)).alias("skip_reason"),
    )


def provider_eligibility(isbn: Column, valid: Column, conf: Column, source: Column, visible_isbn: Column, cfg: Config = DEFAULT) -> Column:
    """CLS3: struct(eligible, reason)."""
    c = F.coalesce(conf, F.lit(0.0))
    visible = is_in(source, "visible_isbn") | filled(visible_isbn)
    reason = (
        F.when(~filled(isbn), "no_isbn").when(~F.coalesce(valid, F.lit(True)), "isbn_invalid").when(visible, "visible_isbn")
        .when(c >= cfg.provider_min_confidence, "strong_isbn").when(c >= cfg.weak_isbn, "needs_verification_medium").otherwise("needs_verification_low")
    )
    return F.struct(reason.isin("visible_isbn", "strong_isbn").alias("eligible"), reason.alias("reason"))


def not_sent_reason(reason: Column) -> Column:
    """CLS4."""
    return F.when(~filled(reason), "not_eligible").when(F.startswith(reason, F.lit("needs_verification")), "isbn_confidence_below_threshold").otherwise(reason)


def strong_work_match(row: dict[str, Column]) -> Column:
    """CLS6."""
    detected = T.first_filled(row["possible_corrected_title"], row["title"])
    raw, lookup = row["raw_visible_text"], row["lookup_title"]
    high = (F.coalesce(row["raw_text_similarity"], F.lit(0.0)) >= 0.85) | (F.coalesce(row["best_title_similarity"], F.lit(0.0)) >= 0.85)
    prefix = S.work_prefix_match(detected, lookup) | S.work_prefix_match(raw, lookup) | S.work_prefix_match(T.main_title(detected), lookup)
    return filled(lookup) & (high | prefix | (S.detected_containment(detected, lookup) >= 0.85) | (S.detected_containment(raw, lookup) >= 0.85))


#: Titles that name no one book.
GENERIC_TITLES = ("alex cross", "cupid", "cupidon")


def generic_title(title: Column) -> Column:
    return T.normalize_unicode(title).isin(*GENERIC_TITLES)


def short_or_generic(title: Column) -> Column:
    return generic_title(title) | (F.size(T.similarity_tokens(title)) <= 1)


def accepted_resolution(row: dict[str, Column], strong_candidates: Column, exact_candidate: Column) -> Column:
    """CLS7: reason why a resolved book is not accepted, null if it is."""
    zero = lambda n: F.coalesce(row[n], F.lit(0.0))
    author = filled(row["author"])
    title = T.first_filled(row["possible_corrected_title"], row["title"], row["raw_visible_text"])
    return (
        F.when(title.isNull(), "no_title")
        .when(~filled(row["isbn"]) | ~F.coalesce(row["isbn_is_valid"], F.lit(False)), "no_valid_isbn")
        .when(~filled(row["lookup_title"]) | (zero("lookup_score") <= 0), "no_lookup")
        .when(zero("isbn_confidence") < 0.5, "low_confidence")
        .when(author & (zero("author_similarity") == 0), "author_mismatch")
        .when(~author & (strong_candidates > 1) & ~exact_candidate, "ambiguous_without_author")
        .when(~author & (zero("best_title_similarity") < 0.9), "title_below_0.9_without_author")
        .when(author & (zero("best_title_similarity") < 0.65), "title_below_0.65")
        .when(generic_title(row["title"]), "generic_title")
    )


def looks_truncated(c: Column) -> Column:
    t = F.trim(T.text(c))
    return (t != "") & ((F.length(t) <= 4) | t.rlike("[-–—…]$"))


def only_series(series: Column, title: Column) -> Column:
    a, b = T.normalize_unicode(series), T.normalize_unicode(title)
    return (a != "") & ((b == "") | (a == b))


def needs_crop_retry(row: dict[str, Column], weak: float = 0.5) -> Column:
    """CLS8."""
    croppable = ~is_in(row["isbn_source"], "visible_isbn") & F.coalesce(F.size(row["bbox"]) == 4, F.lit(False))
    weak_number = ~filled(row["isbn"]) | ~F.coalesce(row["isbn_is_valid"], F.lit(True)) | (F.coalesce(confidence(row["isbn_confidence"]), F.lit(0.0)) < weak)
    cut = F.coalesce(row["is_partial_or_occluded"], F.lit(False)) | looks_truncated(row["raw_visible_text"])
    return croppable & (weak_number | cut | only_series(row["series_name"], T.first_filled(row["possible_corrected_title"], row["title"])))


def crop_compatible(old_title: Column, crop_title: Column) -> Column:
    """CLS9: similar enough, or two meaningful tokens in common; a missing title conflicts with nothing."""
    return ~filled(old_title) | ~filled(crop_title) | (S.token_similarity(old_title, crop_title) >= 0.35) | (S.shared_tokens(old_title, crop_title) >= 2)


def crop_may_override(compatible: Column, level: Column, old_confidence: Column, crop_confidence: Column) -> Column:
    """CLS9: an incompatible read wins only on a good crop over a weak resolution."""
    return ~compatible & (level == "good") & (F.coalesce(old_confidence, F.lit(0.0)) < 0.5) & (F.coalesce(crop_confidence, F.lit(0.0)) >= 0.7)


def ai_candidate_safe(ai_confidence: Column, title_sim: Column, author_sim: Column, has_author: Column) -> Column:
    """CLS10: enough confidence and title; a very good title makes up for a wrong author."""
    title = F.coalesce(title_sim, F.lit(0.0))
    wrong_author = has_author & (F.coalesce(author_sim, F.lit(0.0)) == 0)
    return (F.coalesce(ai_confidence, F.lit(0.0)) >= 0.3) & (title >= F.when(wrong_author, 0.9).otherwise(0.65))


def strict_candidates(candidates: Column, query_title: Column) -> Column:
    """CLS11: for short or generic titles only exact or article-insensitive candidates stay, the latter at 0.05
    less, best score first."""
    kept = F.filter(candidates, lambda c: F.coalesce(c["exact_title_match"], F.lit(False)) | F.coalesce(c["article_insensitive_title_match"], F.lit(False)))
    zero = lambda c: F.coalesce(c["score"], F.lit(0.0))
    lowered = F.transform(kept, lambda c: c.withField("score", F.when(F.coalesce(c["exact_title_match"], F.lit(False)), zero(c)).otherwise(F.greatest(F.lit(0.0), round_half_up(zero(c) - 0.05, 2)))))
    order = F.array_sort(lowered, lambda a, b: F.when(zero(a) > zero(b), -1).when(zero(a) < zero(b), 1).otherwise(0))
    return F.when(short_or_generic(query_title), order).otherwise(candidates)


#: Queries that say that nothing is known.
BLOCKED_QUERIES = ("aucune idee", "unknown", "inconnu", "titre inconnu", "je ne sais pas")


def useful_query(query: Column) -> Column:
    """CLS12."""
    n = T.normalize_unicode(query)
    return (n != "") & ~n.isin(*BLOCKED_QUERIES) & (F.size(T.token_set(n, 3, T.STOP_SIMILARITY)) >= 2)


# --- provider states


def provider_a_state(provider_status: Column) -> Column:
    """CLS13 for provider A where its own status is kept."""
    v = s(provider_status)
    return F.when(v.isin("", "not_sent"), "not_sent").when(v == "momox_pending", "pending").when(v == "momox_failed", "failed").otherwise("done")


def provider_a_state_from_global(status: Column, price: Column) -> Column:
    """CLS13 for provider A from the row's status and price alone."""
    v = s(status)
    return (
        F.when(v.isin("momox_pending", "momox_pending_duplicate"), "pending")
        .when(v.isin("momox_error", "momox_lookup_failed"), "failed").when(price.isNull(), "not_sent").otherwise("done")
    )


def provider_b_state(provider_status: Column, checked_at: Column) -> Column:
    """CLS13 for provider B, old status names included."""
    v = s(provider_status)
    return (
        F.when(v == "not_sent", "not_sent").when(v == "gibert_pending", "pending").when(v.isin("gibert_failed", "gibert_lookup_failed"), "failed")
        .when(v.isin("gibert_price_found", "gibert_non_repris", "gibert_no_price", "gibert_missing") | checked_at.isNotNull(), "done").otherwise("not_sent")
    )


def provider_eligible(row: dict[str, Column]) -> Column:
    """CLS14: the row takes part in provider pricing."""
    status, cand = s(row["status"]), s(row["candidate_status"])
    out = status.isin("isbn_not_found", "isbn_invalid", "isbn_weak", "bad", "skipped") | cand.isin("weak_candidate", "no_isbn")
    touched = (~is_in(row["momox_status"], "", "not_sent")) | (~is_in(row["gibert_status"], "", "not_sent")) | row["gibert_checked_at"].isNotNull()
    named = status.isin("ready_for_resale_check", "isbn_alternative_candidate") | F.startswith(status, F.lit("momox_")) | F.startswith(status, F.lit("gibert_"))
    return filled(row["isbn"]) & ~out & (named | cand.isin("strong_candidate", "selected_edition", "alternative_edition") | is_in(row["admin_status"], "pending_edition_choice") | touched)


#: Reasons for not sending that ask for a human look.
REVIEW_REASONS = (
    "poor_crop_needs_cover_match", "poor_crop_unverified_budget", "poor_crop_selected_exact_low_confidence", "poor_crop_selected_exact_title_conflict",
    "cover_mismatch_needs_review", "catalog_needs_verification", "catalog_no_match", "ad_match_budget_reached", "not_eligible", "isbn_confidence_below_threshold",
)
HOLD_REASONS = (*REVIEW_REASONS, "needs_verification_medium", "needs_verification_low", "crop_retry_mismatch", "catalog_budget_no_cover_proof", "tiny_crop_cover_unconfirmed")


def review_when_unsent(row: dict[str, Column]) -> Column:
    status, cand = s(row["status"]), s(row["candidate_status"])
    never = ~filled(row["isbn"]) | is_in(row["admin_status"], "rejected") | cand.isin("rejected", "no_isbn") | status.isin("isbn_not_found", "isbn_invalid")
    grade = cand.isin("strong_candidate", "medium_candidate") | status.isin("isbn_strong", "isbn_medium", "isbn_medium_promoted")
    return ~never & (grade | is_in(row["not_sent_reason"], *REVIEW_REASONS))


def backend_status(row: dict[str, Column], a: Column, b: Column) -> Column:
    """CLS15: the precedence ladder over human decisions, number, image verdict, provider states and prices."""
    admin, cand, match = s(row["admin_status"]), s(row["candidate_status"]), s(row["provider_match_status"])
    zero = lambda n: F.coalesce(row[n].cast("double"), F.lit(0.0))
    priced = (zero("momox_price") > 0) | (zero("gibert_price") > 0)
    any_ = lambda v: (a == v) | (b == v)
    choice = admin.isin("pending_duplicate", "pending_edition_choice") | cand.isin("duplicate_selected", "duplicate_alternative")
    return (
        F.when((admin == "rejected") | (cand == "rejected"), "rejected")
        .when(admin == "validated", "ready_for_admin")
        .when(~filled(row["isbn"]), "detected_no_isbn")
        .when(match.isin("mismatch", "uncertain") | choice, "needs_admin_review")
        .when(any_("failed"), "provider_failed")
        .when(any_("pending"), "isbn_confirmed")
        .when(priced & match.isin("match", "likely_match"), "ready_for_admin")
        .when(priced, "provider_price_found")
        .when((a == "done") & (b == "done"), "provider_no_offer")
        .when(any_("done"), "isbn_confirmed")
        .when(review_when_unsent(row), "needs_admin_review")
        .otherwise("provider_not_sent")
    )


def hold_needs_review(isbn: Column, conf: Column, candidate_status: Column, status: Column, reason: Column) -> Column:
    """CLS16."""
    grade = is_in(candidate_status, "strong_candidate", "medium_candidate") | is_in(status, "isbn_strong", "isbn_medium", "isbn_medium_promoted") | (F.coalesce(conf, F.lit(0.0)) >= 0.5)
    return filled(isbn) & ~is_in(reason, "no_isbn", "isbn_invalid") & (grade | is_in(reason, *HOLD_REASONS))


def title_status(similarity: Column, cfg: Config = DEFAULT) -> Column:
    """CLS17."""
    return F.when(similarity < cfg.title_mismatch, "momox_title_mismatch").when(similarity < cfg.title_strong, "momox_price_found_needs_review").otherwise("momox_price_found")


def offer_decision(ok: Column, price: Column, url: Column, title: Column, similarity: Column, cfg: Config = DEFAULT) -> Column:
    """CLS18: status of one provider payload."""
    return (
        F.when(~F.coalesce(ok, F.lit(False)) | (F.coalesce(price, F.lit(0.0)) <= 0), "momox_no_price")
        .when(~F.contains(s(url), F.lit("/offer/")) | ~filled(title), "momox_not_real_offer").otherwise(title_status(similarity, cfg))
    )


def candidate_status_of(status: Column) -> Column:
    """CLS19: candidate status of a provider status."""
    names = {"momox_no_price": "resale_no_price", "momox_not_real_offer": "resale_not_real_offer", "momox_error": "resale_error", "momox_title_mismatch": "resale_title_mismatch"}
    out = F.lit("resale_price_found")
    for k, v in names.items():
        out = F.when(s(status) == k, v).otherwise(out)
    return out


def admin_status_of(status: Column, price: Column) -> Column:
    """CLS19: admin status of a provider result."""
    bad = is_in(status, "momox_no_price", "momox_not_real_offer", "momox_error", "momox_title_mismatch")
    return F.when(F.coalesce(price.cast("double"), F.lit(0.0)) > 0, "new").when(bad, "failed").otherwise("pending")


def review_status_of(status: Column, title_score: Column, cfg: Config = DEFAULT) -> Column:
    """CLS19: review status of a provider result."""
    return F.when((s(status) == "momox_price_found") & (F.coalesce(title_score, F.lit(0.0)) >= cfg.title_strong), "pending").otherwise("manual_review")


def provider_status_of(row_status: Column, global_status: Column) -> Column:
    """CLS19: provider A's own status of a batch row."""
    return F.when(row_status == "failed", "momox_failed").when((row_status == "no_offer") | (global_status == "momox_title_mismatch"), "momox_no_offer").otherwise("momox_price_found")


# --- images and covers


def vision_status(same_book: Column, conf: Column, cfg: Config = DEFAULT) -> Column:
    """CLS20."""
    yes = F.when(conf >= cfg.vision_match, "match").when(conf >= cfg.vision_likely, "likely_match").otherwise("uncertain")
    return F.when(same_book.isNull(), "uncertain").when(same_book, yes).otherwise(F.when(conf >= cfg.vision_likely, "mismatch").otherwise("uncertain"))


def strong_cover(status: Column, similarity: Column, conf: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce((status == "match") & (similarity >= cfg.cover_similarity) & (conf >= cfg.cover_confidence), F.lit(False))


def crop_level(box: Column, cfg: Config = DEFAULT) -> Column:
    """CLS25: poor, risky or good by the box's area; no box is poor."""
    a = F.coalesce(bbox_area(box), F.lit(0.0))
    return F.when(a < cfg.tiny_crop, "poor").when(a < cfg.large_crop, "risky").otherwise("good")


def crop_class(box: Column, cfg: Config = DEFAULT) -> Column:
    """CLS25: tiny, borderline or large; a reversed box is tiny."""
    a = F.coalesce(bbox_signed_area(box), F.lit(0.0))
    return F.when(a < cfg.tiny_crop, "tiny").when(a < cfg.large_crop, "borderline").otherwise("large")


def level_of_class(c: Column) -> Column:
    return F.when(c == "tiny", "poor").when(c == "borderline", "risky").otherwise("good")


def poor_or_risky(level: Column) -> Column:
    return level.isin("poor", "risky")


def crop_worthy(box: Column) -> Column:
    """CLS35: not a speck and not the whole frame."""
    a = bbox_area(box)
    return F.coalesce((a >= 0.003) & (a < 0.98), F.lit(False))


def title_proof(row: dict[str, Column]) -> Column:
    """CLS24: detected and looked-up titles agree and do not contradict each other."""
    d = T.first_filled(row["possible_corrected_title"], row["title"], row["raw_visible_text"])
    k = T.first_filled(row["lookup_title"], row["title"], row["possible_corrected_title"])
    return F.coalesce(d.isNotNull() & k.isNotNull() & ~S.semantic_contradiction(d, k) & (S.titles_compatible(d, k) | S.main_title_prefix_match(d, k)), F.lit(False))


def author_proof(row: dict[str, Column]) -> Column:
    return S.same_author(row["author"], row["lookup_authors"])


def author_no_conflict(row: dict[str, Column]) -> Column:
    return ~filled(row["author"]) | ~filled(row["lookup_authors"]) | author_proof(row)


def strong_text_proof(row: dict[str, Column], cfg: Config = DEFAULT) -> Column:
    valid = F.coalesce(row["isbn_is_valid"], F.lit(True)) & (F.coalesce(row["isbn_confidence"], F.lit(0.0)) >= cfg.catalog_strong)
    return valid & title_proof(row) & author_no_conflict(row)


def medium_text_proof(row: dict[str, Column], least: float = 0.6) -> Column:
    d = T.first_filled(row["possible_corrected_title"], row["title"], row["raw_visible_text"])
    valid = F.coalesce(row["isbn_is_valid"], F.lit(True)) & (F.coalesce(row["isbn_confidence"], F.lit(0.0)) >= least)
    return valid & S.main_title_prefix_match(d, T.first_filled(row["lookup_title"], row["title"], row["possible_corrected_title"])) & author_proof(row)


def own_cover_mismatch(status: Column, conf: Column, cfg: Config = DEFAULT) -> Column:
    return F.coalesce((status == "mismatch") & (conf >= cfg.cover_confidence), F.lit(False))


def gate_label(eligible: Column, decision: Column, reason: Column) -> Column:
    held = F.coalesce(T.first_filled(reason, decision), F.lit("held"))
    return F.when(~eligible, held).when(reason == "cover_verified_edition_ambiguous", reason).otherwise(T.first_filled(decision, reason))


def catalog_gate(row: dict[str, Column], cfg: Config = DEFAULT) -> Column:
    """CLS23: struct(eligible, reason) of a book at the catalogue gate.

    ``row``: visible_sendable, strong_sendable, medium_sendable, crop_mismatch, budget_left (booleans), level,
    decision (of the covers), selected_sendable, selected_valid, selected_confidence, selected_title_ok,
    selected_contradiction, own_valid, own_confidence, own_cover_status, own_cover_similarity,
    own_cover_confidence, own_title_ok. Branches in order: visible number; nothing sendable; good crop without
    and with budget; poor or risky crop without budget; an exact cover selection; an own number whose cover is
    verified; the reasons to hold.
    """
    flag = lambda n: F.coalesce(row[n], F.lit(False))
    level = F.when(flag("crop_mismatch") & ~flag("visible_sendable"), "poor").otherwise(row["level"])
    good, exact = level == "good", (row["decision"] == "selected_exact_isbn") & flag("selected_sendable")
    strong, medium = flag("strong_sendable"), flag("medium_sendable")
    low = ~flag("selected_valid") | (F.coalesce(row["selected_confidence"], F.lit(0.0)) < cfg.catalog_medium)
    conflict = ~flag("selected_title_ok") | flag("selected_contradiction")
    own_cover = row["own_cover_status"].isin("match", "likely_match") & (row["own_cover_confidence"] >= cfg.cover_confidence) & (row["own_cover_similarity"] >= cfg.cover_similarity)
    own_ok = flag("own_valid") & (F.coalesce(row["own_confidence"], F.lit(0.0)) >= cfg.catalog_strong) & F.coalesce(own_cover, F.lit(False)) & flag("own_title_ok")
    reason = (
        F.when(flag("visible_sendable"), "visible_isbn")
        .when(~strong & ~medium, F.when(level == "poor", "crop_too_small").otherwise("needs_verification"))
        .when(good & ~flag("budget_left"), F.when(strong, "strong_isbn_budget").when(medium, "medium_fallback").otherwise("ad_match_budget_reached"))
        .when(good & row["decision"].isin("selected_exact_isbn", "selected_cover_ambiguous_isbn") & flag("selected_sendable"), row["decision"])
        .when(good & strong, "strong_isbn_catalog_unconfirmed")
        .when(good & medium, "medium_fallback")
        .when(good, F.when(row["decision"] == "no_match", "catalog_no_match").otherwise("catalog_needs_verification"))
        .when(~flag("budget_left"), F.when(flag("crop_mismatch"), "crop_retry_mismatch").otherwise("catalog_budget_no_cover_proof"))
        .when(exact & low, "poor_crop_selected_exact_low_confidence")
        .when(exact & conflict, "poor_crop_selected_exact_title_conflict")
        .when(exact, "poor_crop_cover_verified")
        .when(own_ok, "cover_verified_edition_ambiguous")
        .when(own_cover_mismatch(row["own_cover_status"], row["own_cover_confidence"], cfg), "cover_mismatch_needs_review")
        .when(flag("crop_mismatch"), "crop_retry_mismatch")
        .when(level == "poor", "tiny_crop_cover_unconfirmed")
        .otherwise("poor_crop_needs_cover_match")
    )
    sent = (
        "visible_isbn", "strong_isbn_budget", "medium_fallback", "selected_exact_isbn", "selected_cover_ambiguous_isbn",
        "strong_isbn_catalog_unconfirmed", "poor_crop_cover_verified", "cover_verified_edition_ambiguous",
    )
    return F.struct(reason.isin(*sent).alias("eligible"), reason.alias("reason"))


def fallback_trigger(enabled: Column, detected: Column, eligible: Column, cfg: Config = DEFAULT) -> Column:
    """CLS26: struct(trigger, reason) for the fallback of a listing."""
    counts = F.concat(detected.cast("string"), F.lit("/"), eligible.cast("string"), F.lit(")"))
    sparse = (detected >= cfg.fallback_min_detected) & (eligible <= cfg.fallback_max_eligible)
    reason = F.when(~enabled, "disabled").when(eligible == 0, "zero_eligible").when(sparse, F.concat(F.lit("sparse("), counts)).otherwise(F.concat(F.lit("ok("), counts))
    return F.struct((enabled & ((eligible == 0) | sparse)).alias("trigger"), reason.alias("reason"))


def verify_priority(a_image: Column, b_image: Column, a_price: Column, b_price: Column, candidate_status: Column) -> Column:
    """CLS32: −1 without image and price, 100 and the price gap (20 at most) with a price, else by candidate."""
    a, b = F.coalesce(a_price.cast("double"), F.lit(0.0)), F.coalesce(b_price.cast("double"), F.lit(0.0))
    priced = (a > 0) | (b > 0)
    gap = F.least(F.lit(20.0), F.floor(F.abs(a - b) + 0.5).cast("double")).cast("int")
    return (
        F.when(~filled(a_image) & ~filled(b_image) & ~priced, -1).when(priced, gap + 100)
        .when(is_in(candidate_status, "duplicate_alternative", "alternative_edition"), 80).when(is_in(candidate_status, "medium_candidate", "weak_candidate"), 60).otherwise(40)
    )


def final_provider_a(status: Column) -> Column:
    """CLS33."""
    return is_in(status, "momox_price_found", "momox_no_offer")


def has_provider_result(a_status: Column, b_status: Column) -> Column:
    return is_in(a_status, "momox_price_found", "momox_no_offer") | is_in(b_status, "gibert_price_found", "gibert_non_repris", "gibert_missing")


def provider_pending(a_status: Column, b_status: Column) -> Column:
    return is_in(a_status, "momox_pending") | is_in(b_status, "gibert_pending")


def needs_review_row(candidate_status: Column, review_status: Column) -> Column:
    """CLS34."""
    return is_in(review_status, "manual_review") | is_in(candidate_status, "no_isbn", "weak_candidate", "medium_candidate")


# --- failures, webhooks, URLs

#: Stages in which a form scenario failed.
FORM_STAGES = ("input_missing", "fill_error", "fill_unverified", "submit_missing")


def modal_blocked(stage: Column, fill_stage: Column, cookie_visible: Column) -> Column:
    return is_in(stage, "consent_modal_blocked") | is_in(fill_stage, "consent_modal_blocked") | F.coalesce(cookie_visible, F.lit(False))


def failure_kind(stage: Column, fill_stage: Column, cookie_visible: Column, reason: Column) -> Column:
    """CLS27."""
    r = F.lower(s(reason))
    return (
        F.when(modal_blocked(stage, fill_stage, cookie_visible), "consent_modal_blocked").when(is_in(stage, *FORM_STAGES), "scenario_form_failure")
        .when(r.rlike("consent|cookie"), "consent_modal_blocked")
        .when(r.rlike("no product rows|not present in the page|did not submit|#add_sao|input\\[name"), "scenario_form_failure").otherwise("http_error")
    )


def retriable_failure(kind: Column, stage: Column, fill_stage: Column, cookie_visible: Column) -> Column:
    return (s(kind) != "consent_modal_blocked") & ~modal_blocked(stage, fill_stage, cookie_visible) & is_in(stage, "post_submit")


def looks_blocked(status_code: Column, html: Column) -> Column:
    head = F.lower(F.substring(s(html), 1, 4000))
    wall = head.rlike("please verify to continue|just a moment") | (head.rlike("cf-challenge|challenge-platform|cloudflare") & F.contains(head, F.lit("challenge")))
    return F.coalesce(status_code.isin(403, 429, 503), F.lit(False)) | wall


def job_error_code(message: Column) -> Column:
    """CLS28."""
    m = F.lower(s(message))
    return (
        F.when(m.rlike("timestamp"), "invalid_payload_timestamp").when(m.rlike("unsupported.*mode|unknown.*mode"), "unsupported_webhook_mode")
        .when(m.rlike("duplicate key|unique constraint"), "duplicate_payload").when(F.contains(m, F.lit("timeout")), "payload_processing_timeout").otherwise("apify_payload_processing_failed")
    )


def failure_webhook(failed: Column, status: Column, mode: Column) -> Column:
    """CLS29."""
    return F.coalesce(failed, F.lit(False)) | is_in(status, "failed") | is_in(mode, "manual_ad_failed", "search_page_failed")


def manual_payload(mode: Column, source: Column) -> Column:
    return F.startswith(s(mode), F.lit("manual_ad")) | F.startswith(s(source), F.lit("manual_ad"))


def direct_listing_url(url: Column, host: str) -> Column:
    """CLS30: http(s), the site or one of its sub-hosts, path /ad/<category>/<digits>."""
    u = F.trim(s(url))
    part = lambda p: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit(""))
    h = F.lower(part("HOST"))
    return F.lower(part("PROTOCOL")).isin("http", "https") & ((h == host) | F.endswith(h, F.lit("." + host))) & part("PATH").rlike("^/ad/[^/]+/[0-9]+/?$")


def noise_url(url: Column) -> Column:
    """CLS31: nothing, or a search engine's own pages and images."""
    u = F.lower(s(url))
    own = u.rlike("//(www\\.)?google\\.[a-z.]+/?($|[?#])") | u.rlike("//(www\\.)?google\\.[a-z.]+/(search|imgres|url|preferences|setprefs)\\b")
    return (u == "") | u.rlike("gstatic\\.com|googlelogo|/doodle") | own
