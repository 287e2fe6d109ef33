"""Similarity of titles, authors and candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .numbers import round_half_up


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def prefix_match(a: Column, b: Column, least: int = 12) -> Column:
    """Equal, or one is the start of the other at a word boundary; both have ``least`` characters or more."""
    long_enough = F.least(F.length(a), F.length(b)) >= least
    return long_enough & ((a == b) | F.startswith(b, F.concat(a, F.lit(" "))) | F.startswith(a, F.concat(b, F.lit(" "))))


def expanded_title_match(a: Column, b: Column) -> Column:
    """SIM7 over main titles with the unicode normaliser."""
    return prefix_match(T.normalize_unicode(T.main_title(a)), T.normalize_unicode(T.main_title(b)))


def main_title_prefix_match(a: Column, b: Column) -> Column:
    """SIM7 over main titles with the title normaliser."""
    return prefix_match(T.normalize_title(T.main_title(a)), T.normalize_title(T.main_title(b)))


def work_prefix_match(a: Column, b: Column) -> Column:
    """SIM7 over whole titles with the match normaliser."""
    return prefix_match(T.normalize_match(a), T.normalize_match(b))


def counted_similarity(shared: Column, n: Column, m: Column, match: Column) -> Column:
    """SIM1 of sets of n and m tokens with so many in common; ``match`` tells that a title is the other's safe prefix."""
    both, low, high = shared.cast("double"), F.least(n, m), F.greatest(n, m)
    strict = both / high
    inside = F.when(low >= 2, both / low).otherwise(0.0)
    rest = F.when(inside >= 0.85, F.greatest(strict, inside)).otherwise(strict)
    return F.when(low == 0, 0.0).otherwise(F.when(match, F.greatest(strict, F.lit(0.9))).otherwise(rest))


def token_similarity(a: Column, b: Column) -> Column:
    """SIM1: shared over the larger set; a safe prefix gives 0.9 at least, containment of 0.85 its own value."""
    x, y = T.similarity_tokens(a), T.similarity_tokens(b)
    return counted_similarity(_shared(x, y), F.size(x), F.size(y), expanded_title_match(a, b))


def jaccard(x: Column, y: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    both = _shared(x, y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both.cast("double") / (F.size(x) + F.size(y) - both))


def provider_title_similarity(a: Column, b: Column) -> Column:
    """SIM2: 1 if equal or contained either way, else the Jaccard similarity of longer words."""
    x, y = T.normalize_ascii(a), T.normalize_ascii(b)
    sets = [T.token_set(t, 3, T.STOP_PROVIDER) for t in (x, y)]
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(jaccard(*sets))


def union_title_similarity(a: Column, b: Column) -> Column:
    """SIM4: Jaccard similarity of words of two characters or more, 3 decimals."""
    return F.round(jaccard(T.token_set(T.normalize_ascii(a), 2), T.token_set(T.normalize_ascii(b), 2)), 3)


def titles_compatible(a: Column, b: Column) -> Column:
    """SIM5: at least half of the smaller token set is shared."""
    x, y = T.title_tokens(a), T.title_tokens(b)
    low = F.least(F.size(x), F.size(y))
    return (low > 0) & (_shared(x, y) * 2 >= low)


#: Topics of which two titles may not name different ones.
EXCLUSIVE_TOPICS = (
    ("chiffres", "nombres", "couleurs", "formes", "lettres", "alphabet", "animaux", "mots", "contraires", "saisons", "jours", "heure", "metiers", "fruits", "legumes"),
    ("diy", "bricolage", "pratique", "theorie", "theorique"),
)


def semantic_contradiction(a: Column, b: Column) -> Column:
    """SIM6: both titles name topics of one group, and none in common."""
    x, y = T.title_tokens(a), T.title_tokens(b)
    out = F.lit(False)
    for group in EXCLUSIVE_TOPICS:
        words = F.array(*[F.lit(w) for w in group])
        p, q = F.array_intersect(words, x), F.array_intersect(words, y)
        out = out | ((F.size(p) > 0) & (F.size(q) > 0) & ~F.arrays_overlap(p, q))
    return out


def _same_author(x: Column, y: Column, least: int) -> Column:
    def agree(n: Column) -> Column:
        p, q = T.token_list(n["x"], least), T.token_list(n["y"], least)
        parts = T.let(F.struct(p.alias("p"), q.alias("q")), lambda s: (F.size(s["p"]) >= 2) & (F.size(s["q"]) >= 2) & (F.size(F.filter(s["q"], lambda t: F.array_contains(s["p"], t))) >= 2))
        return (n["x"] != "") & (n["y"] != "") & (F.contains(n["x"], n["y"]) | F.contains(n["y"], n["x"]) | parts)

    return T.let(F.struct(x.alias("x"), y.alias("y")), agree)


def same_author(a: Column, b: Column) -> Column:
    """SIM8: equal, contained, or two parts of three letters or more in common."""
    return _same_author(T.normalize_author(a), T.normalize_author(b), 3)


def same_author_any_part(a: Column, b: Column) -> Column:
    """SIM8 for workflow rows: parts of any length count."""
    return _same_author(T.normalize_match(a), T.normalize_match(b), 1)


def detected_containment(detected: Column, lookup: Column) -> Column:
    """SIM9: share of the detected title's words, repeats included, that the other has; 0 below two words."""
    def share(s: Column) -> Column:
        hits = F.size(F.filter(s["x"], lambda t: F.array_contains(s["y"], t)))
        return F.when((F.size(s["x"]) < 2) | (F.size(s["y"]) == 0), 0.0).otherwise(hits.cast("double") / F.size(s["x"]))

    return T.let(F.struct(T.work_tokens(detected).alias("x"), T.work_tokens(lookup).alias("y")), share)


def title_only_score(detected: Column, provider: Column) -> Column:
    """SIM10: shared words over the larger set, 2 decimals."""
    x, y = T.token_set(T.normalize_unicode(detected), 3), T.token_set(T.normalize_unicode(provider), 3)
    high = F.greatest(F.size(x), F.size(y))
    return F.when(high == 0, 0.0).otherwise(round_half_up(_shared(x, y).cast("double") / high, 2))


def shared_tokens(a: Column, b: Column) -> Column:
    """SIM11: number of meaningful tokens in common."""
    return _shared(T.token_set(T.normalize_unicode(a), 3, T.STOP_SIMILARITY), T.token_set(T.normalize_unicode(b), 3, T.STOP_SIMILARITY))


def better_text(old: Column, new: Column) -> Column:
    """SIM12: the new text if the old is missing or shorter by more than two characters."""
    a, b = F.trim(T.text(old)), F.trim(T.text(new))
    return F.when(b == "", old).when((a == "") | (F.length(b) > F.length(a) + 2), new).otherwise(old)


def exact_title(title: Column, *queries: Column) -> Column:
    """SIM13: the title is one of the queries once normalised."""
    t = T.normalize_unicode(title)
    out = F.lit(False)
    for q in queries:
        out = out | ((T.normalize_unicode(q) == t) & (t != ""))
    return out


def article_insensitive_title(title: Column, *queries: Column) -> Column:
    """SIM13: the same token sets, whatever articles stand between."""
    t = T.token_key(title)
    out = F.lit(False)
    for q in queries:
        out = out | ((T.token_key(q) == t) & (t != ""))
    return out


def candidate_score(title_similarities: list[Column], author: Column, has_author: Column, title_weight: float = 0.8, author_weight: float = 0.2, bonus: float = 0.1, bonus_from: float = 0.9) -> Column:
    """SIM3: weighted best title similarity, plus the author's or, without an author, a bonus; 1 at most, 2 decimals."""
    best = F.greatest(*title_similarities, F.lit(0.0)) if title_similarities else F.lit(0.0)
    extra = F.when(has_author, F.coalesce(author, F.lit(0.0)) * author_weight).otherwise(F.when(best >= bonus_from, bonus).otherwise(0.0))
    return round_half_up(F.least(F.lit(1.0), best * title_weight + extra), 2)


def volume_score(title_similarities: list[Column], author: Column, has_author: Column, language: Column) -> Column:
    """SIM3 for the volumes source: other weights, and a little for the wanted language."""
    best = F.greatest(*title_similarities, F.lit(0.0))
    extra = F.when(has_author, F.coalesce(author, F.lit(0.0)) * 0.25).otherwise(F.when(best >= 0.9, 0.15).otherwise(0.0))
    return round_half_up(F.least(F.lit(1.0), best * 0.75 + extra + F.when(language == "fr", 0.05).otherwise(0.0)), 2)
