"""Similarity joins of token sets that look at promising pairs alone.

Tokens are numbered from the rarest to the most frequent. A pair that meets
first at place i of one set and place j of the other (in that order) has at most
min(n - i, m - j) tokens in common, which bounds any similarity that grows with
them. Seeds, pairs that share one of a set's rarest tokens, are scored first; their
best (or k-th best) score is the bound below which no pair is looked at, so the
frequent tokens, which stand last in every set, hardly make any. Every pair that
is left is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import stored as _stored

#: (shared, n, m) to a similarity that does not fall as shared grows.
Measure = Callable[[Column, Column, Column], Column]
#: Rarest tokens of a set that seeds share.
SEED_TOKENS = 3
#: Parts that the rows of a frequent token are dealt into, and the left sets a token is frequent from.
SALTS, FREQUENT = 16, 1000


def jaccard(shared: Column, n: Column, m: Column) -> Column:
    return shared.cast("double") / (n + m - shared)


@dataclass
class TokenSets:
    """Both sides with their tokens as numbers: ``left`` (l, n, codes), ``right`` (r, m, codes), ``places`` (code, r, m,
    m_left). n and m count all tokens, codes are those of both sides' vocabulary, rarest first; frequent ones are odd."""

    left: DataFrame
    right: DataFrame
    places: DataFrame

    @staticmethod
    def of(left: DataFrame, right: DataFrame) -> TokenSets:
        """From (l, tokens) and (r, tokens): distinct keys, sets of distinct tokens. Empty sets meet nothing."""
        each_l = left.select("l", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        each_r = right.select("r", F.size("tokens").alias("m"), F.explode("tokens").alias("token"))
        # texts are cut into tokens once; what the right side does not have is left behind
        each_l = _stored(each_l.join(each_r.select("token").distinct(), "token", "left_semi"), "shared-tokens")
        seen = each_l.groupBy("token").agg(F.count("*").alias("df"))
        # numbers follow the order because they grow within and over the partitions of a sorted frame
        words = _stored(seen.orderBy("df", "token").select("token", (F.monotonically_increasing_id() * 2 + F.when(F.col("df") >= FREQUENT, 1).otherwise(0)).alias("code")), "words")

        def numbered(each: DataFrame, key: str, size: str) -> DataFrame:
            return each.join(words, "token").groupBy(key, size).agg(F.sort_array(F.collect_list("code")).alias("codes"))

        lefts, rights = _stored(numbered(each_l, "l", "n"), "left-sets"), _stored(numbered(each_r, "r", "m"), "right-sets")
        places = rights.select("r", "m", F.size("codes").alias("size"), F.posexplode("codes").alias("j", "code"))
        return TokenSets(lefts, rights, places.select("code", "r", "m", (F.col("size") - F.col("j")).alias("m_left")))

    def met(self, measure: Measure, left: DataFrame, bound: Column, rights: DataFrame | None = None) -> DataFrame:
        """(l, r, n, m, shared) of the pairs that share one of the tokens ``left`` (l, n, n_left, code) asks for and whose measure can reach ``bound`` (over n, m, l and r's columns)
        with the tokens from the first that ``left`` asks for on; pairs that share earlier ones too may be left out."""
        places = self.places if rights is None else self.places.join(rights, "r")
        frequent = F.col("code") % 2 == 1
        salts = F.when(frequent, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        asked = left.withColumn("salt", F.when(frequent, F.pmod(F.xxhash64("l"), F.lit(SALTS)).cast("int")).otherwise(0))
        pairs = asked.join(places.withColumn("salt", F.explode(salts)), ["code", "salt"])
        most = measure(F.least("n_left", "m_left"), F.col("n"), F.col("m"))
        pairs = pairs.filter(most >= bound).groupBy("l", "r", "n", "m").agg(F.count("*").alias("__tokens"), F.min(F.least("n_left", "m_left")).alias("__rest"), F.max(bound).alias("__least"))
        # what meets here comes first in both sets; after the last of it no more than its rest can follow
        pairs = pairs.filter(measure(F.col("__tokens") + F.col("__rest") - 1, F.col("n"), F.col("m")) >= F.col("__least")).select("l", "r", "n", "m")
        full = pairs.join(self.left.select("l", F.col("codes").alias("x")), "l").join(self.right.select("r", F.col("codes").alias("y")), "r")
        return full.select("l", "r", "n", "m", F.size(F.array_intersect("x", "y")).alias("shared"))

    def asked(self, first: int, last: int | None) -> DataFrame:
        """(l, n, n_left, code): a row for each token of the left sets at places ``first`` to ``last``."""
        codes = F.slice("codes", first + 1, F.lit(2**30) if last is None else F.lit(last - first))
        rows = self.left.select("l", "n", F.size("codes").alias("size"), F.posexplode(codes).alias("i", "code"))
        return rows.select("l", "n", (F.col("size") - F.col("i") - first).alias("n_left"), "code")


def best_of_left(left: DataFrame, right: DataFrame, measure: Measure = jaccard) -> DataFrame:
    """(l, score): the highest measure of each left set to any right set with which it shares a token."""
    sets = TokenSets.of(left, right)
    score = measure(F.col("shared"), F.col("n"), F.col("m"))
    seeds = _stored(sets.met(measure, sets.asked(0, SEED_TOKENS), F.lit(0.0)).groupBy("l").agg(F.max(score).alias("score")), "seeds")
    rest = sets.asked(SEED_TOKENS, None).join(seeds.withColumnRenamed("score", "least"), "l", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    # a set's own bound before it meets anything: no right set is smaller than what is shared
    rest = rest.filter(measure(F.col("n_left"), F.col("n"), F.col("n_left")) > F.col("least"))
    more = sets.met(measure, rest, F.col("least")).groupBy("l").agg(F.max(score).alias("score"))
    return seeds.union(more).groupBy("l").agg(F.max("score").alias("score"))


def best_by_group(left: DataFrame, right: DataFrame, members: DataFrame, measure: Measure, extra: DataFrame | None = None) -> DataFrame:
    """(g, score): the highest measure of any left set of a group to any right set. ``members`` has (g, l); ``extra``
    (l, r, score) are pairs that are scored elsewhere."""
    sets, seeds = _seeded(left, right, measure, extra)
    in_group = members.join(seeds.groupBy("l").agg(F.max("score").alias("score")), "l").groupBy("g").agg(F.max("score").alias("score"))
    # a set is wanted as long as it can be the best of one of its groups
    least = members.join(in_group, "g", "left").groupBy("l").agg(F.min(F.coalesce("score", F.lit(0.0))).alias("least"))
    found = _beyond(sets, measure, measure, left_bound=least)
    return members.join(seeds.unionByName(_instead(found, extra, False)).groupBy("l").agg(F.max("score").alias("score")), "l").groupBy("g").agg(F.max("score").alias("score"))


def top_by_right(left: DataFrame, right: DataFrame, members: DataFrame, measure: Measure, k: int, extra: DataFrame | None = None, rank_by: Callable[[Column], Column] = lambda score: score) -> DataFrame:
    """(r, g, score): pairs of a right set and a group, scored by the group's best set, with all pairs of a score above 0
    whose ``rank_by`` (which does not fall as the score grows) reaches the k-th best of the right set; of others maybe some, by a set that need not be their best."""
    sets, seeds = _seeded(left, right, measure, extra)
    by_group = lambda pairs: pairs.join(members, "l").groupBy("r", "g").agg(F.max("score").alias("score")).filter("score > 0")
    kth = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "g"))
    ranked = by_group(seeds).withColumn("at", kth).filter(F.col("at") == k).select("r", rank_by(F.col("score")).alias("least"))
    found = _beyond(sets, measure, lambda shared, n, m: rank_by(measure(shared, n, m)), right_bound=ranked)
    return by_group(seeds.unionByName(_instead(found, extra, False)))


def _seeded(left: DataFrame, right: DataFrame, measure: Measure, extra: DataFrame | None) -> tuple[TokenSets, DataFrame]:
    sets = TokenSets.of(left, right)
    score = measure(F.col("shared"), F.col("n"), F.col("m")).alias("score")
    seeds = sets.met(measure, sets.asked(0, SEED_TOKENS), F.lit(0.0)).select("l", "r", score)
    return sets, _stored(_instead(seeds, extra), "seeds")


def _instead(pairs: DataFrame, extra: DataFrame | None, add: bool = True) -> DataFrame:
    """The pairs without those of ``extra``, whose scores hold, and these if ``add``."""
    if extra is None:
        return pairs
    rest = pairs.join(extra.select("l", "r"), ["l", "r"], "left_anti").select("l", "r", "score")
    return rest.unionByName(extra.select("l", "r", "score")) if add else rest


def _beyond(sets: TokenSets, measure: Measure, bounded: Measure, left_bound: DataFrame | None = None, right_bound: DataFrame | None = None) -> DataFrame:
    """(l, r, score) of the pairs that the seeds do not share a token with, and that reach the bound."""
    asked, rights = sets.asked(SEED_TOKENS, None), None
    if left_bound is not None:
        asked = asked.join(left_bound, "l", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    else:
        rights = sets.right.select("r").join(right_bound, "r", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    return sets.met(bounded, asked, F.col("least"), rights).select("l", "r", measure(F.col("shared"), F.col("n"), F.col("m")).alias("score"))


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, n, m, shared): pairs that share at least half of the smaller set's tokens.

    The bound is a number of tokens here, so there are no seeds: a pair has one of the first tokens of its smaller set in
    common, all but half of them, and at every token in common enough may follow.
    """
    sets = TokenSets.of(left, right)
    enough: Measure = lambda shared, n, m: shared * 2 - F.least(n, m)
    return sets.met(enough, sets.asked(0, None), F.lit(0)).filter(F.col("shared") * 2 >= F.least("n", "m"))
