"""Document fingerprints by I-Match with randomised lexicons, in DataFrame operations alone.

The lexicon holds the terms whose document frequency lies in a band of
inverse document frequency. Many small random subsets of it are drawn by hash, so
few terms of a text fall into each; for each subset, the sorted list of a
text's distinct terms in it is hashed. Texts that have the same terms of a subset
share that part of the fingerprint, and an edit changes only the parts of the
subsets whose terms it touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, shuffle_width, text_or_empty

#: What separates terms: runs of ASCII bytes that are no letters or digits.
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Shares of all documents between which a lexicon term's document frequency lies. The lexicon has at most
#: (mean distinct terms of a document) / LOW terms, whatever the corpus size; so it can be broadcast.
LOW, HIGH = 0.005, 0.2
#: One in how many terms a subset has, and how many subsets there are of each rate: the first for texts of up to a few
#: hundred lexicon terms, the second for longer ones.
RATES, EACH = (64, 512), 24


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), BREAK))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, parts) of the terms in the band: the numbers of the subsets they are in."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = seen.filter((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n) & (F.col("term") != ""))
    every = F.sequence(F.lit(0), F.lit(len(RATES) * EACH - 1))
    rate = lambda j: F.get(F.array(*[F.lit(r) for r in RATES]), (j / EACH).cast("int"))
    parts = F.filter(every, lambda j: F.pmod(F.xxhash64("term", j), rate(j)) == 0)
    # the empty term is in each text's list, with a part of its own, so that no text is lost by the join
    none = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array(F.lit(-1)).alias("parts"))
    return band.select("term", parts.alias("parts")).union(none)


def interval(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the value: by groups of cuts, then in one group."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    longs = lambda x: F.array(*[F.lit(c).cast("long") for c in x])
    below = lambda edges: F.size(F.filter(edges, lambda c: c <= value))
    group = below(longs([g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(F.get(F.array(*map(longs, groups)), group - 1)))


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ord, flag, doc_id, text, next_text): documents in order of id (nulls first, then text) with
    the text that follows, the first after the last.

    The ids' quantiles cut the order into buckets, each sorted by a task of its own. A bucket ends with a
    copy of the next one's first row (flag 1), so that its last row has its follower at hand.
    """
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(interval(F.col("doc_id"), sorted(set(map(int, cuts)))))
    docs = docs.withColumn("bucket", bucket.cast("int"))
    ends = docs.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("bucket").collect()  # one row a bucket
    firsts = [None if r["nulls"] else r["least"] for r in ends]
    after = [(r["bucket"], firsts[(i + 1) % len(ends)]) for i, r in enumerate(ends)]
    rows = docs.select("bucket", F.lit(0).alias("flag"), "doc_id", "text")
    if after:
        follow = F.broadcast(spark.createDataFrame(after, "target int, first long"))
        marks = docs.join(follow, docs.doc_id.eqNullSafe(follow["first"])).select(F.col("target").alias("bucket"), F.lit(1).alias("flag"), "doc_id", "text")
        rows = rows.union(marks)
    order = Window.partitionBy("bucket").orderBy("flag", F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("bucket", F.row_number().over(order).alias("ord"), "flag", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited_text(text: Column, n_chars: Column, other: Column) -> Column:
    """The last half of ``text`` replaced by as many first characters of ``other``."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - half).cast("int")), F.substring(other, F.lit(1), half))


def likeness(a: Column, b: Column) -> Column:
    """Of the subsets in which either text has a term, the share for which both have the same (arrays of part and hash)."""
    either = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: x["j"])))
    return F.size(F.array_intersect(a, b)).cast("double") / either


def printed(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.concat(F.lpad(F.hex(x["j"] + 1), 2, "0"), F.lit(":"), F.lpad(F.hex(x["h"]), 16, "0"))), "-")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint lists the subsets in which the text has terms, each with the hash of its sorted terms there. Null
    text counts as empty. A text without such a term has its whole text's hash instead, so that unlike short texts do
    not look alike. Rows with equal ids follow each other by text; repeated rows stay; a single document
    follows itself; an empty table gives no rows.
    """
    docs = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    words = lexicon(docs, low, high)
    rows = in_order(docs, max(2, 8 * shuffle_width(docs.sparkSession)))
    n = F.length("text")
    rows = rows.select("bucket", "ord", "flag", "doc_id", n.cast("long").alias("n_chars"), "text", edited_text(F.col("text"), n, F.coalesce("next_text", F.lit(""))).alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "code0": F.xxhash64("text"), "code1": F.xxhash64("edited")})
    about = F.struct("flag", "doc_id", "n_chars", "edited_sha256", "code0", "code1")
    both = rows.select("bucket", "ord", about.alias("about"), F.posexplode(F.array("text", "edited")).alias("which", "body"))
    each = both.select("bucket", "ord", "about", "which", F.explode(F.array_union(F.array(F.lit("")), terms(F.col("body")))).alias("term"))
    each = each.join(F.broadcast(words), "term").withColumn("about", F.when((F.col("term") == "") & (F.col("which") == 0), F.col("about")))
    # outer: else Catalyst infers a filter on parts and works it out below the count of the lexicon's terms
    each = each.select("bucket", "ord", "about", "which", F.explode_outer("parts").alias("j"), "term").filter("j is not null")
    each = each.select("bucket", "ord", "about", F.struct("which", "j", "term").alias("x"))
    # a text's rows lie within its bucket, so that nothing is shuffled again
    prints = each.groupBy("bucket", "ord").agg(F.sort_array(F.collect_list("x")).alias("all"), F.first("about", True).alias("about"))

    def of(which: int) -> Column:
        mine = F.filter("all", lambda x: (x["which"] == which) & (x["j"] >= 0))
        each = F.array_distinct(F.transform(mine, lambda x: x["j"]))
        hashed = lambda j: F.xxhash64(F.transform(F.filter("all", lambda x: (x["j"] == j) & (x["which"] == which)), lambda x: x["term"]))
        parts = F.transform(each, lambda j: F.struct(j.alias("j"), hashed(j).alias("h")))
        return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.struct(F.lit(-1).alias("j"), F.col(f"about.code{which}").alias("h"))))

    prints = prints.select("bucket", "ord", "about.*", of(0).alias("own"), of(1).alias("changed"))
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("ord"))
    out = prints.withColumn("following", following).filter("flag = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
