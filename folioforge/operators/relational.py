"""Joins, dedupe, top-k, windows and set operations that recur in the library.

Order matters in "first wins" rules, so these operators take an explicit order
(one or more columns that break all ties).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .classify import strong_cover

Keys = Sequence[str]


def _row_number(df: DataFrame, keys: Keys, order: Sequence, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_wins(df: DataFrame, keys: Keys, order: Sequence) -> DataFrame:
    """AG9, AG10, WN2, WN3: one row per key, the first in ``order``."""
    return _row_number(df, keys, order, "__rn").filter("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: Keys, order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """WN1, WN4, TK7, TK9: the first ``n`` rows of each key, optionally with their rank."""
    out = _row_number(df, keys, order, rank or "__rn").filter(F.col(rank or "__rn") <= n)
    return out if rank else out.drop("__rn")


def last_n(df: DataFrame, keys: Keys, newest: Sequence, oldest: Sequence, n: int) -> DataFrame:
    """WN1: the newest ``n`` of each key (1 to 50), in ascending order."""
    return top_per_key(df, keys, newest, max(1, min(n, 50))).orderBy(*keys, *oldest)


def queue_head(df: DataFrame, order: Sequence, n: int = 1, most: int = 1000) -> DataFrame:
    """TK1 to TK4, TK10, TK11: the first rows of one order, the number clamped to 1 .. ``most``."""
    return df.orderBy(*order).limit(max(1, min(n, most)))


def exactly_one(df: DataFrame) -> DataFrame:
    """TK12: the only row, or none if there are several."""
    two = df.limit(2)
    return two.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0)))).filter("__n = 1").drop("__n")


def batches(df: DataFrame, keys: Keys, order: Sequence, size: int, name: str = "batch_no") -> DataFrame:
    """TK14: numbers batches of ``size`` rows inside each key from 0."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.floor((rn - 1) / size).cast("int"))


def requested_join(requested: DataFrame, offers: DataFrame, key: str, order: Sequence) -> DataFrame:
    """JN1: offers of requested keys, one per key (first in ``order``)."""
    return requested.join(first_wins(offers, [key], order), key, "inner")


def missing(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """JN2: requested keys without an offer."""
    return requested.join(found, key, "left_anti")


def with_default(requested: DataFrame, offers: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """JN3: all requested keys; values of missing offers by default."""
    joined = requested.join(offers.withColumn("__hit", F.lit(True)), key, "left")
    for c, d in defaults.items():
        joined = joined.withColumn(c, F.when(F.col("__hit"), F.col(c)).otherwise(d))
    return joined.drop("__hit")


def expand_results(books: DataFrame, results: DataFrame, key: str = "isbn") -> DataFrame:
    """JN4: each result on all books with its number; failed chunks are left out. Catalyst picks the join."""
    return books.join(results.filter("status <> 'failed_chunk'") if "status" in results.columns else results, key, "inner")


def best_candidates(books: DataFrame, candidates: DataFrame, query: str = "query_key", key: Keys = ("book_id", "isbn"), cfg: Config = DEFAULT) -> DataFrame:
    """JN5, AG9, WN4: candidates of a book's queries, the best score of each number, ranked, with a selected flag.

    ``books`` has book_id and the query key, ``candidates`` the query key, isbn, score and ord.
    """
    best = first_wins(books.join(candidates, query), key, [F.desc("score"), "ord"])
    ranked = top_per_key(best, ["book_id"], [F.desc("score"), "ord", "isbn"], cfg.candidates_kept, "rank")
    return ranked.withColumn("selected", F.col("rank") == 1)


def merge_flags(candidates: DataFrame, key: Keys, order: Sequence[str], flag: str, attributes: Sequence[str]) -> DataFrame:
    """AG11, ST2: one row per key, the union of flags (sorted) and the first value of each attribute that is there.

    ``order`` names columns without nulls; rows that tie in all of them should have equal attributes.
    """
    place = F.struct(*order)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in attributes]
    return candidates.groupBy(*key).agg(F.array_sort(F.collect_set(flag)).alias("flags"), *first)


def cover_plan(candidates: DataFrame, group: str, cap: int, cfg: Config = DEFAULT) -> DataFrame:
    """TK6, AG12: one row per cover with its numbers, pipeline covers first, then by title similarity; ``compare``
    marks the first ``cap``. Takes isbn13, image_url, is_pipeline, title_similarity, ord."""
    order = [F.desc(F.col("is_pipeline").cast("int")), F.desc("title_similarity"), "ord"]
    ranked = candidates.filter("image_url is not null and image_url <> ''").withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    covers = ranked.groupBy(group, "image_url").agg(
        F.min("__at").alias("__first"), F.transform(F.array_sort(F.collect_list(F.struct("__at", "isbn13"))), lambda x: x["isbn13"]).alias("isbns")
    )
    covers = covers.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("__first")))
    return covers.withColumn("compare", F.col("place") <= max(1, min(cap, cfg.compare_cap_most))).withColumn("isbn13", F.get("isbns", F.lit(0))).drop("__first")


def _ranked(covers: DataFrame, group: str) -> DataFrame:
    """TK5: by similarity, then confidence, then number; covers without similarity do not count."""
    order = Window.partitionBy(group).orderBy(F.desc("similarity"), F.desc(F.coalesce("confidence", F.lit(0.0))), "isbn13")
    return covers.filter("similarity is not null").withColumn("__rk", F.row_number().over(order))


def single_winner(covers: DataFrame, group: str, cfg: Config = DEFAULT) -> DataFrame:
    """WN5, CLS21: (group, decision, isbn13, best, gap): a strong best cover wins if it leads enough."""
    lead = F.lead("similarity").over(Window.partitionBy(group).orderBy("__rk"))
    rows = _ranked(covers, group).filter("__rk <= 2").withColumn("__gap", F.coalesce(F.round(F.col("similarity") - lead, 2), F.lit(1.0))).filter("__rk = 1")
    strong = strong_cover(F.col("match_status"), F.col("similarity"), F.col("confidence"), cfg)
    decision = F.when(strong & (F.col("__gap") >= cfg.cover_gap), "selected").when(F.col("similarity") < cfg.no_match_similarity, "no_match").otherwise("needs_verification")
    return rows.select(group, decision.alias("decision"), F.when(decision == "selected", F.col("isbn13")).alias("isbn13"), F.col("similarity").alias("best"), F.col("__gap").alias("gap"))


def cover_cluster(covers: DataFrame, group: str, cfg: Config = DEFAULT) -> DataFrame:
    """WN6, CLS22: (group, decision, isbn13, cluster_size): one exact cover, a small cluster of equal covers, or
    neither. One aggregation over ranked rows; groups without comparable covers give no_match."""
    strong = strong_cover(F.col("match_status"), F.col("similarity"), F.col("confidence"), cfg)
    every = covers.select(group).distinct()
    rows = _ranked(covers, group).withColumn("__strong", strong)
    place = F.sum(F.col("__strong").cast("int")).over(Window.partitionBy(group).orderBy("__rk"))
    rows = rows.withColumn("__place", F.when(F.col("__strong"), place))
    top = F.max(F.when(F.col("__place") == 1, F.col("similarity"))).over(Window.partitionBy(group))
    rows = rows.withColumn("__near", F.col("__strong") & (F.round(top - F.col("similarity"), 6) <= cfg.cluster_gap))
    g = rows.groupBy(group).agg(
        F.max("similarity").alias("best"), F.count_if("__strong").alias("n"), F.count_if("__near").alias("size"),
        F.max(F.when(F.col("__place") == 1, F.col("isbn13"))).alias("top_isbn"),
        F.max(F.when(F.col("__place") == 1, F.col("similarity"))).alias("top"), F.max(F.when(F.col("__place") == 2, F.col("similarity"))).alias("second"),
    )
    exact = (F.col("n") == 1) | ((F.col("size") == 1) & (F.round(F.col("top") - F.col("second"), 2) >= cfg.cover_gap))
    decision = (
        F.when(F.col("best").isNull() | (F.col("best") < cfg.no_match_similarity), "no_match").when(F.col("n") == 0, "needs_verification")
        .when(exact, "selected_exact_isbn").when((F.col("size") > 1) & (F.col("size") <= cfg.cluster_max), "selected_cover_ambiguous_isbn").otherwise("needs_verification")
    )
    size = F.when(decision == "selected_exact_isbn", 1).when(decision == "selected_cover_ambiguous_isbn", F.col("size")).otherwise(0)
    return every.join(g, group, "left").select(group, decision.alias("decision"), F.when(decision == "selected_exact_isbn", F.col("top_isbn")).alias("isbn13"), size.cast("int").alias("cluster_size"))


def expand_cover_groups(ranked: DataFrame, metadata: DataFrame, key: str = "isbn13", fill: Sequence[str] = ()) -> DataFrame:
    """JN7: a row for each number of a cover's group, attributes filled from metadata where missing."""
    own = ranked.withColumn(key, F.explode("isbns")).drop("isbns")
    joined = own.join(metadata.select(key, *[F.col(c).alias(f"__m_{c}") for c in fill]), key, "left")
    for c in fill:
        joined = joined.withColumn(c, F.coalesce(F.col(c) if c in own.columns else F.lit(None), F.col(f"__m_{c}")))
    return joined.drop(*[f"__m_{c}" for c in fill])


def by_box(left: DataFrame, right: DataFrame, keys: Keys = ("ads_id",), box: str = "bbox") -> DataFrame:
    """JN8, AG4: join on a physical book, that is on its box as text."""
    k = F.to_json(box)
    return left.withColumn("box_key", k).join(right.withColumn("box_key", F.to_json(box)).drop(box), [*keys, "box_key"])


def with_recent_events(jobs: DataFrame, events: DataFrame, n: int, key: str = "job_id") -> DataFrame:
    """JN9: jobs with an array of their newest events, oldest first; empty without events."""
    recent = top_per_key(events, [key], [F.desc("created_at"), F.desc("event_id")], max(1, min(n, 50)))
    lists = recent.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("created_at", "event_id", "event_type"))).alias("events"))
    return jobs.join(lists, key, "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<created_at: timestamp, event_id: bigint, event_type: string>>")))


def status_lookup(requested: DataFrame, books: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN10: requested book ids in order (ord) with their row and their latest job, where there are any."""
    latest = first_wins(jobs, ["book_id"], [F.desc("job_id")])
    return requested.join(books, "book_id", "left").join(latest, "book_id", "left").orderBy("ord")


def first_reason(rows: DataFrame, skips: DataFrame, keys: Keys, order: Sequence) -> DataFrame:
    """JN11: rows with the first reason recorded for their key."""
    return rows.join(first_wins(skips, keys, order).select(*keys, "reason"), list(keys), "left")


def exists(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """JN12, JN23."""
    return left.join(right, list(keys), "left_semi")


def not_exists(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """JN13, JN16."""
    return left.join(right, list(keys), "left_anti")


def unless_any(df: DataFrame, blockers: DataFrame) -> DataFrame:
    """JN13: all rows, or none if ``blockers`` has any row. The broadcast side is one row."""
    flag = blockers.agg((F.count("*") > 0).alias("__blocked"))
    return df.join(F.broadcast(flag), F.lit(True)).filter(~F.col("__blocked")).drop("__blocked")


def children(jobs: DataFrame) -> DataFrame:
    """JN17: (parent, child) pairs of jobs, one level."""
    parent, child = jobs.alias("p"), jobs.alias("c")
    return parent.join(child, F.col("c.parent_job_id") == F.col("p.job_id")).select(F.col("p.job_id").alias("parent_id"), F.col("c.job_id").alias("child_id"), F.col("c.status").alias("child_status"))


def pair_items(items: DataFrame, inputs: DataFrame, group: str = "batch_id") -> DataFrame:
    """JN18: (group, input_pos, item_pos, how): items to inputs by URL if all items carry one and some match, else
    by position if the counts are equal, else not at all."""
    facts = items.groupBy(group).agg(F.count("*").alias("n_items"), F.count_if(F.col("url").isNotNull() & (F.col("url") != "")).alias("with_url"))
    urls = inputs.join(items.select(group, F.col("url").alias("item_url"), F.col("pos").alias("item_pos")), group).filter("url = item_url")
    matched = urls.groupBy(group).agg(F.count("*").alias("n_hits"))
    facts = facts.join(inputs.groupBy(group).agg(F.count("*").alias("n_inputs")), group, "full").join(matched, group, "left").fillna(0, ["n_items", "with_url", "n_inputs", "n_hits"])
    how = F.when((F.col("n_items") > 0) & (F.col("with_url") == F.col("n_items")) & (F.col("n_hits") > 0), "url").when(F.col("n_items") == F.col("n_inputs"), "position").otherwise("failed")
    facts = facts.select(group, how.alias("how"))
    by_url = first_wins(urls, [group, "pos"], ["item_pos"]).join(facts.filter("how = 'url'"), group).select(group, F.col("pos").alias("input_pos"), "item_pos", "how")
    by_place = inputs.join(items.select(group, "pos"), [group, "pos"]).join(facts.filter("how = 'position'"), group).select(group, F.col("pos").alias("input_pos"), F.col("pos").alias("item_pos"), "how")
    return by_url.union(by_place)


def correlate(hooks: DataFrame, jobs: DataFrame) -> DataFrame:
    """JN19: (hook_id, job_id, matched_by): by run id, else by URL, else the single active job; at most one.

    ``hooks`` has hook_id, run_id, url; ``jobs`` job_id, run_id, url, active.
    """
    active = jobs.filter("active")
    run = hooks.join(jobs.select("job_id", "run_id"), "run_id").select("hook_id", "job_id", F.lit(1).alias("prio"), F.lit("run_id").alias("matched_by"))
    url = hooks.join(active.select("job_id", "url"), "url").select("hook_id", "job_id", F.lit(2).alias("prio"), F.lit("url").alias("matched_by"))
    only = active.agg(F.count("*").alias("n"), F.max("job_id").alias("job_id")).filter("n = 1")
    single = hooks.join(F.broadcast(only), F.lit(True)).select("hook_id", "job_id", F.lit(3).alias("prio"), F.lit("single_active").alias("matched_by"))
    return first_wins(run.union(url).union(single), ["hook_id"], ["prio", F.desc("job_id")]).drop("prio")


def two_way_difference(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """JN16, ST5: keys of one side only, with the side's name."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return not_exists(a, b, keys).withColumn("side", F.lit("left_only")).unionByName(not_exists(b, a, keys).withColumn("side", F.lit("right_only")))


def union_capped(first: DataFrame, second: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """ST1: distinct keys of both in order, those of ``first`` before those of ``second``, cut at ``cap``."""
    both = first.select(key, F.col(order).alias("__o"), F.lit(0).alias("__s")).union(second.select(key, order, F.lit(1)))
    return first_wins(both, [key], ["__s", "__o"]).orderBy("__s", "__o", key).limit(cap).select(key)


def running_progress(events: DataFrame, key: str, order: Sequence, value: str) -> DataFrame:
    """WN7: running maximum of a progress value, and whether a phase is seen for the first time."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = F.row_number().over(Window.partitionBy(key, "event_type").orderBy(*order))
    return events.withColumn("progress", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("first_of_type", seen == 1)


def within_budget(df: DataFrame, keys: Keys, order: Sequence, cost: str, cap: float, name: str = "allowed") -> DataFrame:
    """WN8: a row is allowed while what stood before it has used less than ``cap``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(cost).over(before), F.lit(0)) < cap)


def distinct_capped(df: DataFrame, keys: Keys, value: str, order: Sequence, cap: int) -> DataFrame:
    """WN9: the first ``cap`` distinct values of each key, in order of first appearance."""
    once = first_wins(df, [*keys, value], order)
    return top_per_key(once, keys, order, cap)


def first_source(*sources: tuple[DataFrame, str], keys: Keys) -> DataFrame:
    """SRC15: rows of the first source that has a key; later sources only fill in."""
    parts = [df.withColumn("__s", F.lit(i)).withColumn("source_name", F.lit(n)) for i, (df, n) in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    best = F.min("__s").over(Window.partitionBy(*keys))
    return out.withColumn("__b", best).filter("__s = __b").drop("__s", "__b")


def union_first(first: DataFrame, second: DataFrame, keys: Sequence[str | Column], order: Sequence) -> DataFrame:
    """ST3: rows of both, one for each key; those of ``first`` come before those of ``second``."""
    both = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__s", *order))
    return both.withColumn("__rn", rank).filter("__rn = 1").drop("__s", "__rn")


def best_medium(candidates: DataFrame, keys: Keys, last: str, cfg: Config = DEFAULT) -> DataFrame:
    """TK8: the best candidate of medium confidence: by confidence, lookup score, title and catalogue similarity.

    Takes confidence, lookup_score, title_sim, catalog_sim, valid, source; ``last`` breaks ties.
    """
    strong = (F.col("source") == "visible_isbn") | (F.col("confidence") >= cfg.catalog_strong)
    medium = candidates.filter(F.coalesce("valid", F.lit(True)) & ~F.coalesce(strong, F.lit(False)) & (F.col("confidence") >= cfg.catalog_medium))
    return first_wins(medium, keys, [F.desc(c) for c in ("confidence", "lookup_score", "title_sim", "catalog_sim")] + [F.col(last)])


def choose_in_order(rows: DataFrame, group: Keys, owner: str, order: Sequence[str], item: str, per_owner: int, per_group: int) -> DataFrame:
    """JN25, WN8: rows taken one by one in ``order``, where a choice rules out later ones.

    A row is taken unless its item was taken before in its group, or its owner has ``per_owner`` rows, or its group
    ``per_group``. ``order`` begins with the owner's place, so that an owner's rows follow each other; its columns break
    all ties. Items are not null. A fold over each group's sorted rows; before it, each owner's rows are cut to the first of
    each item and to ``per_owner + per_group``, of which earlier owners can take ``per_group`` at most. Rows are dealt by
    group once, which serves both cuts and the fold.
    """
    once = first_wins(rows.repartition(*group), [*group, owner, item], order)
    useful = top_per_key(once, [*group, owner], order, per_owner + per_group)
    names = [c for c in useful.columns if c not in group]
    row = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*names).alias("row"))
    gathered = useful.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kinds = {c: useful.schema[c].dataType.simpleString() for c in (owner, item)}
    fields = ", ".join(f"`{c}`: {useful.schema[c].dataType.simpleString()}" for c in names)
    start = F.struct(F.lit(None).cast(kinds[owner]).alias("owner"), F.lit(0).alias("n"), F.array().cast(f"array<{kinds[item]}>").alias("taken"), F.array().cast(f"array<struct<{fields}>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        used = F.when(acc["owner"].eqNullSafe(x["row"][owner]), acc["n"]).otherwise(0)
        good = (used < per_owner) & (F.size(acc["out"]) < per_group) & ~F.array_contains(acc["taken"], x["row"][item])
        one = F.when(good, 1).otherwise(0)
        grown = lambda old, new: F.concat(old, F.when(good, F.array(new)).otherwise(F.slice(F.array(new), 1, 0)))
        return F.struct(x["row"][owner].alias("owner"), (used + one).alias("n"), grown(acc["taken"], x["row"][item]).alias("taken"), grown(acc["out"], x["row"]).alias("out"))

    taken = gathered.select(*group, F.posexplode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("place", "row"))
    return taken.select(*group, (F.col("place") + 1).alias("place"), "row.*")
