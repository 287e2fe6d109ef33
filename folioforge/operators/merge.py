"""Merging a source into a target under a policy for each column.

Tables are immutable, so an upsert is a full outer join on the key that
rederives every column: both sides shuffle on the key once, and a target that
is bucketed by the key is not moved at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (old, new) to value. ``guard`` makes others.
Policy = Callable[[Column, Column], Column]


def overwrite(old: Column, new: Column) -> Column:
    return new


def keep_if_null(old: Column, new: Column) -> Column:
    """The new value unless it is null."""
    return F.coalesce(new, old)


def keep_old(old: Column, new: Column) -> Column:
    """The new value only where there is none."""
    return F.coalesce(old, new)


def at_least(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def guarded(*frozen: str, then: Policy = overwrite) -> Policy:
    """Old values in ``frozen`` are never changed: humans win, finished states are not downgraded."""
    return lambda old, new: F.when(old.isin(*frozen), old).otherwise(then(old, new))


#: States that automation never overwrites.
HUMAN = guarded("validated", "rejected", then=keep_if_null)


def no_downgrade(final: Sequence[str], pending: Sequence[str]) -> Policy:
    """A final state is not replaced by a pending one."""
    return lambda old, new: F.when(old.isin(*final) & (new.isin(*pending) | new.isNull()), old).otherwise(F.coalesce(new, old))


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], policy: dict[str, Policy], default: Policy = keep_if_null, insert: bool = True, null_keys: bool = True) -> DataFrame:
    """All target rows with what the source says of them, and the source's new rows if ``insert``.

    Keys are compared null-safe, or with ``null_keys`` false plainly: then a null key meets nothing, and a target that is
    bucketed by the keys (:func:`bucketed`) is read where it lies and not shuffled. Rows that the source does not have stay as they are, whatever the policy.
    The source has one row a key.
    """
    t = target.withColumn("__in_target", F.lit(True))
    names = [c for c in target.columns if c not in keys]
    s = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns], F.lit(True).alias("__in_source"))
    same = F.lit(True)
    for k in keys:
        same = same & (t[k].eqNullSafe(s[f"__s_{k}"]) if null_keys else t[k] == s[f"__s_{k}"])
    joined = t.join(s, same, "full_outer" if insert else "left")
    out = [F.when(F.col("__in_target"), F.col(k)).otherwise(F.col(f"__s_{k}")).alias(k) for k in keys]
    for c in names:
        if c in source.columns:
            old, new = F.col(c), F.col(f"__s_{c}")
            both = F.when(F.col("__in_target") & F.col("__in_source"), policy.get(c, default)(old, new))
            out.append(both.when(F.col("__in_source"), new).otherwise(old).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """``df`` as table ``name`` under ``path``, dealt by the keys and sorted in each bucket: merges and joins on all the
    keys then move the other side alone."""
    dealt = df.repartition(buckets, *keys)  # one file a bucket
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK11, QS1: source rows whose key the target lacks are added; others change nothing."""
    fresh = source.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def mark(df: DataFrame, keys: DataFrame, on: Sequence[str], changes: dict[str, Column], only: Column | None = None) -> DataFrame:
    """SNK7, SNK8, SNK15: sets columns of rows whose key is in ``keys`` and for which ``only`` holds."""
    joined = df.join(keys.select(*on).distinct().withColumn("__hit", F.lit(True)), list(on), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False)) & (F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    values = {c: F.when(hit, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in changes.items()}
    return joined.withColumns(values).drop("__hit").select(*df.columns, *[c for c in changes if c not in df.columns])


#: Column policies of the tables that are merged.
ADS_POLICY: dict[str, Policy] = {}
BOOK_POLICY: dict[str, Policy] = {
    "admin_status": HUMAN,
    "momox_status": no_downgrade(("momox_price_found", "momox_no_offer"), ("momox_pending", "not_sent")),
    "gibert_status": no_downgrade(("gibert_price_found", "gibert_non_repris", "gibert_missing"), ("gibert_pending", "not_sent")),
}


def upsert_ads(ads: DataFrame, payload: DataFrame, force_new: bool = False) -> DataFrame:
    """SNK1: every payload column is overwritten; status and attempts start anew only if ``force_new``."""
    keep = {"status": overwrite, "process_attempts": overwrite} if force_new else {"status": keep_old, "process_attempts": keep_old}
    rows = payload.withColumn("status", F.lit("new")).withColumn("process_attempts", F.lit(0))
    return merge(ads, rows, ["ads_id"], keep, overwrite)


def upsert_books(books: DataFrame, rows: DataFrame) -> DataFrame:
    """SNK2, SNK3: by (ads_id, isbn), or by (ads_id, title, image_index) where there is no number."""
    title = lambda d: F.when(F.col("isbn").isNull(), F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce(F.col("image_index"), F.lit(-1)).cast("string")))
    old, new = books.withColumn("__alt", title(books)), rows.withColumn("__alt", title(rows))
    return merge(old, new, ["ads_id", "isbn", "__alt"], BOOK_POLICY).drop("__alt")


def best_offer(a: Column, b: Column) -> Column:
    """AG20: struct(price, platform) of two provider prices; none above zero gives 0 and null, a tie goes to A."""
    x, y = F.coalesce(a.cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")), F.coalesce(b.cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
    none = (x <= 0) & (y <= 0)
    return F.struct(F.when(none, F.lit(0).cast("decimal(10,2)")).otherwise(F.greatest(x, y)).alias("price"), F.when(none, F.lit(None)).when(y > x, "gibert").otherwise("momox").alias("platform"))


def apply_provider_rows(books: DataFrame, rows: DataFrame, provider: str, key: Sequence[str] = ("isbn",)) -> DataFrame:
    """SNK4, SNK5, SNK6: a provider's batch rows on the books.

    A failed call has no price and erases none; no offer is 0. Profit and best offer are derived anew only
    where a price came. ``rows`` has the key, price (null if failed) and status.
    """
    got = rows.select(*key, F.col("price").cast("decimal(10,2)").alias("__p"), F.col("status").alias("__st"))
    j = books.join(got, list(key), "left")
    price = F.coalesce("__p", f"{provider}_price")
    j = j.withColumn(f"{provider}_price", price).withColumn(f"{provider}_status", F.coalesce("__st", f"{provider}_status"))
    best = best_offer(F.col("momox_price"), F.col("gibert_price"))
    fresh = F.col("__p").isNotNull()
    return j.withColumns(
        {
            f"profit_{provider}": F.when(fresh, F.col("__p") - F.col("cost").cast("decimal(10,2)")).otherwise(F.col(f"profit_{provider}")),
            "best_resale_price": F.when(fresh, best["price"]).otherwise(F.col("best_resale_price")),
            "best_resale_platform": F.when(fresh, best["platform"]).otherwise(F.col("best_resale_platform")),
        }
    ).drop("__p", "__st")


def _as_price(c: Column) -> Column:
    """A number of two decimals; 0 for what is none."""
    return F.coalesce(c.try_cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))


#: States in which provider A has answered for good, and marks of rows that stand for several editions. Fixed values.
FINAL_A = ("momox_price_found", "momox_price_found_needs_review", "momox_title_mismatch", "momox_no_price", "momox_not_real_offer")
EDITION_MARKS = ("duplicate_selected", "duplicate_alternative", "selected_edition", "alternative_edition")


def apply_provider_b_batch(books: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """SNK5: provider B's batch rows (book_id, price, title, image_url, status) on the books.

    A row always has a price, 0 if none is stated. Title and picture are kept where the row has none. A price makes the
    book one with an offer; without any, and with provider A's final answer, it has none at all; rows that stand
    for an edition keep their mark. A price makes the book new again unless a human or an edition choice decides.
    """
    got = rows.select("book_id", _as_price(F.col("price")).alias("__p"), F.col("title").alias("__t"), F.col("image_url").alias("__i"), F.col("status").alias("__s"), F.lit(True).alias("__hit"))
    j = books.join(got, "book_id", "left")
    best = best_offer(F.col("momox_price"), F.col("__p"))
    found = F.col("__p") > 0
    candidate = F.when(found, "resale_price_found").when(best["platform"].isNull() & F.col("status").isin(*FINAL_A), "no_resale_offer")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    changes = {
        "gibert_price": F.col("__p"), "gibert_title": F.coalesce(filled("__t"), "gibert_title"), "gibert_image_url": F.coalesce(filled("__i"), "gibert_image_url"), "gibert_status": F.col("__s"), "gibert_checked_at": as_of,
        "profit_gibert": (F.col("__p") - F.col("cost").cast("decimal(10,2)")).cast("decimal(10,2)"), "best_resale_price": best["price"], "best_resale_platform": best["platform"],
        "candidate_status": F.when(F.col("candidate_status").isin(*EDITION_MARKS), F.col("candidate_status")).otherwise(F.coalesce(candidate, F.col("candidate_status"))),
        "admin_status": F.when(found & ~F.col("admin_status").isin("validated", "rejected", "pending_duplicate", "pending_edition_choice"), "new").otherwise(F.col("admin_status")),
        "updated_at": as_of,
    }
    return j.select(*[F.when(F.col("__hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in books.columns])


def apply_provider_b_lookup(books: DataFrame, lookups: DataFrame, as_of: Column) -> DataFrame:
    """SNK6: provider B's single lookups (book_id, ok, price) on the books.

    A failed one sets its status and nothing else, so that it is tried again; one that went well sets the price, 0 for no
    offer, and all that follows from it.
    """
    got = lookups.select("book_id", F.when(F.col("ok"), _as_price(F.col("price"))).alias("__p"), F.lit(True).alias("__hit"))
    j = books.join(got, "book_id", "left")
    p, best = F.col("__p"), best_offer(F.col("momox_price"), F.col("__p"))
    keep = lambda c, new: F.when(p.isNull(), F.col(c)).otherwise(new)
    changes = {
        "gibert_price": F.coalesce(p, "gibert_price"), "gibert_status": F.when(p.isNull(), "gibert_failed").when(p > 0, "gibert_price_found").otherwise("gibert_non_repris"), "gibert_checked_at": keep("gibert_checked_at", as_of),
        "profit_gibert": keep("profit_gibert", (p - F.col("cost").cast("decimal(10,2)")).cast("decimal(10,2)")), "best_resale_price": keep("best_resale_price", best["price"]), "best_resale_platform": keep("best_resale_platform", best["platform"]),
        "status": F.when(p > 0, "gibert_price_found").otherwise(F.col("status")), "candidate_status": F.when(p > 0, "resale_price_found").otherwise(F.col("candidate_status")),
        "admin_status": F.when((p > 0) & ~F.col("admin_status").isin("validated", "rejected"), "new").otherwise(F.col("admin_status")), "updated_at": as_of,
    }
    return j.select(*[F.when(F.col("__hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in books.columns])


def mark_failed(books: DataFrame, keys: DataFrame, on: Sequence[str], column: str, failed: str, unresolved: Sequence[str] = ("not_sent", "momox_pending", "gibert_pending")) -> DataFrame:
    """SNK7: unresolved rows become failed; human decisions stay."""
    open_ = F.coalesce(F.col(column), F.lit("not_sent")).isin(*unresolved) & ~F.coalesce(F.col("admin_status"), F.lit("")).isin("validated", "rejected")
    return mark(books, keys, on, {column: F.lit(failed)}, open_)


def reject(books: DataFrame, keys: DataFrame) -> DataFrame:
    """SNK15."""
    return mark(books, keys, ["book_id"], {"admin_status": F.lit("rejected"), "candidate_status": F.lit("rejected"), "review_status": F.lit("rejected"), "backend_status": F.lit("rejected")})


def null_price_backfill(df: DataFrame) -> DataFrame:
    """SNK19: a price of 0 that was never asked for becomes null."""
    asked = lambda p: F.when(F.coalesce(F.col(f"{p}_status"), F.lit("not_sent")) == "not_sent", F.lit(None)).otherwise(F.col(f"{p}_price"))
    return df.withColumn("momox_price", asked("momox")).withColumn("gibert_price", asked("gibert"))


def status_backfill(df: DataFrame) -> DataFrame:
    """SNK19: provider A's own status from the row's status and price."""
    st, p = F.coalesce(F.col("status"), F.lit("")), F.col("momox_price")
    value = (
        F.when(st.isin("momox_pending", "momox_pending_duplicate"), "momox_pending").when(st.isin("momox_error", "momox_lookup_failed"), "momox_failed")
        .when(p > 0, "momox_price_found").when(p.isNotNull() & F.startswith(st, F.lit("momox_")), "momox_no_offer").otherwise("not_sent")
    )
    return df.withColumn("momox_status", value)


def assign_resolution(books: DataFrame, found: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("isbn",)) -> DataFrame:
    """JS5: the fields of a resolution are set as one from ``found``; books without one lose them, but for ``keep``."""
    names = [c for c in found.columns if c not in keys]
    new = found.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in names], F.lit(True).alias("__hit"))
    j = books.join(new, list(keys), "left")
    values = {c: F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c) if c in keep else F.lit(None)) for c in names}
    return j.withColumns(values).select(*books.columns)
