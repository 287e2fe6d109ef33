"""Tables that micro-batches are merged into or appended to, once each.

A table is dealt into buckets by a hash of its keys. A batch writes new versions
of the buckets that it touches, and of every other table that belongs to it,
under its own number; one small commit file then makes all of them current at
once. A batch that is in the commits is not applied again, and one that failed
on the way is written over: what it reads are committed versions alone. So a
repeated batch changes nothing, and events and totals never part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import keep_old, merge, upsert_ads, upsert_books

#: (committed rows of the touched buckets, the batch's rows) to the buckets' new rows.
Change = Callable[[DataFrame, DataFrame], DataFrame]
_COMMITS = "table string, bucket int, batch long"


@dataclass(frozen=True)
class Merged:
    """A table that batches are merged into: ``rows`` of a batch to the table's rows, by ``keys``, with ``change``."""

    keys: Sequence[str]
    change: Change
    rows: Callable[[DataFrame], DataFrame] = lambda batch: batch


@dataclass(frozen=True)
class Appended:
    """A table that batches are appended to."""

    rows: Callable[[DataFrame], DataFrame] = lambda batch: batch


class Store:
    """Tables under ``root``, a folder that all executors share. ``buckets`` stays as it was at the first use."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    def _bucket(self, keys: Sequence[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _commit(self, batch: int, touched: list[tuple[str, int]]) -> None:
        rows = self.spark.createDataFrame([(t, b, batch) for t, b in touched], _COMMITS)
        rows.coalesce(1).write.mode("overwrite").json(f"{self.root}/commits/{batch}")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMITS).json(f"{self.root}/commits/*")

    def committed(self, batch: int) -> bool:
        return bool(self._commits().filter(F.col("batch") == batch).take(1))

    def create(self, tables: dict[str, tuple[DataFrame, Merged | Appended]]) -> None:
        """First rows (or none) of each table, as batch -1."""
        touched = []
        for name, (df, kind) in tables.items():
            touched += self._write(name, kind, df, -1)
            self.spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{self.root}/schema/{name}")
        self._commit(-1, [("", -1), *touched])

    def _write(self, name: str, kind: Merged | Appended, rows: DataFrame, batch: int) -> list[tuple[str, int]]:
        path = f"{self.root}/data/{name}/{batch}"
        if isinstance(kind, Appended):
            rows.write.mode("overwrite").parquet(f"{path}/__bucket=-1")
            return [(name, -1)]
        dealt = rows.withColumn("__bucket", self._bucket(kind.keys))
        # a bucket is one task's rows, in one file
        dealt.repartition(self.buckets, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(path)
        return [(name, r[0]) for r in self.spark.read.parquet(path).select("__bucket").distinct().collect()] if rows.take(1) else []

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The committed rows, of some buckets or all."""
        own = self._commits().filter(F.col("table") == name)
        own = own if buckets is None else own.filter(F.col("bucket").isin(*buckets))
        current = own.groupBy("bucket").agg(F.max("batch").alias("batch")).collect() if not own.filter("bucket = -1").take(1) else own.select("bucket", "batch").distinct().collect()
        schema = self.spark.read.parquet(f"{self.root}/schema/{name}").schema
        paths = [f"{self.root}/data/{name}/{r['batch']}/__bucket={r['bucket']}" for r in current]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, number: int, tables: dict[str, Merged | Appended]) -> bool:
        """Merge or append one batch to all ``tables`` and commit them together; False if the batch is there already."""
        if self.committed(number):
            return False
        touched = []
        for name, kind in tables.items():
            rows = kind.rows(batch)
            if isinstance(kind, Merged):
                hit = sorted(r[0] for r in rows.select(self._bucket(kind.keys)).distinct().collect())  # bounded by the number of buckets
                if not hit:
                    continue
                rows = kind.change(self.read(name, hit), rows)
            touched += self._write(name, kind, rows, number)
        self._commit(number, [("", -1), *touched])
        return True

    def sink(self, tables: dict[str, Merged | Appended]) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each batch is read once and goes to all tables."""

        def run(batch: DataFrame, number: int) -> None:
            held = batch.persist()
            try:
                self.apply(held, number, tables)
            finally:
                held.unpersist()

        return run


def listings() -> Merged:
    """SNK1: listings, every payload column overwritten, status and attempts kept. One row of a listing in a batch."""
    return Merged(["ads_id"], upsert_ads)


def books() -> Merged:
    """SNK2, SNK3: book rows by listing and number, or by title and picture; a listing's books share a bucket."""
    return Merged(["ads_id"], upsert_books)


def newest(keys: Sequence[str], at: str) -> Merged:
    """The newest row of each key by ``at``, whatever the order that batches come in; columns that break ties are in ``at``'s row."""

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        rest = [c for c in new.columns if c not in keys]
        best = F.max(F.struct(at, *[c for c in rest if c != at])).alias("__b")
        return old.unionByName(new.select(*old.columns)).groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.{c}") for c in rest]).select(*old.columns)

    return Merged(keys, change)


def costs(key: str = "ads_id", amount: str = "amount_usd") -> dict[str, Merged | Appended]:
    """SNK13: cost events, and each listing's total, in one commit: tables ``cost_events`` and ``cost_totals`` (key, usd, events)."""

    def sums(batch: DataFrame) -> DataFrame:
        return batch.groupBy(key).agg(F.sum(F.col(amount).cast("decimal(18,6)")).cast("decimal(28,6)").alias("usd"), F.count("*").alias("events"))

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        plus = {c: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) for c in ("usd", "events")}
        return merge(old, new, [key], plus, keep_old).select(*old.columns[:1], F.col("usd").cast("decimal(28,6)").alias("usd"), "events")

    return {"cost_events": Appended(), "cost_totals": Merged([key], add, sums)}
