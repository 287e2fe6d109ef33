"""Sharding by jump consistent hashing (Lamping and Veach).

A row's shard depends on its key and the shard count alone; going from n to
n + 1 shards moves rows only into the new shard, about 1 / (n + 1) of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, pick


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; the loop runs about ln(shards) times over shrinking arrays."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump = ((shard[live] + 1) * step).astype(np.int64)
            live, jump = live[jump < shards], jump[jump < shards]
            shard[live] = jump
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard column for any key; a null key counts as one fixed key."""

    @F.pandas_udf("int")
    def jump(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in hashes:
            yield pd.Series(jump_hash(h.to_numpy(np.int64).view(np.uint64), shards))

    return jump(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000null"))))


def with_shard(df: DataFrame, key: str = "doc_id", shards: int = 8, name: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` with their shard; no shuffle. A column called ``name`` is replaced."""
    cols = df.columns
    flat, stay = df.toDF(*[f"__c{i}" for i in range(len(cols))]), [i for i, c in enumerate(cols) if c != name]
    return flat.select(*[f"__c{i}" for i in stay], shard_of(F.col(f"__c{cols.index(key)}"), shards).alias("__shard")).toDF(*[cols[i] for i in stay], name)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 8) -> None:
    """One folder per shard, each written by many tasks."""
    with_shard(df, key, shards).write.partitionBy("shard").mode("overwrite").parquet(path)


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in two passes.

    The rows are checkpointed first, so that both passes see the same
    partitions even when an executor is lost in between. Pass one counts rows
    by (partition, shard); a running sum over those counts gives each group its
    first slot; pass two numbers rows inside their group. No task holds more of
    a shard than one input partition had.
    """
    fixed = checkpointed(rows).withColumn("__part", F.spark_partition_id())
    counts = fixed.groupBy("__part", shard).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("__part").alias("__p"), F.col(shard).alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    inside = Window.partitionBy("__part", shard).orderBy(*[c for c in rows.columns if c != shard])
    numbered = fixed.withColumn("__row", F.row_number().over(inside))
    joined = numbered.join(first, (F.col("__part") == F.col("__p")) & (F.col(shard) == F.col("__s")))
    return joined.withColumn("slot", F.col("__first") + F.col("__row") - 1).select(*rows.columns, "slot")


def shard_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """One row per input row: its size, checksum, shard, slot in the shard and shard with one more shard.

    Law ``key``. Null text: size 1, checksum 0. A null id is one key like any
    other. Repeated rows each get their own slot. An empty table gives no rows.
    """
    docs = pick(df, doc_id=id_col, text=text_col)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    out = with_slots(rows)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
