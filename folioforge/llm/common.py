"""Helpers shared by the training-data operators.

Every operator starts with :func:`pick`, which takes the columns it needs by
exact name and renames them, so frames with extra, clashing or repeated
column names behave like frames that hold just those columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import shared_dir, ship

#: The words of the word-based contracts: what lies between ASCII white space.
#: ``bytes.split()`` splits UTF-8 text in exactly this way.
SPACE = "[\\x20\\x09-\\x0D]+"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``pick(df, doc="doc_id")``: the named columns, renamed; the first of equal names."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    cols = df.columns
    flat = df.toDF(*[f"__c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"__c{cols.index(old)}").alias(new) for new, old in names.items()])


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's 10,000, unless the session says how many: a batch of whole documents
    is held by the JVM and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, rows)


def kept_rows(df: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The rows of ``df`` that ``keep`` leaves in its Arrow batches; all columns as they are, whatever their names."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    flat = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return flat.mapInArrow(keep, flat.schema).toDF(*df.columns)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A narrow frame cut from its lineage; its partitions and their rows stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A dict that stays with a reused Python worker; other owners' dicts are emptied, so that a worker holds
    one operator's tables at a time."""
    for name, held in _CACHES.items():
        if name != owner:
            held.clear()
    return _CACHES.setdefault(owner, {})


def text_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes together, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    lo = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def release_memory() -> None:
    """Give back what a reused worker's earlier stages have freed: Arrow's pool and the C library keep it otherwise."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
