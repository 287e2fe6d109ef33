"""Exact nearest neighbours of every row by cosine similarity, without a list of all pairs.

Equal vectors are one class. Classes go to the cell of their nearest pivot
(a bounded sample), large cells are dealt into blocks. Inside its own block a
class finds its first neighbours, whose k-th similarity bounds the rest; by the
triangle inequality and the half-plane between two pivots most cells cannot
hold a better one. A class is sent as a query to the blocks of the cells that
are left; there it is compared with everything, so the result is exact however
little the bounds rule out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shared_dir, ship

#: Bound of the sample of pivots: their number, and so the driver's rows.
MOST_PIVOTS = 256
#: Rows of a block, on average.
BLOCK = 2048
#: Slack of the distance bounds against rounding.
SLACK = 1e-7


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/folioforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and which rows those are; rows have equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    size = np.sqrt((flat * flat).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return flat[good] / size[good][:, None], good


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _highest(sims: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the n highest of each row, equal ones by id; similarities count to nine decimals."""
    n = min(n, sims.shape[1])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = -np.partition(-sims, n - 1, axis=1)[:, n - 1]
    row, place = np.nonzero(sims >= kth[:, None])
    order = np.lexsort((ids[place], -sims[row, place], row))
    row, place = row[order], place[order]
    start = np.searchsorted(row, np.arange(sims.shape[0]))
    kept = np.arange(len(row)) - start[row] < n
    return row[kept], place[kept]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Runs of equal (cell, block, kind), the first three columns."""
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield tuple(key[lo].tolist()), batch.slice(lo, hi - lo)


def nearest(df: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = MOST_PIVOTS, block: int = BLOCK) -> DataFrame:
    """UD5: (id_col, rank, neighbour, similarity): the k other rows of highest cosine similarity of each row.

    Similarities are rounded to nine decimals, equal ones are ranked by id. Null
    ids, and vectors without a direction (null, empty, zero, not finite, with a
    null inside) or of another length than most, have no neighbours and are
    nobody's. Ids are long and distinct.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x)) and exists(v, x -> x <> 0)")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").limit(1)
    rows = rows.join(F.broadcast(length), F.size("v") == F.col("n")).drop("n")
    # classes of equal vectors: their first id stands for them, k + 1 members are enough for anybody's neighbours
    ranked = rows.join(rows.groupBy("v").agg(F.min("id").alias("rep")), "v")
    member_rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = _stored(rows.withColumn("at", member_rank).filter(F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumn("rep", F.get("members", F.lit(0))), "classes")
    sample = members.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("v").toArrow()["v"].combine_chunks()
    empty = spark.createDataFrame([], f"{id_col} long, rank int, neighbour long, similarity double")
    if len(sample) == 0:
        return empty
    centres, _ = unit_rows(sample)
    shared = spark.sparkContext.broadcast(centres)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, good = unit_rows(batch.column(1))
                far = _distance(unit, shared.value)
                cell = far.argmin(axis=1)
                raw = [u.tobytes() for u in unit]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(raw, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=["rep", "unit", "cell", "far"])

    placed = _stored(members.select("rep", "v").mapInArrow(cells, "rep long, unit binary, cell int, far double"), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # a row for each pivot
    radius, parts = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for r in sizes:
        radius[r["cell"]], parts[r["cell"]] = r["radius"], -(-r["n"] // block)
    split = spark.createDataFrame([(int(c), int(n)) for c, n in enumerate(parts) if n], "cell int, parts long")
    dealt = placed.join(F.broadcast(split), "cell").select("cell", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("block"), "rep", "unit")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for key, part in _blocks(batches):
            if key != now and held:
                yield from inside(now, pa.Table.from_batches(held))
                held = []
            now = key
            held.append(part)
        if held:
            yield from inside(now, pa.Table.from_batches(held))

    def inside(key: tuple[int, int, int], table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, unit = table["rep"].to_numpy(), _matrix(table["unit"].combine_chunks())
        centres = shared.value
        between = _distance(centres, centres)
        for lo in range(0, len(ids), 512):
            mine = unit[lo : lo + 512]
            sims = np.round(mine @ unit.T, 9)
            row, place = _highest(sims, ids, k + 1)
            count = np.bincount(row, minlength=len(mine))
            least = np.full(len(mine), -2.0)
            end = np.cumsum(count)
            full = count == k + 1
            least[full] = sims[row, place][end[full] - 1]
            reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * least)) + SLACK
            far = _distance(mine, centres)
            own = far[:, key[0]]
            low = far - radius[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between[key[0]] > 0, (far**2 - own[:, None] ** 2) / (2 * between[key[0]]), 0.0)
            visit = (np.maximum(low, plane) <= reach[:, None]) & (radius >= 0)[None, :]
            near = [[{"other": int(ids[p]), "similarity": float(sims[i, p])} for p in place[e - c : e]] for i, (c, e) in enumerate(zip(count.tolist(), end.tolist()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(mine), key[0], np.int32)), pa.array(np.full(len(mine), key[1], np.int32)), pa.array(ids[lo : lo + 512]), pa.array([u.tobytes() for u in mine], pa.binary()), pa.array(least), pa.array([np.flatnonzero(v).astype(np.int32) for v in visit], pa.list_(pa.int32())), pa.array(near, pa.list_(pa.struct([("other", pa.int64()), ("similarity", pa.float64())])))],
                names=["cell", "block", "rep", "unit", "least", "visit", "near"],
            )

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_block = lambda d: d.repartition(width, "cell", "block").sortWithinPartitions("cell", "block", "kind")
    seeded = _stored(by_block(dealt.select("cell", "block", F.lit(0).alias("kind"), "rep", "unit")).mapInArrow(first, "cell int, block int, rep long, unit binary, least double, visit array<int>, near array<struct<other:long,similarity:double>>"), "seeds")
    asked = seeded.select(F.col("cell").alias("own_cell"), F.col("block").alias("own_block"), "rep", "unit", "least", F.explode("visit").alias("cell")).join(F.broadcast(split), "cell")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).filter("cell <> own_cell or block <> own_block")
    every = dealt.select("cell", "block", F.lit(0).alias("kind"), "rep", "unit", F.lit(0.0).alias("least")).union(asked.select("cell", "block", F.lit(1), "rep", "unit", "least"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, unit = None, [], None, None
        for (cell, number, kind), part in _blocks(batches):
            if (cell, number) != now:
                now, held, ids = (cell, number), [], None
            if kind == 0:
                held.append(part)
                continue
            if ids is None:
                table = pa.Table.from_batches(held)
                ids, unit, held = table["rep"].to_numpy(), _matrix(table["unit"].combine_chunks()), []
            who, least = part.column(3).to_numpy(), part.column(5).to_numpy()
            query = _matrix(part.column(4))
            for lo in range(0, len(who), 512):
                sims = np.round(query[lo : lo + 512] @ unit.T, 9)
                row, place = _highest(sims, ids, k + 1)
                good = sims[row, place] >= least[lo : lo + 512][row]
                row, place = row[good], place[good]
                yield pa.RecordBatch.from_arrays([pa.array(who[lo : lo + 512][row]), pa.array(ids[place]), pa.array(sims[row, place])], names=["rep", "other", "similarity"])

    met = by_block(every).mapInArrow(second, "rep long, other long, similarity double")
    own = seeded.select("rep", F.explode("near").alias("n")).select("rep", "n.other", "n.similarity")
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    classes = own.union(met).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    spread = classes.join(members.select(F.col("rep").alias("other"), "members"), "other").select("rep", "similarity", F.explode("members").alias("other"))
    lists = spread.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "other", "similarity"))).alias("near"))
    each = ranked.select("id", "rep").join(lists, "rep").select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)).alias("at", "n"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("rank"), F.col("n.other").alias("neighbour"), F.col("n.similarity").alias("similarity"))
