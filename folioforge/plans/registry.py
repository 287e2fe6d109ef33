"""Where queries and their DuckDB SQL are registered, and expressions that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def turn(step: int, *values: object) -> str:
    """One of the values, by the row's number divided by ``step``."""
    arms = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    return f"CASE CAST(floor(k / {step}) AS BIGINT) % {len(values)} {arms} END"


def share(step: int, of: int = 101) -> str:
    """0 to 1 in steps of a hundredth, by the row's number divided by ``step``."""
    return f"CAST(CAST(floor(k / {step}) AS BIGINT) % {of} AS DOUBLE) / 100"


_KEY = "l_orderkey * 7 + l_linenumber * 3 + l_partkey"


def made(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    """(ads_id, line, columns): line items with columns made from their numbers, as the ladders take them."""
    keyed = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ads_id", "l_linenumber AS line", f"CAST({_KEY} AS BIGINT) AS k")
    return keyed.selectExpr("ads_id", "line", "k", *[f"{e} AS {n}" for n, e in columns.items()])


def made_sql(columns: dict[str, str]) -> str:
    """The same as the SQL table ``r``."""
    each = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"keyed AS (SELECT l_orderkey AS ads_id, l_linenumber AS line, CAST({_KEY} AS BIGINT) AS k, row_number() OVER () AS rid FROM lineitem), r AS (SELECT ads_id, line, k, rid, {each} FROM keyed)"
