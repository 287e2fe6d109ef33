"""Registered queries of metadata that is made safe before it is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import misc
from . import pipelines
from .registry import query
from .tables import read

#: Metadata of an event by the rest of its id, as both engines write it: given, and as it is kept. ``e`` is the event's id.
_CASES = (
    ("props", "replace(props, ' ', '')"),
    # secrets at every depth, a list inside, containers five deep
    ("""concat('{"k": ', e, ', "apiKey": "s", "a": {"Token": 1, "b": [1, {"secret": {"x": 1}, "z": {"my_Password": 3, "q": [1], "r": "t"}}]}, "Cookies": [1]}')""",
     """concat('{"Cookies":"[redacted]","a":{"Token":"[redacted]","b":[1,{"secret":"[redacted]","z":"[depth-capped]"}]},"apiKey":"[redacted]","k":', e, '}')"""),
    ("""concat('{"d": {"d": {"d": {"d": {"e": 1}, "f": [', e, '], "g": "x", "h": null, "auth": 1}}}}')""", """'{"d":{"d":{"d":{"auth":"[redacted]","d":"[depth-capped]","f":"[depth-capped]","g":"x","h":null}}}}'"""),
    ("""concat('{"s": "', repeat('é', 500 + CAST(e % 2 AS INT)), '", "t": true}')""", """concat('{"s":"', repeat('é', 500), CASE WHEN e % 2 = 1 THEN '…[truncated]' ELSE '' END, '","t":true}')"""),
    ("""concat('[', repeat('1,', 25), e, ']')""", """concat('[', repeat('1,', 24), '1]')"""),
    # 12 fields of 500 characters, and one that makes 6,000 or 6,001
    ("""concat('{"a":"', repeat('x', 500), '","b":"', repeat('x', 500), '","c":"', repeat('x', 500), '","d":"', repeat('x', 500), '","e":"', repeat('x', 500), '","f":"', repeat('x', 500), '","g":"', repeat('x', 500), '","h":"', repeat('x', 500), '","i":"', repeat('x', 500), '","j":"', repeat('x', 500), '","k":"', repeat('x', 500), '","l":"', repeat('x', 415 + CAST(e % 2 AS INT)), '"}')""",
     """CASE WHEN e % 2 = 1 THEN '{"note":"metadata exceeded size cap","truncated":true}' ELSE concat('{"a":"', repeat('x', 500), '","b":"', repeat('x', 500), '","c":"', repeat('x', 500), '","d":"', repeat('x', 500), '","e":"', repeat('x', 500), '","f":"', repeat('x', 500), '","g":"', repeat('x', 500), '","h":"', repeat('x', 500), '","i":"', repeat('x', 500), '","j":"', repeat('x', 500), '","k":"', repeat('x', 500), '","l":"', repeat('x', 415), '"}') END"""),
    ("""concat('"', e, '"')""", "'{}'"),
    ("""concat('{"a": ', e)""", "'{}'"),
)
_GIVEN = "CASE e % 9 " + " ".join(f"WHEN {i} THEN {given}" for i, (given, _) in enumerate(_CASES)) + " END"
_KEPT = "CASE e % 9 " + " ".join(f"WHEN {i} THEN {kept}" for i, (_, kept) in enumerate(_CASES)) + " ELSE '{}' END"


def _events(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").withColumn("e", F.col("event_id"))
    return ev.withColumn("metadata", F.expr(_GIVEN))


@query(f"SELECT event_id, {_KEPT} AS metadata FROM (SELECT *, event_id AS e FROM events)")
def redact_metadata(spark: SparkSession, d: str) -> DataFrame:
    """JS1: secrets at each depth, long texts, long lists, deep values, too much of all, what is no object."""
    return _events(spark, d).select("event_id", misc.safe_metadata(F.col("metadata")).alias("metadata"))


@query(f"SELECT event_id, {_KEPT} AS metadata, CAST(greatest(0, least(100, event_id % 150 - 20)) AS BIGINT) AS progress, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS parent FROM (SELECT *, event_id AS e FROM events) LEFT JOIN customer ON c_custkey = user_id")
def job_event_log(spark: SparkSession, d: str) -> DataFrame:
    """SNK12: events to append, with their job's parent, metadata made safe and progress within bounds."""
    ev = _events(spark, d).select("event_id", F.col("user_id").alias("job_id"), "metadata", (F.col("event_id") % 150 - 20).cast("long").alias("progress"), F.when(F.col("event_type") == "error", "error").alias("severity"), F.lit(0).alias("parent_job_id"))
    jobs = read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("parent_job_id"))
    return pipelines.job_events(ev, jobs).select("event_id", "metadata", "progress", "severity", F.col("parent_job_id").alias("parent"))
