"""The driver's tables in the roles of the blueprint's inputs, with the same roles in SQL for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.io import table
from tidegraph.operators import temporal as tp

DAY = 86400
#: 2024-01-15, 2024-01-08 and so on, at midnight UTC.
T0 = 1704067200
T8 = T0 + 7 * DAY
T15 = T0 + 14 * DAY
T22 = T0 + 21 * DAY


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an edit history: user and type are the statement, even ids add, odd ids delete."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("head"), F.col("event_type").alias("relation"), seconds("ts").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("D").alias("action"))


def validity(spark: SparkSession, sf: str) -> DataFrame:
    return tp.intervals(log(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier supplies part: a graph edge for each line item, created when it ships."""
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("S"), "l_suppkey").alias("head"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("P"), "l_partkey").alias("tail"), seconds("l_shipdate").alias("ts"), F.col("l_orderkey").alias("order_id"))


#: SQL of the same roles, as common table expressions.
SECONDS = "CAST(floor(epoch({0})) AS BIGINT)"
LOG = f"log AS (SELECT user_id AS head, event_type AS relation, {SECONDS.format('ts')} AS ts, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS action FROM events)"
RUNS = "runs AS (SELECT head, relation, ts, seq, action FROM (SELECT *, lag(action) OVER (PARTITION BY head, relation ORDER BY ts, seq) AS before FROM log) WHERE coalesce(before, 'D') <> action)"
IV = "iv AS (SELECT head, relation, ts AS from_ts, nxt AS to_ts FROM (SELECT *, lead(ts) OVER (PARTITION BY head, relation ORDER BY ts, seq) AS nxt FROM runs) WHERE action = 'A')"
HISTORY = f"WITH {LOG}, {RUNS}, {IV}"
EDGES = f"edges AS (SELECT concat('S', l_suppkey) AS head, l_returnflag AS relation, concat('P', l_partkey) AS tail, {SECONDS.format('l_shipdate')} AS ts, l_orderkey AS order_id FROM lineitem)"


def active(t: int | str) -> str:
    return f"(from_ts < {t} AND (to_ts IS NULL OR to_ts > {t}))"
