"""Queries of record-level rules that stand between matching and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import instances
from tidegraph.operators import temporal as tp
from tidegraph.plans import REGISTRY
from tidegraph.plans.inputs import DAY, HISTORY, SECONDS, T8, T15, log, validity

query = REGISTRY.query


@query()
def parsed_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions that lasted or whose predecessors were passed over too often: a fold, tested against a loop."""
    e = log(spark, sf).select(F.col("head").alias("page"), "ts", F.col("seq").alias("revision"), (F.col("seq") % 11 != 0).alias("eligible"))
    return tp.parsed_revisions(e, DAY // 2, 3)


@query(
    f"{HISTORY}, d AS (SELECT head, relation, from_ts, to_ts, CASE WHEN from_ts > {T8} THEN 1 ELSE 0 END AS action, head % 3 - 1 AS qualifier_action FROM iv), "
    f"n AS (SELECT *, concat_ws(',', CASE WHEN action = 0 AND to_ts IS NOT NULL AND to_ts <= {T15} THEN 'removed_edge' END, CASE WHEN action = 1 THEN 'added_edge' END, CASE qualifier_action WHEN 0 THEN 'qualifier_removed_edge' WHEN 1 THEN 'qualifier_added_edge' END) AS actions FROM d) "
    "SELECT head, relation, from_ts, actions FROM n WHERE actions <> ''"
)
def action_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = validity(spark, sf).withColumn("action", F.when(F.col("from_ts") > T8, 1).otherwise(0)).withColumn("qualifier_action", F.col("head") % 3 - 1).withColumn("window_end", F.lit(T15))
    return instances.with_actions(d).select("head", "relation", "from_ts", F.array_join("actions", ",").alias("actions"))


@query(f"WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'click') AS good FROM events GROUP BY 1) SELECT user_id, ((2 * good >= n OR good >= 3) AND bad < n AND good > n * 0.2) OR bad = 0 OR user_id % 10 = 0 AS useful FROM s")
def useful_snippets(spark: SparkSession, sf: str) -> DataFrame:
    s = log(spark, sf).groupBy(F.col("head").alias("user_id")).agg(F.count("*").alias("n"), F.count_if(F.col("relation") == "error").alias("bad"), F.count_if(F.col("relation") == "click").alias("good"))
    return s.select("user_id", instances.useful(F.col("good"), F.col("n"), F.col("bad") >= F.col("n"), 3, F.col("bad") == 0, F.col("user_id") % 10 == 0).alias("useful"))


@query(f"WITH s AS (SELECT user_id, max({SECONDS.format('ts')}) FILTER (event_type = 'error') AS removal, max({SECONDS.format('ts')}) AS last FROM events GROUP BY 1) SELECT user_id, coalesce(last >= removal, TRUE) AS ok FROM s")
def passage_after_removal(spark: SparkSession, sf: str) -> DataFrame:
    s = log(spark, sf).groupBy(F.col("head").alias("user_id")).agg(F.max("ts").alias("last"), F.collect_list(F.when(F.col("relation") == "error", F.col("ts"))).alias("removals"))
    return s.select("user_id", instances.after_removal(F.col("last"), F.col("removals")).alias("ok"))
