"""Queries of the evaluation layer: membership, metadata, specifications, filters and orders of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.io import table
from tidegraph.operators import scoring
from tidegraph.plans import REGISTRY
from tidegraph.plans.inputs import EDGES, edges

query = REGISTRY.query


@query(
    f"WITH {EDGES}, e AS (SELECT head, relation, tail, year(make_timestamp(ts * 1000000)) AS snapshot FROM edges), s AS (SELECT DISTINCT snapshot + 1 AS snapshot, head, relation, tail FROM e) "
    "SELECT e.snapshot, s.head IS NOT NULL AS existing, count(*) AS n FROM e LEFT JOIN s ON s.snapshot = e.snapshot AND s.head = e.head AND s.relation = e.relation AND s.tail = e.tail GROUP BY 1, 2"
)
def snapshot_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Statements of a year that the graph of the year before held already."""
    e = edges(spark, sf).withColumn("snapshot", F.year(F.timestamp_seconds("ts"))).select("snapshot", "head", "relation", "tail")
    before = e.withColumn("snapshot", F.col("snapshot") + 1)
    return scoring.in_snapshot(e, before, ["snapshot", "head", "relation", "tail"]).groupBy("snapshot", "existing").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, c_mktsegment AS segment, count(*) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1, 2")
def metrics_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of orders under the metadata of their customers; customers without it drop out."""
    metrics = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_totalprice")
    found = scoring.with_metadata(metrics, table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey", ["c_mktsegment"])
    return found.groupBy(F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query(
    "WITH s(relation, status, title) AS (VALUES ('R', 'F', 'returned'), ('A', 'F', 'accepted'), ('N', 'O', 'new')) "
    "SELECT title, r_name AS label, count(*) AS n FROM lineitem JOIN s ON s.relation = l_returnflag AND s.status = l_linestatus LEFT JOIN region ON r_regionkey = l_linenumber GROUP BY 1, 2"
)
def metrics_with_specification(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a specification asks for, with its title and a label where there is one."""
    spec = spark.createDataFrame([("R", "F", "returned"), ("A", "F", "accepted"), ("N", "O", "new")], "l_returnflag string, l_linestatus string, title string")
    labels = table(spark, sf, "region").select(F.col("r_regionkey").alias("l_linenumber"), F.col("r_name").alias("label"))
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber"))
    return scoring.with_specification(rows, spec, labels, ["l_returnflag", "l_linestatus"], "l_linenumber").groupBy("title", "label").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, k AS (SELECT DISTINCT head, relation FROM edges WHERE order_id % 2 = 0) SELECT relation, count(*) AS n FROM edges WHERE order_id % 2 = 1 AND EXISTS (SELECT 1 FROM k WHERE k.head = edges.head AND k.relation = edges.relation) GROUP BY relation")
def known_relation_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Odd orders' statements whose relation the even orders know for the same head."""
    e = edges(spark, sf)
    odd, even = e.where("order_id % 2 = 1"), e.where("order_id % 2 = 0")
    return scoring.known_relations(odd, even, ["head", "relation"]).groupBy("relation").agg(F.count("*").alias("n"))


TAILS = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'Q' WHEN event_id % 5 = 2 THEN 'q' || event_id WHEN event_id % 5 = 3 THEN 'Q' || event_id || 'x' ELSE 'Q' || event_id END"


@query(f"SELECT event_id, {TAILS} AS tail FROM events WHERE regexp_full_match({TAILS}, 'Q[0-9]+')")
def entity_tail_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Of null, empty, lower-case and suffixed ids only real ones stay."""
    return scoring.entity_tails(table(spark, sf, "events").select("event_id", F.expr(TAILS).alias("tail")))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr', 'es') GROUP BY lang")
def model_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two models and of the reference, whose part English plays."""
    return scoring.of_models(table(spark, sf, "documents"), ["fr", "es"], "lang", "en").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT left(md5(text), 3) AS code, count(DISTINCT text) AS contents FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT text) > 1")
def hash_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Short codes that several texts share."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").select(F.left(F.md5(F.col("text").cast("binary")), F.lit(3)).alias("code"), "text")
    return scoring.colliding(d, "code", ["text"])


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents QUALIFY place <= 100")
def first_by_length(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred shortest documents in order (O2, O14: the cap is the operator)."""
    found = scoring.first_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("n_chars"), F.col("doc_id")], 100)
    return found.select("doc_id", F.row_number().over(Window.orderBy("n_chars", "doc_id")).alias("place"))


@query(
    "SELECT 0 AS place, 'rows' AS metric, lang, CAST(count(*) AS DOUBLE) AS score FROM documents GROUP BY lang "
    "UNION ALL SELECT 1, 'length', lang, round(avg(n_chars), 6) FROM documents GROUP BY lang UNION ALL SELECT 2, 'longest', lang, CAST(max(n_chars) AS DOUBLE) FROM documents GROUP BY lang"
)
def metrics_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """A list of metrics run one after the other over the same rows."""
    by_lang = lambda score: lambda df: df.groupBy("lang").agg(score.cast("double").alias("score"))
    metrics = [("rows", by_lang(F.count("*"))), ("length", by_lang(F.round(F.avg("n_chars"), 6))), ("longest", by_lang(F.max("n_chars")))]
    return scoring.evaluate(table(spark, sf, "documents"), metrics)
