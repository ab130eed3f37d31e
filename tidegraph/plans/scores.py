"""Queries of scoring, agreement and reporting (M, G, O of the blueprint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.text import n_tokens, raw_tokens, valid_triple
from tidegraph.io import table
from tidegraph.operators import agreement, curation, instances, scoring
from tidegraph.plans import REGISTRY

query = REGISTRY.query

#: Gold: items of even key of each order; predicted: items of quantity over 20.
GP = "g AS (SELECT DISTINCT l_orderkey AS hash_id, l_suppkey AS head, l_returnflag AS relation FROM lineitem WHERE l_partkey % 2 = 0), p AS (SELECT DISTINCT l_orderkey AS hash_id, l_suppkey AS head, l_returnflag AS relation FROM lineitem WHERE l_quantity > 20)"
PER = GP + ", k AS (SELECT hash_id FROM g UNION SELECT hash_id FROM p), s AS (SELECT k.hash_id, (SELECT count(*) FROM g WHERE g.hash_id = k.hash_id) AS gold, (SELECT count(*) FROM p WHERE p.hash_id = k.hash_id) AS predicted, (SELECT count(*) FROM g JOIN p USING (hash_id, head, relation) WHERE hash_id = k.hash_id) AS tp FROM k)"
PRF = "CASE WHEN predicted > 0 THEN tp / CAST(predicted AS DOUBLE) ELSE 0 END AS \"precision\", CASE WHEN gold > 0 THEN tp / CAST(gold AS DOUBLE) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (predicted + gold) ELSE 0 END AS f1"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hash_id"), F.col("l_suppkey").alias("head"), F.col("l_returnflag").alias("relation"), "l_partkey", "l_quantity")
    return li.where("l_partkey % 2 = 0").drop("l_partkey", "l_quantity"), li.where("l_quantity > 20").drop("l_partkey", "l_quantity")


def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.exact_match(*_sides(spark, sf), ["hash_id"], ["head", "relation"])


@query(f"WITH {PER} SELECT hash_id, gold, predicted, tp, {PRF} FROM s")
def exact_match_prf(spark: SparkSession, sf: str) -> DataFrame:
    return _exact(spark, sf)


@query(f"WITH {PER}, t AS (SELECT CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM s) SELECT gold, predicted, tp, {PRF} FROM t")
def micro_prf(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.micro(_exact(spark, sf))


@query(f"WITH {PER}, x AS (SELECT hash_id, {PRF} FROM s) SELECT hash_id, 'precision' AS metric, \"precision\" AS score FROM x UNION ALL SELECT hash_id, 'recall', recall FROM x UNION ALL SELECT hash_id, 'f1', f1 FROM x")
def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.metric_rows(_exact(spark, sf), ["hash_id"], ["precision", "recall", "f1"])


@query(f"WITH {GP} SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM g INTERSECT SELECT * FROM p) UNION ALL SELECT 'missed', count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p) UNION ALL SELECT 'wrong', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)")
def set_parts(spark: SparkSession, sf: str) -> DataFrame:
    g, p = _sides(spark, sf)
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n"))
    return count(g.intersect(p), "both").unionByName(count(g.subtract(p), "missed")).unionByName(count(p.subtract(g), "wrong"))


METRICS = "m AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'judge-novelty' WHEN 1 THEN 'completeness' ELSE 'cie-f1' END AS metric, 'model' || user_id % 4 AS model, event_type AS operation, CASE event_id % 2 WHEN 0 THEN 'zs' ELSE 'icl' END AS setting, value / 500.0 AS score FROM events)"


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        "event_id", F.when(u % 3 == 0, "judge-novelty").when(u % 3 == 1, "completeness").otherwise("cie-f1").alias("metric"), F.concat(F.lit("model"), (u % 4).cast("string")).alias("model"),
        F.col("event_type").alias("operation"), F.when(F.col("event_id") % 2 == 0, "zs").otherwise("icl").alias("setting"), (F.col("value") / 500.0).alias("score"),
    )


@query(f"WITH {METRICS} SELECT event_id, metric, round(CASE WHEN contains(metric, 'judge') THEN score * 20 ELSE score * 100 END, 6) AS score FROM m")
def score_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scaled(_metrics(spark, sf)).select("event_id", "metric", F.round("score", 6).alias("score"))


@query(f"WITH {METRICS} SELECT metric, count(*) AS n, round(avg(score), 6) AS mean FROM (SELECT metric, score FROM m UNION ALL SELECT 'completeness>0.3', CASE WHEN score > 0.3 THEN 1.0 ELSE 0.0 END FROM m WHERE metric = 'completeness') GROUP BY metric")
def threshold_metric(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.thresholded(_metrics(spark, sf), "completeness", 0.3).groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {METRICS} SELECT operation, model, metric, round(avg(score), 6) AS mean_score, count(*) AS n FROM m GROUP BY 1, 2, 3")
def mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.mean_scores(_metrics(spark, sf), ["operation", "model", "metric"])


@query(f"WITH {METRICS}, a AS (SELECT operation, metric, model, round(avg(score), 6) AS mean_score FROM m GROUP BY 1, 2, 3) SELECT operation, metric, model, mean_score, place FROM (SELECT *, dense_rank() OVER (PARTITION BY operation, metric ORDER BY mean_score DESC) AS place FROM a) WHERE place <= 2")
def pivot_best_second(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.best_two(scoring.mean_scores(_metrics(spark, sf), ["operation", "metric", "model"]).drop("n"), ["operation", "metric"]).where("place <= 2")


@query(f"WITH {METRICS} SELECT operation, metric, " + ", ".join(f"round(avg(score) FILTER (model = 'model{k}'), 6) AS model{k}" for k in range(4)) + " FROM m GROUP BY 1, 2")
def pivot_models(spark: SparkSession, sf: str) -> DataFrame:
    wide = _metrics(spark, sf).groupBy("operation", "metric").pivot("model", [f"model{k}" for k in range(4)])
    return wide.agg(F.round(F.avg("score"), 6))


@query(f"WITH {METRICS} SELECT operation, round(avg(score) FILTER (setting = 'icl') - avg(score) FILTER (setting = 'zs'), 6) AS difference FROM m GROUP BY operation")
def setting_difference(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.setting_difference(_metrics(spark, sf), ["operation"], "zs", "icl")


@query(f"WITH {PER}, x AS (SELECT hash_id, {PRF} FROM s WHERE predicted > 0) SELECT o_orderkey AS hash_id, coalesce(f1, 0.0) AS f1 FROM orders LEFT JOIN x ON x.hash_id = o_orderkey")
def empty_as_zero(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("hash_id"))
    return scoring.with_empty_as_zero(orders, _exact(spark, sf).where("predicted > 0"), ["hash_id"], ["f1"])


@query(f"WITH {METRICS}, v AS (SELECT DISTINCT user_id % 4 AS a, event_type AS operation FROM events WHERE value > 90) SELECT count(*) AS n FROM m WHERE (metric = 'cie-f1' AND EXISTS (SELECT 1 FROM v WHERE 'model' || v.a = m.model AND v.operation = m.operation)) OR metric <> 'cie-f1'")
def approved_only(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf).withColumn("level", F.when(F.col("metric") == "cie-f1", "triple").otherwise("instance"))
    v = table(spark, sf, "events").where("value > 90").select(F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string")).alias("model"), F.col("event_type").alias("operation"), F.lit("a").alias("assessor"), F.lit(True).alias("verdict"))
    return scoring.approved(m, v, ["model", "operation"], "a").agg(F.count("*").alias("n"))


EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


PAIRS = f"WITH {EMB}, s AS (SELECT a.label, a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"


@query(f"{PAIRS} SELECT label, vec_id, max(cosine) AS cosine FROM s GROUP BY 1, 2")
def completeness_max_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.best_matches(*_halves(spark, sf), ["label"], "vec_id", "vec_id").drop("match")


@query(f"{PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY cosine DESC, other) AS k FROM s) SELECT label, vec_id, cosine, other AS match FROM r WHERE k = 1")
def greedy_best_match(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.best_matches(*_halves(spark, sf), ["label"], "vec_id", "vec_id")


@query(f"WITH {EMB} SELECT a.label, round(count(*) FILTER (round(list_dot_product(a.v, b.v), 6) < 0.1) / CAST(count(*) AS DOUBLE), 6) AS uniqueness FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def uniqueness_phi(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return scoring.uniqueness(e, ["label"], "vec_id", 0.1).withColumn("uniqueness", F.round("uniqueness", 6))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round(list_dot_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS \"rank\" FROM s) SELECT query, \"rank\", candidate, score FROM r WHERE \"rank\" <= 5")
def topk_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the rows whose id divides by 50; all rows are candidates."""
    e = table(spark, sf, "embeddings")
    return scoring.top_similar(e.where("vec_id % 50 = 0"), e, 5, "vec_id", "vec_id")


@query()
def optimal_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Graph-judge scores by optimal assignment within labels: no SQL form, tested against all permutations."""
    return scoring.assigned_scores(*_halves(spark, sf), "label")


@query("SELECT l_orderkey AS hash_id, count(DISTINCT e) AS entities FROM (SELECT l_orderkey, 'S' || l_suppkey AS e FROM lineitem UNION ALL SELECT l_orderkey, 'P' || l_partkey FROM lineitem) GROUP BY 1")
def entity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hash_id"), F.concat(F.lit("S"), "l_suppkey").alias("head"), F.concat(F.lit("P"), "l_partkey").alias("tail"))
    return scoring.entities_of(t, ["hash_id"]).groupBy("hash_id").agg(F.count("*").alias("entities"))


@query()
def bleu_rouge(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU and ROUGE-2 precision of each assistant turn against the turn before it."""
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    t = c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", raw_tokens(F.lower("text")).alias("a"), raw_tokens(F.lower("reference")).alias("b"))
    return t.select("conv_id", "turn", F.round(scoring.bleu(F.col("a"), F.col("b")), 6).alias("bleu"), F.round(scoring.rouge_precision(F.col("a"), F.col("b")), 6).alias("rouge2"))


CONF = "c AS (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS DOUBLE) AS d FROM labels), r AS (SELECT *, a + b + c + d AS n, (a + d) / (a + b + c + d) AS po, (a + b) / (a + b + c + d) AS x, (a + c) / (a + b + c + d) AS y FROM c)"


@query(f"WITH {CONF} SELECT round((po - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS cohen_kappa FROM r")
def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.measures(agreement.confusion(table(spark, sf, "labels"), "quality", "toxic")).select("cohen_kappa")


@query(
    f"WITH {CONF} SELECT round(po, 6) AS observed, round(2 * po - 1, 6) AS pabak, round((po - ((x + y) / 2) ** 2 - (1 - (x + y) / 2) ** 2) / (1 - ((x + y) / 2) ** 2 - (1 - (x + y) / 2) ** 2), 6) AS scott_pi, "
    "round((po - 2 * ((x + y) / 2) * (1 - (x + y) / 2)) / (1 - 2 * ((x + y) / 2) * (1 - (x + y) / 2)), 6) AS gwet_ac1, round((a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)), 6) AS mcc, round(2 * a / (2 * a + b + c), 6) AS f1, "
    "round((a / (a + b) + d / (d + c)) / 2, 6) AS balanced_accuracy FROM r"
)
def agreement_suite(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.measures(agreement.confusion(table(spark, sf, "labels"), "quality", "toxic")).select("observed", "pabak", "scott_pi", "gwet_ac1", "mcc", "f1", "balanced_accuracy")


RATINGS = "rt AS (SELECT doc_id AS item, 'q' AS rater, quality AS category, doc_id % 3 AS grp FROM labels UNION ALL SELECT doc_id, 't', toxic, doc_id % 3 FROM labels)"


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("q").alias("rater"), F.col("quality").alias("category")), F.struct(F.lit("t").alias("rater"), F.col("toxic").alias("category"))))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("item"), (F.col("doc_id") % 3).alias("grp"), each.alias("r")).select("item", "grp", "r.*")


FLEISS = (
    f"WITH {RATINGS}, c AS (SELECT item, grp, category, count(*) AS c FROM rt GROUP BY 1, 2, 3), i AS (SELECT item, grp, sum(c) AS n, sum(c * c) AS sq FROM c GROUP BY 1, 2), p AS (SELECT grp, category, sum(c) AS c FROM c GROUP BY 1, 2 UNION ALL SELECT NULL, category, sum(c) FROM c GROUP BY category), "
    "o AS (SELECT grp, avg((sq - n) / CAST(n * (n - 1) AS DOUBLE)) AS po, sum((sq - n) / CAST(n - 1 AS DOUBLE)) AS o, sum(n) AS total FROM i GROUP BY grp UNION ALL SELECT NULL, avg((sq - n) / CAST(n * (n - 1) AS DOUBLE)), sum((sq - n) / CAST(n - 1 AS DOUBLE)), sum(n) FROM i), "
    "s AS (SELECT grp, CAST(sum(c * c) AS DOUBLE) AS sq, CAST(sum(c) AS DOUBLE) AS t FROM p GROUP BY grp)"
)


@query(f"{FLEISS} SELECT o.grp, round((po - sq / (t * t)) / (1 - sq / (t * t)), 6) AS fleiss_kappa FROM o JOIN s ON o.grp IS NOT DISTINCT FROM s.grp")
def fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.fleiss_krippendorff(_ratings(spark, sf), ["grp"]).select("grp", "fleiss_kappa")


@query(f"{FLEISS} SELECT o.grp, round(1 - (1 - o.o / total) / (1 - (sq - t) / (t * (t - 1))), 6) AS krippendorff_alpha FROM o JOIN s ON o.grp IS NOT DISTINCT FROM s.grp")
def krippendorff_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.fleiss_krippendorff(_ratings(spark, sf), ["grp"]).select("grp", "krippendorff_alpha")


@query("SELECT event_id, CASE WHEN v < 0 THEN 'poor' WHEN v <= 0.2 THEN 'slight' WHEN v <= 0.4 THEN 'fair' WHEN v <= 0.6 THEN 'moderate' WHEN v <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS category FROM (SELECT event_id, value / 100.0 - 0.1 AS v FROM events)")
def kappa_category(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", agreement.kappa_category(F.col("value") / 100.0 - 0.1).alias("category"))


@query("SELECT doc_id AS item, 2 AS categories, '0,1' AS \"values\" FROM labels WHERE quality <> toxic")
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.disagreements(_ratings(spark, sf))


@query(f"WITH {RATINGS} SELECT rater, grp, count(*) AS n, count(*) FILTER (category = 1) AS passed, count(*) >= 130 AS met FROM rt GROUP BY 1, 2")
def annotation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.annotation_counts(_ratings(spark, sf), ["rater", "grp"], 130)


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS items FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def rated_by_all(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.rated_by_all(_ratings(spark, sf), 2).agg(F.floor(F.count("*") / 2).alias("rows"), F.countDistinct("item").alias("items"))


OPS = "t AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'd-triples' WHEN 'A' THEN 'e-triples' ELSE 'x-triples' END AS operation, year(l_shipdate) AS yr, CASE WHEN l_returnflag = 'R' THEN l_quantity > 25 ELSE l_discount < 0.05 END AS kept FROM lineitem)"


def _triples(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "R", "d-triples").when(F.col("l_returnflag") == "A", "e-triples").otherwise("x-triples")
    kept = instances.rule_c(F.array(op), F.col("l_discount") < 0.05, F.col("l_quantity") > 25)
    return table(spark, sf, "lineitem").select("l_orderkey", op.alias("operation"), F.year("l_shipdate").alias("yr"), kept.alias("kept"))


@query(f"WITH {OPS} SELECT operation, count(*) AS matched, count(*) FILTER (kept) AS kept, count(*) FILTER (kept) / CAST(count(*) AS DOUBLE) AS share FROM t GROUP BY 1")
def rule_c_counts(spark: SparkSession, sf: str) -> DataFrame:
    return instances.operation_counts(_triples(spark, sf))


@query(f"WITH {OPS} SELECT yr, operation, count(*) AS matched, count(*) FILTER (kept) AS kept, count(*) FILTER (kept) / CAST(count(*) AS DOUBLE) AS share FROM t GROUP BY 1, 2")
def matched_per_week(spark: SparkSession, sf: str) -> DataFrame:
    return instances.operation_counts(_triples(spark, sf), ["yr"])


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd-triples' WHEN 1 THEN 'e-triples' ELSE 'UNKNOWN' END AS op FROM events")
def primary_operation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    ops = F.array_compact(F.array(F.when(k == 0, F.lit("d-triples")), F.when(k < 2, F.lit("e-triples"))))
    return table(spark, sf, "events").select("event_id", instances.primary_operation(ops).alias("op"))


@query(
    "SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'x-triples' END, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'e-triples' END, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'ee-triples' END, CASE WHEN event_id % 7 = 0 THEN 'ee-kg-triples' END, CASE WHEN event_id % 2 = 1 THEN 'd-triples' END) AS ops FROM events"
)
def classify_operations(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.array_join(instances.operations_of(i % 2 == 0, i % 2 == 1, i % 5 == 0, i % 7 == 0, i % 3 == 0, F.lit(False)), ",").alias("ops"))


@query("SELECT user_id, coalesce(arg_min(event_id % 2 = 0, event_id) FILTER (event_type = 'click'), FALSE) AS verdict FROM events GROUP BY user_id")
def verdict_lookup(spark: SparkSession, sf: str) -> DataFrame:
    a = F.struct("event_id", F.col("event_type").alias("llm_name"), F.lit("p").alias("llm_prompt_type"), (F.col("event_id") % 2 == 0).alias("llm_assessment"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(a)).alias("a")).select("user_id", instances.verdict_of(F.col("a"), "click", "p").alias("verdict"))


@query("SELECT user_id, bool_or(event_type = 'click' AND event_id % 50 = 0) AND bool_or(event_type = 'view' AND event_id % 50 = 0) AS ok FROM events GROUP BY user_id")
def supported_triples(spark: SparkSession, sf: str) -> DataFrame:
    a = F.struct(F.col("event_type").alias("llm_name"), F.lit("p").alias("llm_prompt_type"), (F.col("event_id") % 50 == 0).alias("llm_assessment"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(a).alias("a")).select("user_id", instances.supported_by_all(F.col("a"), [("click", "p"), ("view", "p")]).alias("ok"))


@query("SELECT event_id, regexp_matches('Q' || user_id, '^Q\\d+$') AND regexp_matches(CASE WHEN event_id % 3 = 0 THEN 'P' || event_id ELSE event_type END, '^P\\d+$') AS ok FROM events")
def valid_triples(spark: SparkSession, sf: str) -> DataFrame:
    r = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("P"), "event_id")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", valid_triple(F.concat(F.lit("Q"), "user_id"), r, F.lit("Q1")).alias("ok"))


DESCRIBED = "o AS (SELECT o_custkey AS entity, o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts FROM orders), one AS (SELECT entity, ts, min(o_orderkey) AS text FROM o GROUP BY 1, 2)"


@query(f"WITH {DESCRIBED} SELECT entity, 900000000 AS \"at\", coalesce(arg_max(text, ts) FILTER (ts <= 900000000), arg_min(text, ts)) AS text FROM one GROUP BY entity")
def description_at(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions in force at an instant, else the first one."""
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts")).agg(F.min("o_orderkey").alias("text"))
    return instances.entities_at(d, [900000000])


@query("SELECT n, count(*) AS rows FROM (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) GROUP BY n")
def multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    """Sanity counts: how many keys have how many rows."""
    return table(spark, sf, "labels").groupBy("doc_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("rows"))


@query("SELECT lang, count(*) AS n, round(avg(len(string_split(text, ' '))), 6) AS mean_tokens, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY lang")
def reference_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Reference counts and lengths."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n_tokens(F.col("text"))), 6).alias("mean_tokens"), F.min(F.length("text")).cast("bigint").alias("shortest"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query("SELECT doc_id, lang, NULL AS extra FROM documents UNION ALL SELECT item_id, NULL, length(text) FROM benchmark")
def schema_union(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of different columns under one schema."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("bigint").alias("extra"))
    return table(spark, sf, "documents").select("doc_id", "lang").unionByName(b, allowMissingColumns=True)


@query(
    "WITH a AS (SELECT source, lang, n_chars % 50 AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, lang, n_chars % 50 AS k FROM documents WHERE doc_id % 2 = 1) "
    "SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"
)
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between two tables as multisets (U3): the odd and the even documents by source, language and length."""
    half = lambda odd: table(spark, sf, "documents").where(F.col("doc_id") % 2 == odd).select("source", "lang", (F.col("n_chars") % 50).alias("k"))
    a, b = half(0), half(1)
    return a.exceptAll(b).select(F.lit("a").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("b").alias("side"), "*"))


@query("SELECT (SELECT count(*) FROM documents WHERE length(text) <> n_chars) AS bad_offsets, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)) AS mixed")
def invariant_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Violation counts of what must hold (F22): offsets equal lengths, nothing is both kept (good) and dropped (toxic)."""
    labels = table(spark, sf, "labels")
    mixed = labels.where("quality = 1").select("doc_id").intersect(labels.where("toxic = 1").select("doc_id")).agg(F.count("*").alias("mixed"))
    bad = table(spark, sf, "documents").agg(F.count_if(F.length("text") != F.col("n_chars")).alias("bad_offsets"))
    return bad.withColumn("one", F.lit(1)).join(mixed.withColumn("one", F.lit(1)), "one").drop("one")
