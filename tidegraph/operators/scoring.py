"""Scores of predicted statements against reference ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.functions.assignment import match_score


def prf(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """precision, recall and f1, each 0 where its denominator is."""
    p = F.when(predicted > 0, tp / predicted).otherwise(F.lit(0.0))
    r = F.when(gold > 0, tp / gold).otherwise(F.lit(0.0))
    f = F.when(tp > 0, 2 * tp / (predicted + gold)).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def exact_match(gold: DataFrame, predicted: DataFrame, key: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Set scores of each key (M1, U2): two empty sides cannot occur in a row; a key with one side scores 0."""
    both = gold.select(*key, *item).distinct().withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(predicted.select(*key, *item).distinct().withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    items = both.groupBy(*key, *item).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = items.groupBy(*key).agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.col("g") * F.col("p")).alias("tp"))
    return sums.select(*key, "gold", "predicted", "tp", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def micro(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro scores from per-key sums."""
    sums = scores.groupBy(*by).agg(F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    return sums.select(*by, "gold", "predicted", "tp", *prf(F.col("tp"), F.col("predicted"), F.col("gold")))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two number arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one is null in length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(df: DataFrame, vector: str) -> DataFrame:
    """Vectors scaled to length 1, once a row, so that pairs need one product."""
    return df.withColumn("__n", F.sqrt(dot(F.col(vector), F.col(vector)))).withColumn(vector, F.transform(F.col(vector), lambda x: F.when(F.col("__n") > 0, x.cast("double") / F.col("__n")).otherwise(F.lit(0.0)))).drop("__n")


def best_matches(left: DataFrame, right: DataFrame, key: Sequence[str], left_id: str, right_id: str, vector: str = "embedding") -> DataFrame:
    """Each left row's best right row of the same key by cosine (M2, M6); ties go to the lower id. Keys are instances, so groups are small."""
    a = unit(left.select(*key, left_id, F.col(vector).alias("a")), "a")
    b = unit(right.select(*key, F.col(right_id).alias("other"), F.col(vector).alias("b")), "b")
    scored = a.join(b, list(key)).withColumn("cosine", F.round(dot(F.col("a"), F.col("b")), 6))
    best = scored.groupBy(*key, left_id).agg(F.max(F.struct("cosine", (-F.col("other")).alias("o"))).alias("m"))
    return best.select(*key, left_id, F.col("m.cosine").alias("cosine"), (-F.col("m.o")).alias("match"))


def uniqueness(df: DataFrame, key: Sequence[str], order: str, phi: float, vector: str = "embedding") -> DataFrame:
    """Share of unordered pairs of a key whose cosine is under phi; 1.0 with fewer than two (M8)."""
    u = unit(df.select(*key, order, F.col(vector).alias("v")), "v")
    pairs = u.select(*key, F.col(order).alias("i"), F.col("v").alias("a")).join(u.select(*key, F.col(order).alias("j"), F.col("v").alias("b")), list(key)).where("i < j")
    shares = pairs.groupBy(*key).agg(F.count("*").alias("pairs"), F.count_if(F.round(dot(F.col("a"), F.col("b")), 6) < phi).alias("unlike"))
    return df.select(*key).distinct().join(shares, list(key), "left").select(*key, F.coalesce(F.col("unlike") / F.col("pairs"), F.lit(1.0)).alias("uniqueness"))


def top_similar(queries: DataFrame, candidates: DataFrame, k: int, query_id: str, candidate_id: str, vector: str = "embedding", most: int = 10_000) -> DataFrame:
    """The k candidates of largest dot product, to six digits, of each query (O6), ties to the lower id.

    The query set goes to all tasks in blocks of at most `most` vectors, one pass over the candidates each. A task keeps the k best of each of its
    batches (and what ties with the last of them), so only these are shuffled and merged.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias("query"), F.col(vector).alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-asked.count() // most))
    given = candidates.select(F.col(candidate_id).alias("candidate"), F.col(vector).alias("v")).where("v IS NOT NULL")
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, candidate {given.schema['candidate'].dataType.simpleString()}, score double"
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["v"] for r in rows], float)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                if len(ids) and len(pdf):
                    s = np.round(np.stack(pdf["v"]).astype(float) @ q.T, 6)
                    least = np.partition(s, max(len(s) - k, 0), axis=0)[max(len(s) - k, 0)]
                    row, column = np.nonzero(s >= least)
                    yield pd.DataFrame({"query": [ids[c] for c in column], "candidate": pdf["candidate"].to_numpy()[row], "score": s[row, column]})

        part = given.mapInPandas(best, kinds)
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "candidate"))).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "candidate", "score")


def assigned_scores(gold: DataFrame, predicted: DataFrame, key: str, vector: str = "embedding", epsilon: float = 1e-12) -> DataFrame:
    """Scores by optimal assignment of cosines within each key (M3, M4): a cogrouped pandas function; keys are instances."""

    def one(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        # A side without rows may come without its columns.
        size = lambda f: len(f) if vector in f.columns else 0
        pack = lambda f: np.array(list(f[vector]), float).reshape(len(f), -1) if size(f) else np.zeros((0, 1))
        name = (g if size(g) else p)[key].iloc[0]
        return pd.DataFrame([(name, size(g), size(p), *match_score(pack(g), pack(p), epsilon))], columns=[key, "gold", "predicted", "precision", "recall", "f1"])

    kind = gold.schema[key].dataType.simpleString()
    return gold.groupBy(key).cogroup(predicted.groupBy(key)).applyInPandas(one, f"{key} {kind}, gold bigint, predicted bigint, precision double, recall double, f1 double")


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams of an array as strings; empty if there are too few tokens."""
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))).otherwise(F.array().cast("array<string>"))


def clipped(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two string arrays."""
    # One pass over both in order, a's copies of a string before b's: each of b's takes one of those left.
    side = lambda z, k: F.transform(z, lambda x: F.struct(x.alias("x"), F.lit(k).alias("side")))

    def step(s: Column, e: Column) -> Column:
        left = F.when(s["x"] == e["x"], s["left"]).otherwise(0)
        taken = F.when((e["side"] == 1) & (left > 0), 1).otherwise(0)
        return F.struct(e["x"].alias("x"), F.when(e["side"] == 0, left + 1).otherwise(left - taken).alias("left"), (s["total"] + taken).alias("total"))

    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("left"), F.lit(0).alias("total"))
    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, step, lambda s: s["total"])


def bleu(candidate: Column, reference: Column, orders: int = 4) -> Column:
    """Sentence BLEU of token arrays, n-gram counts smoothed by adding one from order two on (M5)."""
    total = F.lit(0.0)
    for n in range(1, orders + 1):
        c, r = ngrams(candidate, n), ngrams(reference, n)
        plus = 0 if n == 1 else 1
        total = total + F.log(F.greatest((clipped(c, r) + plus) / F.greatest(F.size(c) + plus, F.lit(1)), F.lit(1e-9))) / orders
    brevity = F.when(F.size(candidate) >= F.size(reference), 0.0).otherwise(1 - F.size(reference) / F.greatest(F.size(candidate), F.lit(1)))
    return F.when((F.size(candidate) > 0) & (F.size(reference) > 0), F.exp(total + brevity)).otherwise(F.lit(0.0))


def rouge_precision(candidate: Column, reference: Column, n: int = 2) -> Column:
    """Share of the candidate's n-grams that the reference has, counted with multiplicity (M5)."""
    c, r = ngrams(candidate, n), ngrams(reference, n)
    return F.when(F.size(c) > 0, clipped(c, r) / F.size(c)).otherwise(F.lit(0.0))


def entities_of(triples: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct head and tail labels of each key (M7)."""
    return triples.select(*key, F.explode(F.array("head", "tail")).alias("entity")).distinct()


def with_empty_as_zero(instances: DataFrame, scores: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Every instance with gold has a row; those without predictions score 0."""
    return instances.select(*key).distinct().join(scores, list(key), "left").select(*key, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])


def metric_rows(scores: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide scores as (key, metric, score) rows."""
    return scores.unpivot(list(key), list(metrics), "metric", "score")


def scaled(metrics: DataFrame, judge: str = "judge") -> DataFrame:
    """Scores on a common scale of 100: times 20 in judge groups, times 100 otherwise."""
    return metrics.withColumn("score", F.when(F.col("metric").contains(judge), F.col("score") * 20).otherwise(F.col("score") * 100))


def thresholded(metrics: DataFrame, metric: str, over: float = 0.9) -> DataFrame:
    """All rows, and the metric once more as 1.0 or 0.0 around a threshold."""
    more = metrics.where(F.col("metric") == metric).withColumn("metric", F.lit(f"{metric}>{over}")).withColumn("score", (F.col("score") > over).cast("double"))
    return metrics.unionByName(more)


def mean_scores(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean score of each group."""
    return metrics.groupBy(*by).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


def best_two(means: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rank of each model within a metric: 1 best, 2 second best, equal scores share a rank."""
    return means.withColumn("place", F.dense_rank().over(Window.partitionBy(*within).orderBy(F.desc("mean_score"))))


def setting_difference(metrics: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Mean under the second setting minus the first; groups that lack one go."""
    wide = metrics.groupBy(*by).pivot("setting", [first, second]).agg(F.avg("score"))
    return wide.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*by, F.round(F.col(second) - F.col(first), 6).alias("difference"))


def approved(metrics: DataFrame, verdicts: DataFrame, key: Sequence[str], assessor: str) -> DataFrame:
    """Triple-level rows that the assessor approved, and all instance-level rows."""
    good = verdicts.where((F.col("assessor") == assessor) & F.col("verdict")).select(*key)
    return metrics.where("level = 'triple'").join(good, list(key), "left_semi").unionByName(metrics.where("level <> 'triple'"))


def in_snapshot(predictions: DataFrame, statements: DataFrame, key: Sequence[str], column: str = "existing") -> DataFrame:
    """Predictions with a flag that tells whether their statement is in the graph's snapshot of their time.

    key names the snapshot and the statement. A null in a key is in no snapshot; repeated statements do not multiply predictions.
    """
    known = statements.select(*key).distinct().withColumn(column, F.lit(True))
    return predictions.join(known, list(key), "left").withColumn(column, F.coalesce(column, F.lit(False)))


def with_metadata(metrics: DataFrame, instances: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Metric rows with what is known of their instance (J18); rows of unknown instances go. Instances are unique by key."""
    return metrics.join(instances.select(key, *columns), key)


def with_specification(metrics: DataFrame, specification: DataFrame, labels: DataFrame, key: Sequence[str], label_key: str) -> DataFrame:
    """Metric rows that a specification by key asks for, with its columns, and with the label of label_key, null without one."""
    return metrics.join(specification, list(key)).join(labels, label_key, "left")


def known_relations(triples: DataFrame, relations: DataFrame, key: Sequence[str]) -> DataFrame:
    """Triples whose relation is known to their snapshot (F12); key names snapshot and relation."""
    return triples.join(relations.select(*key).distinct(), list(key), "left_semi")


def entity_tails(triples: DataFrame, tail: str = "tail") -> DataFrame:
    """Triples whose tail is an entity id (F4); a null or literal tail goes."""
    return triples.where(F.col(tail).rlike(r"^Q\d+$"))


def of_models(rows: DataFrame, models: Sequence[str], model: str = "model", gold: str = "gold") -> DataFrame:
    """Rows of the given models, those of the reference always."""
    return rows.where(F.col(model).isin(gold, *models))


def colliding(rows: DataFrame, code: str, content: Sequence[str]) -> DataFrame:
    """Codes that stand for several contents, and how many (X2): collisions are reported, not retried."""
    return rows.select(code, *content).distinct().groupBy(code).agg(F.count("*").alias("contents")).where("contents > 1")


def first_rows(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first rows in that order, at most so many (O14); the order should end in a unique column."""
    return rows.orderBy(*order).limit(most)


def evaluate(rows: DataFrame, metrics: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """All rows of several metrics, in the order of the list, with the name of each and its place (M12). Metrics return equal columns."""
    out = None
    for place, (name, metric) in enumerate(metrics):
        part = metric(rows).select(F.lit(place).alias("place"), F.lit(name).alias("metric"), "*")
        out = part if out is None else out.unionByName(part)
    return out
