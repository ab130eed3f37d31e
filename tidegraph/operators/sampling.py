"""Deterministic samples: hash order instead of a random generator, so that reruns and retries agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(*key: str, seed: int = 0) -> Column:
    """A pseudo-random order that depends on the key and a seed only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Position in the group and number of the batch of a size."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("n", n).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("bigint"))


def round_robin(df: DataFrame, source: str, order: Sequence[str], rounds: int) -> DataFrame:
    """The first rounds rows of each source, with the round as turn: ordering by (turn, source) alternates the sources."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("turn") <= rounds)


def choose(df: DataFrame, how: str, n: int, score: str, key: str, buckets: int = 4, seed: int = 0) -> DataFrame:
    """n rows: the top by score, a hash sample, or equal parts of score quartiles."""
    if how == "top":
        return df.orderBy(F.desc(score), key).limit(n)
    if how == "random":
        return df.orderBy(hash_order(key, seed=seed), key).limit(n)
    cuts = df.approxQuantile(score, [k / buckets for k in range(1, buckets)], 0.0)
    bucket = sum(((F.col(score) > c).cast("int") for c in cuts), F.lit(0))
    w = Window.partitionBy("bucket").orderBy(hash_order(key, seed=seed), key)
    return df.withColumn("bucket", bucket).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n // buckets).drop("__n")


def shortest(df: DataFrame, group: Sequence[str], text: str, key: str) -> DataFrame:
    """The shortest text of each group, ties by key."""
    return df.groupBy(*group).agg(F.min_by(F.struct(key, text), F.struct(F.length(text), F.col(key))).alias("s")).select(*group, "s.*")


def of_many_types(df: DataFrame, key: str, kind: str, least: int, n: int, seed: int = 0) -> DataFrame:
    """n keys that have at least so many kinds, in hash order."""
    many = df.groupBy(key).agg(F.countDistinct(kind).alias("kinds")).where(F.col("kinds") >= least)
    return many.orderBy(hash_order(key, seed=seed), key).limit(n)


def quotas(df: DataFrame, group: Sequence[str], key: str, operations: str, order: Sequence[str], quota: int) -> DataFrame:
    """Per group, passes over operations in an order; a chosen row counts toward the later quotas of all its operations.

    operations is an array column. Groups are one delta each, small enough for one pandas call.
    """
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__h=pd.util.hash_pandas_object(pdf[key].astype(str), index=False)).sort_values(["__h", key]).drop(columns="__h")
        counts: dict[str, int] = {}
        chosen: list[int] = []
        for op in order:
            for i, ops in zip(range(len(pdf)), pdf[operations]):
                if counts.get(op, 0) >= quota:
                    break
                if i not in chosen and op in ops:
                    chosen.append(i)
                    for o in ops:
                        counts[o] = counts.get(o, 0) + 1
        return pdf.iloc[chosen]

    return df.groupBy(*group).applyInPandas(pick, df.schema)


def rarest_first(counts: dict[str, int], wanted: int, rows: Sequence[tuple[str, Sequence[str]]]) -> list[str]:
    """Keys chosen so that the class with the fewest so far is served next (O12); a fold over a few thousand collected rows."""
    have, left, chosen = dict(counts), list(rows), []
    while left and len(chosen) < wanted:
        for kind in sorted(have, key=lambda c: (have[c], c)):
            hit = next((k for k, (_, kinds) in enumerate(left) if kind in kinds), None)
            if hit is not None:
                name, kinds = left.pop(hit)
                chosen.append(name)
                for k in kinds:
                    have[k] = have.get(k, 0) + 1
                break
        else:
            break
    return chosen
