"""Agreement of raters, in closed form on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Counts n11, n10, n01, n00 of two binary raters; rows with a null rating are left out."""
    x, y = F.col(a) == 1, F.col(b) == 1
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or [])).agg(
        F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00")
    )


def measures(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Cohen's kappa and the measures beside it (G15, G16); null where a denominator is 0.

    scott_as_coded takes Cohen's expected agreement, as the published tables do; scott_pi is the pooled form.
    """
    n11, n10, n01, n00 = (F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00"))
    n = n11 + n10 + n01 + n00
    po = F.try_divide(n11 + n00, n)
    a1, b1 = F.try_divide(n11 + n10, n), F.try_divide(n11 + n01, n)
    pe = a1 * b1 + (1 - a1) * (1 - b1)
    mean = (a1 + b1) / 2
    pooled, gwet = mean * mean + (1 - mean) * (1 - mean), 2 * mean * (1 - mean)
    over = lambda e: F.try_divide(po - e, 1 - e)
    mcc = F.try_divide(n11 * n00 - n10 * n01, F.sqrt((n11 + n10) * (n11 + n01) * (n00 + n10) * (n00 + n01)))
    balanced = (F.try_divide(n11, n11 + n10) + F.try_divide(n00, n00 + n01)) / 2
    out = {
        "observed": po, "cohen_kappa": over(pe), "pabak": 2 * po - 1, "scott_as_coded": over(pe), "scott_pi": over(pooled), "gwet_ac1": over(gwet), "mcc": mcc,
        "f1": F.try_divide(2 * n11, 2 * n11 + n10 + n01), "balanced_accuracy": balanced,
    }
    return counts.select("*", *[F.round(c, digits).alias(k) for k, c in out.items()])


def kappa_category(kappa: Column) -> Column:
    """Name of a kappa's range."""
    return F.when(kappa < 0, "poor").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair").when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").when(kappa.isNotNull(), "almost perfect")


def rated_by_all(ratings: DataFrame, raters: int, item: str = "item") -> DataFrame:
    """Items that so many raters rated."""
    full = ratings.groupBy(item).agg(F.countDistinct("rater").alias("n")).where(F.col("n") == raters).select(item)
    return ratings.join(full, item, "left_semi")


def fleiss_krippendorff(ratings: DataFrame, by: list[str] | None = None, item: str = "item", digits: int = 6) -> DataFrame:
    """Fleiss' kappa and Krippendorff's nominal alpha of (item, rater, category) rows.

    Per item the squared category counts give the observed agreement; the categories' shares the expected one.
    With by, also one row for all groups together (null there). Items of a single rating count for neither.
    """
    by = by or []
    counts = ratings.groupBy(*by, item, "category").agg(F.count("*").alias("c"))
    items = counts.groupBy(*by, item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    paired = items.where("n > 1")
    # Category totals over paired items only.
    totals = counts.join(paired.select(*by, item, "n"), [*by, item]).select(*by, "category", "c")
    group = (lambda df: df.rollup(*by)) if by else (lambda df: df.groupBy())
    observed = group(paired).agg(F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("po"), F.sum((F.col("sq") - F.col("n")) / (F.col("n") - 1)).alias("o"), F.sum("n").alias("total"), F.count("*").alias("items"))
    shares = (totals.rollup(*by, "category") if by else totals.groupBy("category")).agg(F.sum("c").alias("c"))
    if by:
        # rollup also yields group totals without category; grouping sets of (by, category) and (category) are needed.
        shares = totals.groupBy(*by, "category").agg(F.sum("c").alias("c")).unionByName(totals.groupBy("category").agg(F.sum("c").alias("c")).select(*[F.lit(None).cast(totals.schema[b].dataType).alias(b) for b in by], "category", "c"))
    squares = shares.groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).cast("double").alias("sq"), F.sum("c").cast("double").alias("t"))
    pairs = observed.alias("o").join(squares.alias("s"), [F.col(f"o.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]) if by else observed.join(F.broadcast(squares))
    pe = F.col("sq") / (F.col("t") * F.col("t"))
    do = 1 - F.col("o") / F.col("total")
    de = 1 - (F.col("sq") - F.col("t")) / (F.col("t") * (F.col("t") - 1))
    return pairs.select(*[F.col(f"o.{b}").alias(b) for b in by], "items", F.round(F.try_divide(F.col("po") - pe, 1 - pe), digits).alias("fleiss_kappa"), F.round(1 - F.try_divide(do, de), digits).alias("krippendorff_alpha"))


def disagreements(ratings: DataFrame, item: str = "item") -> DataFrame:
    """Items whose raters differ, with their sorted categories."""
    out = ratings.groupBy(item).agg(F.countDistinct("category").alias("categories"), F.array_join(F.array_sort(F.collect_set(F.col("category").cast("string"))), ",").alias("values"))
    return out.where("categories > 1")


def annotation_counts(ratings: DataFrame, by: list[str], quota: int) -> DataFrame:
    """Ratings of each group, those that passed, and whether a quota is met."""
    out = ratings.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("category") == 1).alias("passed"))
    return out.withColumn("met", F.col("n") >= quota)
