"""Profiles of foreign datasets, whatever format they came in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "text": "text", "ttl": "text", "orc": "orc", "xml": "xml"}


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """A dataset of one of the known kinds; gz and bz2 files are read as they are. json: one document that may span lines."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if kind == "json":
        reader = reader.option("multiLine", "true")
    if kind == "tsv":
        reader = reader.option("sep", "\t").option("quote", "")
    return reader.format(READERS[kind]).load(path)


def turtle(lines: DataFrame) -> DataFrame:
    """(head, relation, tail) of simple turtle statements, one a line."""
    pattern = r"^\s*(\S+)\s+(\S+)\s+(.+?)\s*\.\s*$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    return lines.where(~F.col("value").rlike(r"^\s*(@|#|$)")).select(part(1).alias("head"), part(2).alias("relation"), part(3).alias("tail")).where("head <> ''")


def dataset_profile(triples: DataFrame) -> DataFrame:
    """Distinct instances, relations, entities and triples of (instance, head, relation, tail) rows."""
    t = triples.select("instance", "head", "relation", "tail")
    ends = t.select(F.explode(F.array("head", "tail")).alias("e")).agg(F.countDistinct("e").alias("entities"))
    counts = t.agg(F.countDistinct("instance").alias("instances"), F.countDistinct("relation").alias("relations"), F.countDistinct("head", "relation", "tail").alias("triples"))
    return counts.join(F.broadcast(ends)).select("instances", "relations", "entities", "triples")
