"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of docs, the last one the encoding's
digests. run() writes each stage's rows as Parquet into the shared folder and rereads them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.io import table
from tidegraph.llm import decontaminate, minhash, secrets, sentencepiece_codec, weak_rules
from tidegraph.llm.queries import piece_model
from tidegraph.llm.store import Scratch

REDACTED = "[redacted]"


def _own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator's columns clash with, and the new name of each column."""
    names = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    renamed, names = _own_names(docs)
    judged = weak_rules.quality(renamed, text=names["text"], keep=[*names.values()])
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id (five-word shingles, similarity 0.8)."""
    found, behind = minhash.near_duplicates(docs, k=5, percent=80)
    found = Scratch(spark, "near").keep(found.where("doc_id IS NOT NULL").select("doc_id", "kept"), "found")
    behind.drop()
    gone = found.where("NOT kept").select("doc_id").distinct()
    # Ids of what goes are sent to all tasks if they are few enough, else both sides are dealt out by id.
    few = gone.count() <= minhash.BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    # An id that repeats is one document: of its rows the first by text stays.
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    rest = kept.join(repeated, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = rest.groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("r")).select("doc_id", "r.*")
    return single.unionByName(least.select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; no document goes."""
    renamed, names = _own_names(docs)
    found = secrets.find_secrets(renamed, text=names["text"], keep=[*names.values()], redact=REDACTED)
    changed = {"text": F.when(F.col(names["text"]).isNotNull(), F.col("redacted"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col(names["text"]).isNotNull() & F.col(names["n_chars"]).isNotNull(), F.length("redacted").cast("bigint"))
    return found.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of what is left."""
    return sentencepiece_codec.encode_decode(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", secrets_removed),
    ("sentencepiece", encoded),
]
#: SQL has no expectation-maximisation, sketches or tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
