"""The registered queries of the operators of this subpackage: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.io import table
from tidegraph.llm import decontaminate, gru_lm, kdtree, license_scan, minhash, secrets, sentencepiece_codec, subword_classifier, suffix_repeats, weak_rules
from tidegraph.llm.license_sql import FOLDERS, license_sql
from tidegraph.registry import Registry

LLM = Registry()


def piece_model(path: str | None = None) -> bytes:
    """The bytes of the SentencePiece model at path, by default the public one; the driver reads it and sends it with the tasks."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@LLM.query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents with the benchmark items found in them."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


@LLM.query()
def op2_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; a fold by id is never learnt from."""
    docs = table(spark, sf_dir, "documents")
    found, _ = gru_lm.scores(docs, subword_classifier.remainder("doc_id", 5) == 1)
    return found


@LLM.query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; SQL has no scan by automaton, so tests compare with plain expressions."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])


@LLM.query()
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of a fold by id are never learnt from."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = subword_classifier.remainder("doc_id", 4) == 2
    model = subword_classifier.learn(docs, labels.where(~fold))
    scored = subword_classifier.classify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", "predicted")


@LLM.query()
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on sets of four-word shingles."""
    found, _ = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found


@LLM.query()
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings of all documents, cut out."""
    found, _ = suffix_repeats.repeated(table(spark, sf_dir, "documents"))
    return found


@LLM.query()
def op7_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, by a k-d tree over size, language and source."""
    dims = {"bytes": F.log1p(F.coalesce(F.octet_length("text"), F.lit(0))), "lang": F.crc32(F.col("lang").cast("binary")), "source": F.crc32(F.col("source").cast("binary"))}
    found, _ = kdtree.shards(table(spark, sf_dir, "documents"), dims=dims, law="bytes")
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@LLM.query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the weakly supervised verdict on every document."""
    return weak_rules.quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


@LLM.query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document."""
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), piece_model())


@LLM.query(license_sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document; the table has no paths, so its folder is made of source, language and id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.expr(FOLDERS.format("STRING")), F.col("doc_id").cast("string"))
    return license_scan.scan(docs, path=path, keep=["doc_id"])
