"""Passage instances: reading, verdicts, classification, repairs and tables for evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("x-triples", "e-triples", "ee-triples", "ee-kg-triples", "d-triples")
ASSESSMENT = "struct<llm_name: string, llm_assessment: boolean, llm_prompt_type: string, llm_prompt: string>"
TRIPLE = (
    "struct<triple: array<string>, triple_labels: array<string>, tkgu_operations: array<string>, emerging_head: boolean, emerging_tail: boolean, head_creation_date: string, "
    "head_creation_timestamp: bigint, tail_creation_date: string, tail_creation_timestamp: bigint, triple_lifespan_date: array<string>, triple_lifespan_timestamp: array<bigint>, "
    f"llm_assessment: array<{ASSESSMENT}>, source_delta_type: string, "
    "qualifier_info: struct<qualifier_qid: string, qualifier_label: string, qualifier_date: string, qualifier_timestamp: bigint>>"
)
INSTANCE = (
    "hash_id string, passage string, chunk string, mentions array<struct<mention_text: string, target_entity: string, start_char: int, end_char: int, qid: string>>, "
    "revision_id bigint, revision_date string, revision_timestamp bigint, passage_id bigint, passage_date string, passage_timestamp bigint, "
    "anchor_title string, anchor_page_id bigint, anchor_page_qid string, paragraph_idx int, delta_dates array<string>, delta_timestamps array<bigint>, "
    f"tkgu_triples array<{TRIPLE}>, predictions string"
)


def normalize_instance(df: DataFrame) -> DataFrame:
    """One schema from the names that fields had over time: chunk or passage, passage_* or revision_*; predictions stays text for from_json or parse_json."""
    out = df.withColumn("passage", F.coalesce("passage", "chunk"))
    for new, old in (("revision_id", "passage_id"), ("revision_date", "passage_date"), ("revision_timestamp", "passage_timestamp")):
        out = out.withColumn(new, F.coalesce(new, old))
    return out.drop("chunk", "passage_id", "passage_date", "passage_timestamp")


def verdict_of(assessments: Column, llm: str, prompt_type: str) -> Column:
    """The first verdict of a model and prompt type; missing is false."""
    hit = F.filter(assessments, lambda a: (a["llm_name"] == llm) & (a["llm_prompt_type"] == prompt_type))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["llm_assessment"], F.lit(False))


def supported_by_all(assessments: Column, required: Sequence[tuple[str, str]]) -> Column:
    """Every required (model, prompt type) has a true verdict."""
    out = F.lit(True)
    for llm, kind in required:
        out = out & F.exists(assessments, lambda a: (a["llm_name"] == llm) & (a["llm_prompt_type"] == kind) & F.coalesce(a["llm_assessment"], F.lit(False)))
    return out


def rule_c(operations: Column, assertion: Column, deprecation: Column) -> Column:
    """Deprecations anywhere take the deprecation verdict, all else the assertion verdict."""
    return F.when(F.array_contains(operations, "d-triples"), deprecation).otherwise(assertion)


def primary_operation(operations: Column) -> Column:
    """The first operation, UNKNOWN without one (F16)."""
    return F.coalesce(F.try_element_at(operations, F.lit(1)), F.lit("UNKNOWN"))


def operations_of(added: Column, removed: Column, existing: Column, entity_to_kg: Column, emerging_head: Column, emerging_tail: Column) -> Column:
    """Operations of a triple from what happened to it (R1), each once, in the order of OPERATIONS."""
    new_end = emerging_head | emerging_tail
    return F.array_compact(
        F.array(
            F.when(existing, F.lit("x-triples")), F.when(added & ~new_end, F.lit("e-triples")), F.when(added & new_end, F.lit("ee-triples")),
            F.when(entity_to_kg, F.lit("ee-kg-triples")), F.when(removed, F.lit("d-triples")),
        )
    )


def removal_stands(flagged: Column, first: Column, second: Column) -> Column:
    """A removal stays only if both assessors agree (R2)."""
    return flagged & first & second


def rename_assessors(triples: Column, names: dict[str, str]) -> Column:
    """Assessor names replaced within an array of triples."""

    def renamed(a: Column) -> Column:
        out = a["llm_name"]
        for old, new in names.items():
            out = F.when(a["llm_name"] == old, new).otherwise(out)
        return a.withField("llm_name", out)

    return F.transform(triples, lambda t: t.withField("llm_assessment", F.transform(t["llm_assessment"], renamed)))


def strip_verdicts(triples: Column, llm: str) -> Column:
    """One model's verdicts out of an array of triples."""
    return F.transform(triples, lambda t: t.withField("llm_assessment", F.filter(t["llm_assessment"], lambda a: a["llm_name"] != llm)))


def useful(n: Column, mentions: Column, removed: Column, least: int, qualifier_removed: Column, emerging: Column) -> Column:
    """Snippet worth keeping (F17): enough mentions matched and not all of it removed, or a removed qualifier, or a new entity."""
    enough = (n * 2 >= mentions) | (n >= least)
    return (enough & ~removed & (n > mentions * 0.2)) | qualifier_removed | emerging


def after_removal(revision_ts: Column, removals: Column) -> Column:
    """The passage does not precede the latest removal it would show."""
    return F.coalesce(revision_ts >= F.array_max(removals), F.lit(True))


def exploded(instances: DataFrame) -> DataFrame:
    """One row a triple and operation: the gold table."""
    t = instances.select("hash_id", "revision_timestamp", F.posexplode("tkgu_triples").alias("position", "t"))
    return t.select("hash_id", "revision_timestamp", "position", F.col("t.triple").alias("triple"), F.col("t.llm_assessment").alias("llm_assessment"), F.explode("t.tkgu_operations").alias("tkgu_type"))


def exploded_predictions(predictions: DataFrame, tasks: dict[str, Sequence[str]]) -> DataFrame:
    """Prediction rows (hash_id, model, model_type, payload, head, relation, tail) under every task its type feeds (R6): tasks maps model_type to task names."""
    kinds = F.create_map(*[x for k, v in tasks.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return predictions.select("*", F.explode(F.try_element_at(kinds, F.col("model_type"))).alias("tkgu_type"))


def flatten_predictions(df: DataFrame, triples: str, relations: str | None = None) -> DataFrame:
    """Arrays of predicted triples as distinct rows; a parallel array may give canonical relations by position."""
    if relations is None:
        return df.select("hash_id", F.explode(F.array_distinct(triples)).alias("t")).select("hash_id", "t.*")
    zipped = F.arrays_zip(F.col(triples).alias("t"), F.col(relations).alias("r"))
    fixed = F.transform(zipped, lambda z: z["t"].withField("relation", F.coalesce(z["r"], z["t"]["relation"])))
    return df.select("hash_id", F.explode(F.array_distinct(fixed)).alias("t")).select("hash_id", "t.*")


def annotated(instances: DataFrame) -> DataFrame:
    """Instances with at least one human assessment."""
    return instances.where(F.exists("tkgu_triples", lambda t: F.size(t["human_assessment"]) > 0))


def entities_at(dictionary: DataFrame, instants: Sequence[int]) -> DataFrame:
    """Each entity's description in force at each instant, else its first one (R14, R15). dictionary: entity, ts, text."""
    at = F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in instants])).alias("at")
    each = dictionary.select("entity", "ts", "text", at).groupBy("entity", "at")
    out = each.agg(F.max_by("text", F.when(F.col("ts") <= F.col("at"), F.col("ts"))).alias("current"), F.min_by("text", "ts").alias("first"))
    return out.select("entity", "at", F.coalesce("current", "first").alias("text"))


def missing_work(triples: DataFrame, verdicts: DataFrame, key: Sequence[str], batch: int) -> DataFrame:
    """Triples without a verdict, numbered into batches of a size within each passage."""
    from pyspark.sql.window import Window

    todo = triples.join(verdicts.select(*key).distinct(), list(key), "left_anti")
    n = F.row_number().over(Window.partitionBy(key[0]).orderBy(*key[1:]))
    return todo.withColumn("batch", F.floor((n - 1) / batch).cast("bigint"))


def operation_counts(triples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matched and kept triples of each operation with the kept share (G2, G3, G22). Needs operation and kept."""
    out = triples.groupBy(*by, "operation").agg(F.count("*").alias("matched"), F.count_if("kept").alias("kept"))
    return out.withColumn("share", F.col("kept") / F.col("matched"))


def normalized_actions(action: Column, to_ts: Column, window_end: Column, qualifier_action: Column) -> Column:
    """What happened to a matched triple, as names in a fixed order.

    A removal counts only if the triple's life ends within the window; a triple without any action is to be dropped.
    """
    removed = (action == 0) & to_ts.isNotNull() & (to_ts <= window_end)
    return F.array_compact(
        F.array(
            F.when(removed, F.lit("removed_edge")), F.when(action == 1, F.lit("added_edge")),
            F.when(qualifier_action == 0, F.lit("qualifier_removed_edge")), F.when(qualifier_action == 1, F.lit("qualifier_added_edge")),
        )
    )


def with_actions(triples: DataFrame) -> DataFrame:
    """Matched triples with their actions and life span (R5). Needs action, from_ts, to_ts, window_end, qualifier_action; those without an action go."""
    out = triples.withColumn("actions", normalized_actions(F.col("action"), F.col("to_ts"), F.col("window_end"), F.col("qualifier_action")))
    date = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return out.where(F.size("actions") > 0).withColumn("triple_lifespan_timestamp", F.array("from_ts", "to_ts")).withColumn("triple_lifespan_date", F.array(date(F.col("from_ts")), date(F.col("to_ts"))))
