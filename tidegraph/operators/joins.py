"""Joins of the blueprint: redirect closure, as-of, mentions, priorities, splices.

Range conditions always come with an equality on an entity or title, so that plans are hash or sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.operators.temporal import cut, few


def closure(redirects: DataFrame) -> DataFrame:
    """(source, target) with the last target of each chain of redirects.

    Pointer doubling: each round joins the table with itself, so chains of 2**k hops take k rounds; rounds end when none
    finds a last target that was open before, and what is open then runs into a circle. Such a source keeps
    its own id. source must be unique. Each round is cut by checkpoint() where the session has a folder for it.
    """
    folder = redirects.sparkSession.sparkContext.getCheckpointDir()
    cut = (lambda df: df.checkpoint()) if folder else (lambda df: df.cache())
    now, open_ = cut(redirects.where("source <> target").select("source", "target")), None
    sources = now.select(F.col("source").alias("target"))
    while True:
        pending = now.join(sources, "target", "left_semi")
        left = pending.count()
        if left in (0, open_):
            break
        open_ = left
        step = now.select(F.col("source").alias("target"), F.col("target").alias("further"))
        now = cut(now.join(step, "target", "left").select("source", F.coalesce("further", "target").alias("target")))
    circle = pending.select("source").withColumn("circle", F.lit(True))
    return now.join(circle, "source", "left").select("source", F.when(F.col("circle"), F.col("source")).otherwise(F.col("target")).alias("target"))


def resolve(df: DataFrame, closed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by the last targets of their redirects."""
    for c in columns:
        df = df.join(closed.select(F.col("source").alias(c), F.col("target").alias(f"__{c}")), c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return df


def decorate(df: DataFrame, labels: DataFrame, column: str, to: str, default: Column | None = None) -> DataFrame:
    """A label for an id (J2): labels has id and label; without one, the default or the id itself."""
    return df.join(labels.select(F.col("id").alias(column), F.col("label").alias("__label")), column, "left").withColumn(to, F.coalesce("__label", default if default is not None else F.col(column).cast("string"))).drop("__label")


def attach_creation(edges: DataFrame, created: DataFrame) -> DataFrame:
    """head_created and tail_created: the earliest known time of each end, null if unknown."""
    first = created.groupBy("entity").agg(F.min("created").alias("created"))
    for end in ("head", "tail"):
        edges = edges.join(first.select(F.col("entity").alias(end), F.col("created").alias(f"{end}_created")), end, "left")
    return edges


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], value: Sequence[str], ts: str = "ts", strict: bool = True, forward: bool = False) -> DataFrame:
    """For each left row the right row of the same key that is latest before its time (J5), or with forward, first after it.

    Both sides go through one window over (key, time), so the work is a sort instead of a product of matches. value: columns
    taken from the right; equal right times are ordered by these columns. Left rows without a match get nulls.
    """
    columns = left.columns
    mark = F.struct(F.col(ts).alias("at"), *[F.col(v) for v in value])
    rows = left.withColumn("__row", F.monotonically_increasing_id()).withColumn("__side", F.lit(1 if strict == forward else 0))
    # Order at equal times: with a strict bound a right row must not be seen by a left row of its own time.
    rows = rows.select(*on, F.col(ts).alias("__ts"), "__side", F.struct(*[F.col(c) for c in columns]).alias("__left"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("__right"))
    keys = right.select(*on, F.col(ts).alias("__ts"), F.lit(0 if strict == forward else 1).alias("__side"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), mark.alias("__right"))
    both = rows.unionByName(keys)
    order = [F.col("__ts"), F.col("__side"), F.col("__right")]
    if forward:
        order = [F.desc("__ts"), F.desc("__side"), F.desc("__right")]
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).where("__left IS NOT NULL")
    return found.select(*[F.col("__left")[c].alias(c) for c in columns], F.col("__found.at").alias("match_ts"), *[F.col("__found")[v].alias(v) for v in value])


def follow_moves(start: DataFrame, moves: DataFrame, hops: int = 1000) -> DataFrame:
    """The final title of each (title, ts) after all later moves (J7): moves has title, new_title, ts.

    Each round follows one move of every title still moving; rounds end when none moves, or after hops.
    """
    cut = start.sparkSession.sparkContext.getCheckpointDir() is not None
    now = start.select("title", "ts", F.col("title").alias("final"), F.col("ts").alias("at"))
    for _ in range(hops):
        nexts = moves.select(F.col("title").alias("final"), "new_title", F.col("ts").alias("move_ts"))
        found = now.join(nexts, "final").where("move_ts > at").groupBy("title", "ts").agg(F.min(F.struct("move_ts", "new_title")).alias("m"))
        if found.isEmpty():
            break
        now = now.join(found, ["title", "ts"], "left").select("title", "ts", F.coalesce("m.new_title", "final").alias("final"), F.coalesce("m.move_ts", "at").alias("at"))
        if cut:
            now = now.checkpoint()
    return now.select("title", "ts", "final")


def both_ends(edges: DataFrame, mentions: DataFrame, passage: str = "passage") -> DataFrame:
    """Edges of which a passage mentions both ends.

    Each edge meets the passages of the end that fewer mention first, so an end that very many passages mention
    costs no more than the other end does; no product of mentions.
    """
    m = mentions.select(passage, "entity").distinct()
    n = m.groupBy("entity").agg(F.count("*").alias("n"))
    counted = edges
    for end in ("head", "tail"):
        counted = counted.join(n.select(F.col("entity").alias(end), F.col("n").alias(f"__{end}")), end)
    out = None
    for first, second, rarer in (("head", "tail", F.col("__head") <= F.col("__tail")), ("tail", "head", F.col("__head") > F.col("__tail"))):
        part = counted.where(rarer).join(m.withColumnRenamed("entity", first), first).join(m.withColumnRenamed("entity", second), [second, passage]).select(passage, *edges.columns)
        out = part if out is None else out.unionByName(part)
    return out


def emerging_to_old(edges: DataFrame, created: DataFrame, mentions: DataFrame, start: int, end: int, offset: int, passage: str = "passage") -> DataFrame:
    """Edges from a mentioned new end to an older end, lasting past the window, that are not mentioned at both ends.

    edges: head, relation, tail, to_ts (null while open) and more; created: entity and created, of which the earliest
    counts. Only edges with a new end and only mentions of their ends are looked at: both are filtered before they are
    dealt out. The two ends of an edge decide alone whether a passage mentions both; without a relation it counts as not.
    """
    first = created.groupBy("entity").agg(F.min("created").alias("created"))
    fresh = few(first.where(F.col("created") > start).select("entity"))
    older = first.where(F.col("created") < start).select(F.col("entity").alias("__old"))
    lasting = edges.where(F.col("to_ts").isNull() | (F.col("to_ts") > end + offset))
    near = None
    for new, old in (("head", "tail"), ("tail", "head")):
        part = lasting.join(fresh.withColumnRenamed("entity", new), new, "left_semi").withColumn("__new", F.col(new)).withColumn("__old", F.col(old))
        near = part if near is None else near.unionByName(part)
    near = cut(near.join(older, "__old", "left_semi").distinct())
    of = lambda c: mentions.join(few(near.select(F.col(c).alias("entity")).distinct()), "entity", "left_semi").select(passage, F.col("entity").alias(c))
    found = near.join(of("__new").distinct(), "__new")
    known = of("__old").toDF("__passage", "__known")
    both = (F.col("__old") == F.col("__known")) & (F.col(passage) == F.col("__passage")) & F.col("relation").isNotNull()
    return found.join(known, both, "left_anti").select(*edges.columns, passage)


def priority_union(sources: Sequence[tuple[str, DataFrame]], key: Sequence[str]) -> DataFrame:
    """Rows of several sources, the first source's row of each key, with its name as source."""
    out = None
    for k, (name, df) in enumerate(sources):
        part = df.withColumn("source", F.lit(name)).withColumn("__priority", F.lit(k))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in key]
    best = out.groupBy(*key).agg(F.min(F.struct("__priority", *[c for c in rest if c != "__priority"])).alias("best"))
    return best.select(*key, *[F.col("best")[c].alias(c) for c in rest if c != "__priority"])


def snapshot_mentions(iv: DataFrame, mentions: DataFrame, start: int, end: int, matched: DataFrame, passage: str = "passage") -> DataFrame:
    """Statements in force from before the window through its end, both ends mentioned, not matched yet, no loops."""
    lasting = iv.where((F.col("from_ts") < start) & (F.col("to_ts").isNull() | (F.col("to_ts") > end)) & (F.col("head") != F.col("tail")))
    return both_ends(lasting, mentions, passage).join(matched, [passage, "head", "relation", "tail"], "left_anti")


def removal_qualifiers(edges: DataFrame, qualifiers: DataFrame, start: int, key: Sequence[str]) -> DataFrame:
    """The last removal qualifier before the window of each edge, null without one."""
    last = qualifiers.where((F.col("q_action") == 0) & (F.col("q_ts") < start)).groupBy(*key).agg(F.max(F.struct("q_ts", "pid")).alias("q"))
    return edges.join(last, list(key), "left").select(*edges.columns, F.col("q.pid").alias("removal_pid"), F.col("q.q_ts").alias("removal_ts"))


def on_pair(edges: DataFrame, links: DataFrame, present: bool = True) -> DataFrame:
    """Edges whose (head, tail) is among the links, the relation left aside (J13, J14), or is not."""
    return edges.join(links.select("head", "tail").distinct(), ["head", "tail"], "left_semi" if present else "left_anti")


def splice(base: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Rows of base, replaced wholly by the correction of the same key (J20). corrections has base's columns, key unique."""
    rest = [c for c in base.columns if c != key]
    fixed = corrections.select(key, F.struct(*rest).alias("__fix"))
    return base.join(fixed, key, "left").select(key, *[F.when(F.col("__fix").isNotNull(), F.col("__fix")[c]).otherwise(F.col(c)).alias(c) for c in rest])


def splice_report(base: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Corrections that match no row, and those that match several."""
    used = corrections.select(key).join(base.groupBy(key).agg(F.count("*").alias("uses")), key, "left")
    return used.agg(F.count("*").alias("corrections"), F.count_if(F.col("uses").isNull()).alias("orphans"), F.count_if(F.col("uses") > 1).alias("multiply_used"), F.coalesce(F.sum("uses"), F.lit(0)).alias("replaced"))


def merge_predictions(base: DataFrame, new: DataFrame, key: str = "hash_id", column: str = "predictions") -> DataFrame:
    """Maps of model to prediction joined by key; what base has stays (J21). Running it twice changes nothing."""
    empty = F.map_from_arrays(F.array(), F.array()).cast(base.schema[column].dataType)
    other = new.select(key, F.col(column).alias("__new"))
    own, add = F.coalesce(column, empty), F.coalesce("__new", empty)
    rest = F.map_filter(add, lambda k, v: ~F.map_contains_key(own, k))
    return base.join(other, key, "left").withColumn(column, F.map_concat(own, rest)).drop("__new")


def surface_to_entities(triples: DataFrame, mentions: DataFrame, passage: str = "passage") -> DataFrame:
    """Label triples to all id triples that the passage's mentions allow."""
    norm = lambda c: F.lower(F.trim(c))
    m = mentions.select(passage, norm(F.col("mention_text")).alias("surface"), "entity").distinct()
    heads = m.select(passage, F.col("surface").alias("__h"), F.col("entity").alias("head"))
    tails = m.select(passage, F.col("surface").alias("__t"), F.col("entity").alias("tail"))
    t = triples.withColumn("__h", norm(F.col("head_label"))).withColumn("__t", norm(F.col("tail_label")))
    return t.join(heads, [passage, "__h"]).join(tails, [passage, "__t"]).drop("__h", "__t")


def not_done(work: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work whose key has no result yet."""
    return work.join(done.select(*key).distinct(), list(key), "left_anti")


def title_variants(queries: DataFrame, titles: DataFrame, column: str = "title") -> DataFrame:
    """The page of a title as written, else capitalised, else in lower case."""
    t = F.col(column)
    forms = F.array(F.struct(F.lit(0).alias("k"), t.alias("form")), F.struct(F.lit(1).alias("k"), F.concat(F.upper(F.substring(t, 1, 1)), F.expr(f"substring({column}, 2)")).alias("form")), F.struct(F.lit(2).alias("k"), F.lower(t).alias("form")))
    each = queries.select("*", F.explode(forms).alias("f")).select("*", "f.k", "f.form").drop("f")
    hit = each.join(titles.select(F.col("title").alias("form"), "page_id"), "form")
    best = hit.groupBy(column).agg(F.min(F.struct("k", "page_id")).alias("b"))
    return queries.join(best, column, "left").select(*queries.columns, F.col("b.page_id").alias("page_id"))


def revisions_at(revisions: DataFrame, instants: Sequence[int], key: str = "page") -> DataFrame:
    """The revision in force at each instant: its time <= instant < the next one's."""
    after = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "revision"))
    at = F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in instants]))
    return revisions.withColumn("next_ts", after).select("*", at.alias("at")).where("ts <= at AND (next_ts IS NULL OR at < next_ts)")


def revision_for(revisions: DataFrame, targets: DataFrame, margin: int, key: str = "page") -> DataFrame:
    """The revision that stands for a time (J27): the one before it if it stayed longer than the margin, else the one after; past the end, the last."""
    w = Window.partitionBy(key).orderBy("ts", "revision")
    r = revisions.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_revision", F.lead("revision").over(w)).select(key, "ts", "revision", "next_ts", "next_revision")
    found = as_of(targets, r, [key], ["revision", "next_ts", "next_revision"], strict=False)
    chosen = F.when(F.col("next_ts").isNull() | (F.col("next_ts") - F.col("match_ts") > margin), F.col("revision")).otherwise(F.col("next_revision"))
    return found.select(*targets.columns, chosen.alias("revision"))
