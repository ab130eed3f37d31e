"""Edit histories of statements: events to intervals, intervals to snapshots and deltas.

A history table has key columns (by default head and relation), ts (epoch
seconds), seq (order among equal ts) and action, A for added or D for deleted. Everything that works on one
statement's events is a window over the same partitioning, so a chain of these operators shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("head", "relation")
HOUR = 3600
#: Qualifier properties that mark the end (0) or the start (1) of a statement.
QUALIFIER_POLARITY = {
    0: "P582 P1326 P576 P570 P730 P2032 P2669 P3999 P7125".split(),
    1: "P580 P585 P577 P6949 P575 P571 P2754 P620 P569 P729 P10135 P4602 P2031 P12413 P7589 P1191 P1619".split(),
}


def _over(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("ts", "seq")


def revision_diff(revisions: DataFrame, key: Sequence[str] = ("page",), element: str = "element", first_deletes: bool = False) -> DataFrame:
    """Events from revisions (key, ts, elements array): A when an element appears, D when it goes."""
    w = Window.partitionBy(*key).orderBy("ts")
    empty = F.array().cast(revisions.schema["elements"].dataType)
    before = F.coalesce(F.lag("elements").over(w), empty)
    changed = revisions.select(*key, "ts", F.array_except("elements", before).alias("added"), F.array_except(before, "elements").alias("gone"))
    each = F.concat(
        F.transform(F.array_distinct("added"), lambda x: F.struct(x.alias(element), F.lit("A").alias("action"))),
        F.transform(F.array_distinct("gone"), lambda x: F.struct(x.alias(element), F.lit("D").alias("action"))),
    )
    return changed.select(*key, "ts", F.explode(each).alias("e")).select(*key, "ts", "e.*")


def last_value_wins(df: DataFrame, key: Sequence[str], value: str, order: str = "ts") -> DataFrame:
    """The value of the latest row of each key."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def first_seen(df: DataFrame, key: Sequence[str], order: str = "ts") -> DataFrame:
    """Earliest time of each key (T4)."""
    return df.groupBy(*key).agg(F.min(order).alias("first_ts"))


def collapse_runs(history: DataFrame, key: Sequence[str] = KEY, start: str | None = "D") -> DataFrame:
    """The first event of each run of one action (T5). With start "D", deletions before the first addition go too."""
    before = F.lag("action").over(_over(key))
    keep = F.coalesce(before, F.lit(start)) != F.col("action") if start else before.isNull() | (before != F.col("action"))
    return history.withColumn("__keep", keep).where("__keep").drop("__keep")


def stable(history: DataFrame, hours: int, key: Sequence[str] = KEY) -> DataFrame:
    """Events that last: the next one comes at least that many whole hours later, or there is none.

    Kept events alternate and start with an addition. A deletion at the time of the addition before it goes, unless it is
    the last event; as the last event it goes if it falls on the time of the event kept before it. A
    history that is a single deletion gives nothing.
    """
    w = _over(key)
    runs = collapse_runs(history, key, start=None)
    after, before = F.lead("ts").over(w), F.lag("ts").over(w)
    lasting = F.floor((after - F.col("ts")) / HOUR) >= hours
    tie = (F.col("action") == "D") & (before == F.col("ts"))
    kept = runs.withColumn("__last", after.isNull()).withColumn("__keep", F.col("__last") | (lasting & ~F.coalesce(tie, F.lit(False)))).where("__keep")
    alternating = collapse_runs(kept.drop("__keep"), key)
    same_time = (F.col("action") == "D") & F.col("__last") & (F.lag("ts").over(w) == F.col("ts"))
    return alternating.withColumn("__gone", F.coalesce(same_time, F.lit(False))).where("NOT __gone").drop("__gone", "__last")


def merge_histories(history: DataFrame, target: Sequence[str], source: str, hours: int | None = None) -> DataFrame:
    """One history for each target from those of its sources: live while any source is.

    Events of all sources are counted up and down in time order (additions first among equal times); the
    target is added when the count leaves 0 and deleted when it returns there. Unlike a pairwise merge this
    does not depend on the order of the sources. With hours, the result is made stable.
    """
    clean = collapse_runs(history, [*target, source])
    w = Window.partitionBy(*target).orderBy("ts", "action", "seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("action") == "A", 1).otherwise(-1)
    counted = clean.withColumn("__step", step).withColumn("__live", F.sum("__step").over(w))
    edge = ((F.col("__live") == 1) & (F.col("action") == "A")) | ((F.col("__live") == 0) & (F.col("action") == "D"))
    merged = counted.where(edge).select(*target, "ts", "seq", "action")
    return merged if hours is None else stable(merged, hours, target)


def intervals(history: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Validity intervals (key, from_ts, to_ts); to_ts is null while open."""
    runs = collapse_runs(history, key)
    return runs.withColumn("to_ts", F.lead("ts").over(_over(key))).where("action = 'A'").select(*key, F.col("ts").alias("from_ts"), "to_ts")


def qualifier_timestamp(year: Column, month: Column, day: Column) -> Column:
    """Epoch seconds of a date whose day may not exist: it is lowered to the month's last (T11). Null if no such month."""
    first = F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    last = F.dayofmonth(F.last_day(first))
    return F.unix_timestamp(F.try_make_timestamp(year, month, F.least(day, last), F.lit(0), F.lit(0), F.lit(0)))


def qualifier_polarity(pid: Column) -> Column:
    """0: the property ends a statement, 1: it starts one, -1: neither."""
    out = F.lit(-1)
    for value, pids in QUALIFIER_POLARITY.items():
        out = F.when(pid.isin(pids), value).otherwise(out)
    return out


def active_at(at: Column) -> Column:
    """The interval holds the instant, both bounds strict."""
    return (F.col("from_ts") < at) & (F.col("to_ts").isNull() | (F.col("to_ts") > at))


def snapshot(iv: DataFrame, at: int) -> DataFrame:
    """Intervals that are active at an instant."""
    return iv.where(active_at(F.lit(at)))


def snapshots(iv: DataFrame, instants: Sequence[int]) -> DataFrame:
    """Intervals active at each of a few instants, with the column at (T14). One pass: no join."""
    each = F.explode(F.array(*[F.lit(int(t)).cast("bigint") for t in instants])).alias("at")
    return iv.select("*", each).where(active_at(F.col("at")))


def delta(iv: DataFrame, start: int, end: int, key: Sequence[str] = KEY, readd_offset: int = 0) -> DataFrame:
    """Statements added (1) or removed (0) between two instants, by statement.

    A statement in both or neither snapshot is in neither set. A removal goes if the statement is added
    again within readd_offset seconds after the end (J16). One aggregation gives all of it.
    """
    flags = iv.groupBy(*key).agg(
        F.max(active_at(F.lit(start))).alias("at_start"), F.max(active_at(F.lit(end))).alias("at_end"),
        F.coalesce(F.max((F.col("from_ts") > end) & (F.col("from_ts") < end + readd_offset)), F.lit(False)).alias("again"),
    )
    action = F.when(F.col("at_end") & ~F.col("at_start"), 1).when(F.col("at_start") & ~F.col("at_end") & ~F.col("again"), 0)
    return flags.select(*key, action.alias("action")).where("action IS NOT NULL")


def with_qualifiers(iv: DataFrame, changes: DataFrame, qualifiers: DataFrame, start: int, end: int, key: Sequence[str] = KEY) -> DataFrame:
    """The delta with qualifier events (key, pid, q_ts, q_action) strictly inside the window.

    Statements present at both ends are in it, as action 2, if such a qualifier exists.
    """
    inside = qualifiers.where((F.col("q_ts") > start) & (F.col("q_ts") < end))
    both = iv.groupBy(*key).agg((F.max(active_at(F.lit(start))) & F.max(active_at(F.lit(end)))).alias("both")).where("both").select(*key, F.lit(2).alias("action"))
    return changes.unionByName(both).join(inside, list(key), "left").where("action IN (0, 1) OR pid IS NOT NULL")


def windows(start: int, n: int, unit: str = "week", cumulative: bool = True) -> list[tuple[int, int, int]]:
    """(k, from, to) of n windows from a start (T17): growing from one start, or one after the other. unit: week, month or year."""
    from datetime import UTC, datetime

    t0 = datetime.fromtimestamp(start, UTC)

    def edge(k: int) -> int:
        if unit == "week":
            return start + k * 7 * 86400
        months = t0.month - 1 + k * (1 if unit == "month" else 12)
        year, month = t0.year + months // 12, months % 12 + 1
        for day in range(t0.day, 0, -1):
            try:
                return int(t0.replace(year=year, month=month, day=day).timestamp())
            except ValueError:
                continue
        raise AssertionError

    return [(k, start if cumulative else edge(k - 1), edge(k)) for k in range(1, n + 1)]


def delta_windows(iv: DataFrame, spans: Sequence[tuple[int, int, int]], key: Sequence[str] = KEY) -> DataFrame:
    """Deltas of several windows (k, from, to) in one aggregation."""
    span = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for k, a, b in spans]))
    flags = iv.select("*", span.alias("s")).groupBy(*key, F.col("s.k").alias("k")).agg(F.max(active_at(F.col("s.a"))).alias("x"), F.max(active_at(F.col("s.b"))).alias("y"))
    return flags.where("x <> y").select(*key, "k", F.when(F.col("y"), 1).otherwise(0).alias("action"))


def emerging(edges: DataFrame, start: int) -> DataFrame:
    """Edges with an end created at the start or later, with a flag for each end (T18, T19). Needs head_created, tail_created."""
    flagged = edges.withColumn("emerging_head", F.col("head_created") >= start).withColumn("emerging_tail", F.col("tail_created") >= start)
    return flagged.where("emerging_head OR emerging_tail")


def volatility(changes: DataFrame, population: DataFrame, head_only: bool = False) -> DataFrame:
    """Changes of each entity, and changes squared over its number of edges at the end, 1 if it has none."""

    def ends(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array("head") if head_only else F.array("head", "tail")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))

    out = ends(changes).withColumnRenamed("n", "changes").join(ends(population), "entity", "left")
    return out.select("entity", "changes", (F.col("changes") * (F.col("changes") / F.coalesce("n", F.lit(1)))).alias("normalized"))


def volatile_edges(changes: DataFrame, scores: DataFrame, least: float = 2.0, top: int = 1000) -> DataFrame:
    """Edges at the most volatile entities (T21): a top-k list, then a join with the edges."""
    best = scores.where(F.col("normalized") >= least).orderBy(F.desc("normalized"), "entity").limit(top)
    side = F.explode(F.array(F.struct(F.col("head").alias("entity")), F.struct(F.col("tail").alias("entity")))).alias("s")
    return changes.select("*", side).select("*", "s.entity").drop("s").join(F.broadcast(best), "entity")


def pages_of_many(links: DataFrame, least: int, page: str = "page", target: str = "target") -> DataFrame:
    """Pages that link to more than so many changed targets, which are listed in order."""
    return links.groupBy(page).agg(F.countDistinct(target).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(target).cast("string"))), "##").alias("targets")).where(F.col("n") > least)


def cut(df: DataFrame, checkpoint: bool = True) -> DataFrame:
    """The rows kept for further use: by checkpoint() where the session names a folder, else in the cache."""
    return df.checkpoint() if checkpoint and df.sparkSession.sparkContext.getCheckpointDir() is not None else df.cache()


#: Rows of a list that is broadcast to a large side; longer lists are joined.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """Kept, counted, and marked for broadcasting if the rows are few."""
    kept = cut(df)
    return F.broadcast(kept) if kept.limit(FEW + 1).count() <= FEW else kept


def components(edges: DataFrame, checkpoint: bool = True) -> DataFrame:
    """(node, component) of an undirected edge table (head, tail): iterated least labels with pointer jumping.

    A few shuffles a round, rounds by the logarithm of the longest chain. Lineage is cut by checkpoint() where the
    session names a folder.
    """
    both = cut(edges.where("head <> tail").select(F.col("head").alias("a"), F.col("tail").alias("b")).unionByName(edges.where("head <> tail").select(F.col("tail").alias("a"), F.col("head").alias("b"))).distinct(), checkpoint)
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), checkpoint)
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label").groupBy("node").agg(F.min("label").alias("near"))
        mine = labels.join(near.withColumnRenamed("node", "a"), "a").select("a", F.least("label", "near").alias("label"))
        parent = mine.select(F.col("a").alias("label"), F.col("label").alias("up"))
        after = cut(mine.join(parent, "label").select("a", F.least("label", "up").alias("label")), checkpoint)
        changed = after.join(labels.withColumnRenamed("label", "old"), "a").where("label <> old").limit(1).count()
        labels = after
        if not changed:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))


def week_number(days: Column) -> Column:
    """Number of the week that so many days make."""
    return F.round(days / 7).cast("bigint")


def interval_days(start: Column, end: Column) -> Column:
    """Days between two instants in seconds, both rounded up to whole days."""
    return (F.ceil(end / 86400) - F.ceil(start / 86400)).cast("bigint")


def window_ids(df: DataFrame, spans: DataFrame, ts: str = "ts") -> DataFrame:
    """Windows (k, from_ts, to_ts) that hold each row's time, both bounds included (T27). spans is a small generated table."""
    return df.join(F.broadcast(spans), F.col(ts).between(F.col("from_ts"), F.col("to_ts")))


def parsed_revisions(revisions: DataFrame, span: int, most: int, key: str = "page") -> DataFrame:
    """Revisions worth parsing (F24): (key, revision), from columns key, ts, revision, eligible.

    A revision is parsed when the next one comes later than span seconds, or when more than most + 1 were passed over
    since the last parsed one; the last revision of a page has no next one. A page's revisions go through one fold.
    """
    rows = F.array_sort(F.collect_list(F.struct("ts", "revision", "eligible")))
    kind = revisions.schema["revision"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.lit(0).alias("passed"), F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast(kind).alias("revision"), F.lit(False).alias("eligible"))

    def step(s: Column, r: Column) -> Column:
        parse = F.coalesce(s["eligible"] & ((r["ts"] - s["ts"] > span) | (s["passed"] > most + 1)), F.lit(False))
        return F.struct(
            F.when(parse, F.concat(s["kept"], F.array(s["revision"]))).otherwise(s["kept"]).alias("kept"), (F.when(parse, 0).otherwise(s["passed"]) + 1).alias("passed"),
            r["ts"].cast("bigint").alias("ts"), r["revision"].alias("revision"), r["eligible"].alias("eligible"),
        )

    return revisions.groupBy(key).agg(F.aggregate(rows, start, step, lambda s: s["kept"]).alias("kept")).select(key, F.explode("kept").alias("revision"))
