"""Queries of the temporal core and the joins on it (T, J and W of the blueprint)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.io import table
from tidegraph.operators import curation, joins, sampling
from tidegraph.operators import temporal as tp
from tidegraph.plans import REGISTRY
from tidegraph.plans.inputs import DAY, EDGES, HISTORY, IV, LOG, RUNS, SECONDS, T0, T8, T15, T22, active, edges, log, seconds, validity

query = REGISTRY.query


@query(f"WITH {LOG}, {RUNS} SELECT head, relation, ts, seq, action FROM runs")
def collapse_runs(spark: SparkSession, sf: str) -> DataFrame:
    return tp.collapse_runs(log(spark, sf)).select("head", "relation", "ts", "seq", "action")


@query(f"{HISTORY} SELECT head, relation, from_ts, to_ts FROM iv")
def intervals_from_events(spark: SparkSession, sf: str) -> DataFrame:
    return validity(spark, sf)


@query(f"{HISTORY} SELECT relation, count(*) AS n_active FROM iv WHERE {active(T15)} GROUP BY relation")
def snapshot_asof(spark: SparkSession, sf: str) -> DataFrame:
    return tp.snapshot(validity(spark, sf), T15).groupBy("relation").agg(F.count("*").alias("n_active"))


@query(f"{HISTORY} SELECT v.t AS \"at\", relation, count(*) AS n_active FROM iv, (VALUES ({T8}), ({T15}), ({T22})) v(t) WHERE {active('v.t')} GROUP BY v.t, relation")
def multi_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return tp.snapshots(validity(spark, sf), [T8, T15, T22]).groupBy("at", "relation").agg(F.count("*").alias("n_active"))


FLAGS = "flags AS (SELECT head, relation, bool_or{a} AS x, bool_or{b} AS y, bool_or(from_ts > {t} AND from_ts < {t} + {o}) AS again FROM iv GROUP BY head, relation)"


def _flags(a: int, b: int, offset: int = 0) -> str:
    return f"{HISTORY}, " + FLAGS.format(a=active(a), b=active(b), t=b, o=offset)


@query(_flags(T8, T15) + " SELECT head, relation, CASE WHEN y THEN 1 ELSE 0 END AS action FROM flags WHERE x <> y")
def delta_window(spark: SparkSession, sf: str) -> DataFrame:
    return tp.delta(validity(spark, sf), T8, T15)


@query(_flags(T8, T15, 2 * DAY) + " SELECT head, relation, CASE WHEN y THEN 1 ELSE 0 END AS action FROM flags WHERE (y AND NOT x) OR (x AND NOT y AND NOT again)")
def delta_anti_readd(spark: SparkSession, sf: str) -> DataFrame:
    return tp.delta(validity(spark, sf), T8, T15, readd_offset=2 * DAY)


@query(
    f"{HISTORY}, w AS (SELECT k, {T0} AS a, {T0} + k * {7 * DAY} AS b FROM (VALUES (1), (2), (3), (4)) v(k)), f AS (SELECT head, relation, k, bool_or(from_ts < a AND (to_ts IS NULL OR to_ts > a)) AS x, "
    "bool_or(from_ts < b AND (to_ts IS NULL OR to_ts > b)) AS y FROM iv, w GROUP BY head, relation, k) SELECT k, CASE WHEN y THEN 1 ELSE 0 END AS action, count(*) AS n FROM f WHERE x <> y GROUP BY 1, 2"
)
def delta_cumulative_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return tp.delta_windows(validity(spark, sf), tp.windows(T0, 4)).groupBy("k", "action").agg(F.count("*").alias("n"))


@query(
    f"{HISTORY}, w AS (SELECT k, {T0} + (k - 1) * {7 * DAY} AS a, {T0} + k * {7 * DAY} AS b FROM (VALUES (1), (2), (3), (4)) v(k)), f AS (SELECT head, relation, k, bool_or(from_ts < a AND (to_ts IS NULL OR to_ts > a)) AS x, "
    "bool_or(from_ts < b AND (to_ts IS NULL OR to_ts > b)) AS y FROM iv, w GROUP BY head, relation, k) SELECT k, CASE WHEN y THEN 1 ELSE 0 END AS action, count(*) AS n FROM f WHERE x <> y GROUP BY 1, 2"
)
def delta_consecutive_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return tp.delta_windows(validity(spark, sf), tp.windows(T0, 4, cumulative=False)).groupBy("k", "action").agg(F.count("*").alias("n"))


@query(
    _flags(T8, T15)
    + f", q AS (SELECT user_id AS head, event_type AS relation, CASE WHEN value > 50 THEN 'P582' ELSE 'P580' END AS pid, {SECONDS.format('ts')} AS q_ts FROM events), "
    "d AS (SELECT head, relation, CASE WHEN x AND y THEN 2 WHEN y THEN 1 WHEN x THEN 0 END AS action FROM flags WHERE x OR y) "
    f"SELECT d.head, d.relation, d.action, q.pid, q.q_ts, CASE q.pid WHEN 'P582' THEN 0 WHEN 'P580' THEN 1 END AS q_action FROM d LEFT JOIN q ON d.head = q.head AND d.relation = q.relation AND q.q_ts > {T8} AND q.q_ts < {T15} WHERE d.action < 2 OR q.pid IS NOT NULL"
)
def delta_with_qualifiers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    q = e.select(F.col("user_id").alias("head"), F.col("event_type").alias("relation"), F.when(F.col("value") > 50, "P582").otherwise("P580").alias("pid"), seconds("ts").alias("q_ts"))
    iv = validity(spark, sf)
    return tp.with_qualifiers(iv, tp.delta(iv, T8, T15), q.withColumn("q_action", tp.qualifier_polarity(F.col("pid"))), T8, T15)


STABLE = (
    "r1 AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY {k} ORDER BY ts, seq) AS b FROM {src}) WHERE b IS NULL OR b <> action), "
    "r2 AS (SELECT *, lead(ts) OVER (PARTITION BY {k} ORDER BY ts, seq) AS nx, lag(ts) OVER (PARTITION BY {k} ORDER BY ts, seq) AS pv FROM r1), "
    "r3 AS (SELECT * FROM r2 WHERE nx IS NULL OR (floor((nx - ts) / 3600.0) >= {h} AND NOT (action = 'D' AND pv IS NOT NULL AND pv = ts))), "
    "r4 AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY {k} ORDER BY ts, seq) AS b2 FROM r3) WHERE coalesce(b2, 'D') <> action), "
    "r5 AS (SELECT *, lag(ts) OVER (PARTITION BY {k} ORDER BY ts, seq) AS pv2 FROM r4)"
)
STABLE_KEEP = "FROM r5 WHERE NOT coalesce(action = 'D' AND nx IS NULL AND pv2 = ts, FALSE)"


@query(f"WITH {LOG}, " + STABLE.format(k="head, relation", src="log", h=48) + f" SELECT head, relation, ts, action {STABLE_KEEP}")
def stability_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tp.stable(log(spark, sf), 48).select("head", "relation", "ts", "action")


MERGED = (
    f"WITH {LOG}, clean AS (SELECT head % 10 AS target, relation, head, ts, seq, action FROM (SELECT *, lag(action) OVER (PARTITION BY head, relation ORDER BY ts, seq) AS before FROM log) WHERE coalesce(before, 'D') <> action), "
    "live AS (SELECT *, sum(CASE WHEN action = 'A' THEN 1 ELSE -1 END) OVER (PARTITION BY target, relation ORDER BY ts, action, seq ROWS UNBOUNDED PRECEDING) AS n FROM clean), "
    "merged AS (SELECT target, relation, ts, seq, action FROM live WHERE (n = 1 AND action = 'A') OR (n = 0 AND action = 'D'))"
)


def _by_target(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).withColumn("target", F.col("head") % 10)


@query(f"{MERGED} SELECT target, relation, ts, action FROM merged")
def merge_histories(spark: SparkSession, sf: str) -> DataFrame:
    return tp.merge_histories(_by_target(spark, sf), ["target", "relation"], "head").select("target", "relation", "ts", "action")


@query(MERGED + ", " + STABLE.format(k="target, relation", src="merged", h=2) + f" SELECT target, relation, ts, action {STABLE_KEEP}")
def merge_histories_stable(spark: SparkSession, sf: str) -> DataFrame:
    return tp.merge_histories(_by_target(spark, sf), ["target", "relation"], "head", hours=2).select("target", "relation", "ts", "action")


@query(
    f"WITH o AS (SELECT o_custkey AS page, {SECONDS.format('o_orderdate')} AS ts, l_returnflag || l_linestatus AS element FROM orders JOIN lineitem ON o_orderkey = l_orderkey), rev AS (SELECT DISTINCT page, ts FROM o), "
    "num AS (SELECT page, ts, row_number() OVER (PARTITION BY page ORDER BY ts) AS n FROM rev), el AS (SELECT DISTINCT o.page, num.n, o.ts, element FROM o JOIN num ON o.page = num.page AND o.ts = num.ts) "
    "SELECT a.page, a.ts, a.element, 'A' AS action FROM el a LEFT JOIN el b ON a.page = b.page AND a.element = b.element AND b.n = a.n - 1 WHERE b.page IS NULL "
    "UNION ALL SELECT a.page, num.ts, a.element, 'D' FROM el a JOIN num ON num.page = a.page AND num.n = a.n + 1 LEFT JOIN el b ON a.page = b.page AND a.element = b.element AND b.n = a.n + 1 WHERE b.page IS NULL"
)
def revision_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rev = o.groupBy(F.col("o_custkey").alias("page"), seconds("o_orderdate").alias("ts")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("elements"))
    return tp.revision_diff(rev)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_qualifier_wins(spark: SparkSession, sf: str) -> DataFrame:
    return tp.last_value_wins(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query(f"WITH {LOG} SELECT head, min(ts) AS first_ts FROM log GROUP BY head")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return tp.first_seen(log(spark, sf), ["head"])


@query(
    "WITH d AS (SELECT event_id, 2020 + event_id % 5 AS y, event_id % 13 AS m, 1 + event_id % 31 AS dd FROM events), "
    "v AS (SELECT *, CASE WHEN m BETWEEN 1 AND 12 THEN make_date(CAST(y AS INT), CAST(greatest(m, 1) AS INT), 1) END AS f FROM d) "
    "SELECT event_id, CASE WHEN f IS NOT NULL THEN CAST(floor(epoch(make_timestamp(y, greatest(m, 1), least(dd, day(last_day(f))), 0, 0, 0.0))) AS BIGINT) END AS q_ts FROM v"
)
def qualifier_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id").cast("int")
    return table(spark, sf, "events").select("event_id", tp.qualifier_timestamp(2020 + e % 5, e % 13, 1 + e % 31).alias("q_ts"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS polarity FROM events")
def qualifier_polarity(spark: SparkSession, sf: str) -> DataFrame:
    pid = F.element_at(F.array(F.lit("P570"), F.lit("P569"), F.lit("P31"), F.lit("P1")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", tp.qualifier_polarity(pid).alias("polarity"))


CREATED = "c AS (SELECT e, min(ts) AS created FROM (SELECT head AS e, ts FROM edges UNION ALL SELECT tail, ts FROM edges) GROUP BY e)"
CREATED_FROM = 810000000


@query(f"WITH {EDGES}, {CREATED} SELECT edges.head, edges.tail, edges.order_id, h.created AS head_created, t.created AS tail_created FROM edges LEFT JOIN c h ON h.e = edges.head LEFT JOIN c t ON t.e = edges.tail")
def creation_attach(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return joins.attach_creation(e, _created(e)).select("head", "tail", "order_id", "head_created", "tail_created")


def _created(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("head", "tail")).alias("entity"), F.col("ts").alias("created"))


@query(f"WITH {EDGES}, {CREATED}, x AS (SELECT edges.*, h.created >= {CREATED_FROM} AS emerging_head, t.created >= {CREATED_FROM} AS emerging_tail FROM edges JOIN c h ON h.e = edges.head JOIN c t ON t.e = edges.tail) SELECT emerging_head, emerging_tail, count(*) AS n FROM x WHERE emerging_head OR emerging_tail GROUP BY 1, 2")
def emerging_entities(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return tp.emerging(joins.attach_creation(e, _created(e)), CREATED_FROM).groupBy("emerging_head", "emerging_tail").agg(F.count("*").alias("n"))


ENDS = "(SELECT head AS entity FROM {0} UNION ALL SELECT tail FROM {0})"
VOLATILE = (
    f"WITH {EDGES}, ch AS (SELECT * FROM edges WHERE relation = 'R'), a AS (SELECT entity, count(*) AS changes FROM {ENDS.format('ch')} GROUP BY 1), p AS (SELECT entity, count(*) AS n FROM {ENDS.format('edges')} GROUP BY 1), "
    "v AS (SELECT a.entity, changes, changes * (changes / CAST(coalesce(n, 1) AS DOUBLE)) AS normalized FROM a LEFT JOIN p ON a.entity = p.entity)"
)


@query(f"{VOLATILE} SELECT entity, changes, round(normalized, 6) AS normalized FROM v")
def volatility(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return tp.volatility(e.where("relation = 'R'"), e).withColumn("normalized", F.round("normalized", 6))


@query(f"{VOLATILE}, b AS (SELECT * FROM v WHERE normalized >= 2.0 ORDER BY normalized DESC, entity LIMIT 50) SELECT b.entity, count(*) AS n_edges, round(max(normalized), 6) AS normalized FROM b JOIN (SELECT head AS entity FROM ch UNION ALL SELECT tail FROM ch) e ON e.entity = b.entity GROUP BY 1")
def volatile_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    changes = e.where("relation = 'R'")
    return tp.volatile_edges(changes, tp.volatility(changes, e), 2.0, 50).groupBy("entity").agg(F.count("*").alias("n_edges"), F.round(F.max("normalized"), 6).alias("normalized"))


@query("SELECT o_custkey AS page, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '##' ORDER BY CAST(l_partkey AS VARCHAR)) AS targets FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_partkey) > 60")
def many_targets_having(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return tp.pages_of_many(o.select(F.col("o_custkey").alias("page"), F.col("l_partkey").alias("target")), 60)


@query()
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all part and supplier pairs; a recursive SQL form does not end on whole tables, so tests compare with a plain walk."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("head"), (F.col("l_suppkey") + 1000000).alias("tail")).distinct()
    return tp.components(e)


@query(f"{HISTORY} SELECT relation, count(*) AS n FROM (SELECT DISTINCT head, relation FROM iv WHERE {active(T22)}) GROUP BY relation")
def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tp.snapshot(validity(spark, sf), T22).select("head", "relation").distinct().groupBy("relation").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, CAST(round(({SECONDS.format('ts')} - {T0}) / {DAY} / 7.0) AS BIGINT) AS week FROM events".replace(f"/ {DAY}", f"// {DAY}"))
def delta_week_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", tp.week_number(F.floor((seconds("ts") - T0) / DAY)).alias("week"))


@query(f"{HISTORY} SELECT head, relation, from_ts, CAST(ceil(to_ts / {DAY}.0) - ceil(from_ts / {DAY}.0) AS BIGINT) AS days FROM iv")
def interval_days(spark: SparkSession, sf: str) -> DataFrame:
    return validity(spark, sf).select("head", "relation", "from_ts", tp.interval_days(F.col("from_ts"), F.col("to_ts")).alias("days"))


@query(f"WITH w AS (SELECT k, {T0} + (k - 1) * {7 * DAY} AS from_ts, {T0} + k * {7 * DAY} AS to_ts FROM (VALUES (1), (2), (3), (4)) v(k)) SELECT event_id, k FROM events JOIN w ON {SECONDS.format('ts')} BETWEEN from_ts AND to_ts")
def interval_ids(spark: SparkSession, sf: str) -> DataFrame:
    spans = spark.createDataFrame(tp.windows(T0, 4, cumulative=False), "k int, from_ts bigint, to_ts bigint")
    return tp.window_ids(table(spark, sf, "events").select("event_id", seconds("ts").alias("ts")), spans).select("event_id", "k")


@query(f"WITH {LOG}, l AS (SELECT head, ts, seq FROM log WHERE relation = 'click'), r AS (SELECT head, ts, max(seq) AS seq FROM log WHERE relation = 'view' GROUP BY 1, 2) SELECT l.head, l.ts, l.seq, (SELECT max(r.ts) FROM r WHERE r.head = l.head AND r.ts < l.ts) AS match_ts, (SELECT arg_max(r.seq, r.ts) FROM r WHERE r.head = l.head AND r.ts < l.ts) AS view_seq FROM l")
def asof_lookup(spark: SparkSession, sf: str) -> DataFrame:
    e = log(spark, sf)
    right = e.where("relation = 'view'").select("head", "ts", F.col("seq").alias("view_seq"))
    return joins.as_of(e.where("relation = 'click'").select("head", "ts", "seq"), right, ["head"], ["view_seq"])


@query(f"WITH {LOG} SELECT l.head, l.ts, l.seq, min(r.ts) AS match_ts, arg_min(r.seq, r.ts) AS next_seq FROM log l LEFT JOIN log r ON r.relation = 'purchase' AND r.head = l.head AND r.ts > l.ts WHERE l.relation = 'click' GROUP BY l.head, l.ts, l.seq")
def next_event_after(spark: SparkSession, sf: str) -> DataFrame:
    e = log(spark, sf)
    right = e.where("relation = 'purchase'").select("head", "ts", F.col("seq").alias("next_seq"))
    return joins.as_of(e.where("relation = 'click'").select("head", "ts", "seq"), right, ["head"], ["next_seq"], forward=True)


LINES = "lines AS (SELECT DISTINCT user_id AS file, event_id AS line FROM events WHERE event_type = 'error')"
CLUSTERS = f"WITH {LINES}, n AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) <= 400 THEN 0 ELSE 1 END AS fresh FROM lines), c AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS cluster FROM n), g AS (SELECT file, cluster, min(line) AS first, max(line) AS last, count(*) AS n FROM c GROUP BY 1, 2)"


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"))
    return curation.gap_clusters(lines, 400, 20, ["file"])


@query(f"{CLUSTERS} SELECT file, cluster, first, last, greatest(first - 20, 0) AS padded_first, last + 20 AS padded_last, n FROM g")
def gap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).drop("span", "density")


@query(f"{CLUSTERS} SELECT file, cluster, last - first + 1 AS span, round(n / CAST(last - first + 1 AS DOUBLE), 6) AS density FROM g")
def cluster_density(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).select("file", "cluster", "span", F.round("density", 6).alias("density"))


@query(f"{CLUSTERS}, k AS (SELECT unnest(generate_series(1, 150)) AS k), p AS (SELECT file, cluster, -k AS o, first - k AS line FROM g, k UNION ALL SELECT file, cluster, k, last + k FROM g, k) SELECT p.file, p.cluster, p.o AS \"offset\", p.line, e.event_type FROM p JOIN events e ON e.user_id = p.file AND e.event_id = p.line")
def cluster_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), "event_type")
    return curation.neighbours(_clusters(spark, sf), lines, 150, ["file"]).select("file", "cluster", "offset", "line", "event_type")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


REDIRECTS = "rd AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 1)"


@query(f"WITH RECURSIVE {REDIRECTS}, walk(source, target) AS (SELECT source, target FROM rd UNION ALL SELECT walk.source, rd.target FROM walk JOIN rd ON rd.source = walk.target), done AS (SELECT source, min(target) AS target FROM walk GROUP BY source) SELECT coalesce(d.target, l_partkey) AS entity, min({SECONDS.format('l_shipdate')}) AS created FROM lineitem LEFT JOIN done d ON d.source = l_partkey GROUP BY 1")
def min_with_redirect_closure(spark: SparkSession, sf: str) -> DataFrame:
    rd = table(spark, sf, "part").where("p_partkey % 3 <> 0 AND p_partkey > 1").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 2).cast("bigint").alias("target"))
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), seconds("l_shipdate").alias("created"))
    return joins.resolve(li.groupBy("entity").agg(F.min("created").alias("created")), joins.closure(rd), ["entity"]).groupBy("entity").agg(F.min("created").alias("created"))


@query("SELECT s_suppkey AS id, n_name AS nation, CASE WHEN n_regionkey < 3 THEN n_name ELSE CAST(s_nationkey AS VARCHAR) END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def label_decorate(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    known = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    out = joins.decorate(s, known, "s_nationkey", "label")
    return joins.decorate(out, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), "s_nationkey", "nation").select("id", "nation", "label")


@query(f"WITH {EDGES}, lk AS (SELECT DISTINCT head, tail FROM edges WHERE relation = 'A') SELECT count(*) AS n FROM edges WHERE relation = 'R' AND EXISTS (SELECT 1 FROM lk WHERE lk.head = edges.head AND lk.tail = edges.tail)")
def pair_intersection_added(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return joins.on_pair(e.where("relation = 'R'"), e.where("relation = 'A'")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT relation, count(*) AS n FROM edges WHERE relation <> 'A' AND EXISTS (SELECT 1 FROM edges l WHERE l.relation = 'A' AND l.head = edges.head AND l.tail = edges.tail) GROUP BY 1")
def pair_intersection_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose pair is also linked otherwise, the relation left aside."""
    e = edges(spark, sf)
    return joins.on_pair(e.where("relation <> 'A'"), e.where("relation = 'A'")).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, lk AS (SELECT DISTINCT head, tail FROM edges WHERE relation = 'A') SELECT count(*) AS n FROM edges WHERE relation = 'R' AND NOT EXISTS (SELECT 1 FROM lk WHERE lk.head = edges.head AND lk.tail = edges.tail)")
def pair_intersection_removed(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return joins.on_pair(e.where("relation = 'R'"), e.where("relation = 'A'"), present=False).agg(F.count("*").alias("n"))


MENTIONS = "m AS (SELECT DISTINCT o_custkey AS passage, entity FROM orders JOIN (SELECT order_id, head AS entity FROM edges UNION ALL SELECT order_id, tail FROM edges) x ON x.order_id = o_orderkey)"
STATEMENTS = "st AS (SELECT head, relation, tail, min(ts) AS from_ts, CASE WHEN max(ts) % 2 = 0 THEN max(ts) END AS to_ts FROM edges GROUP BY 1, 2, 3)"


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("passage"))
    return o.join(edges(spark, sf), "order_id").select("passage", F.explode(F.array("head", "tail")).alias("entity")).distinct()


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).groupBy("head", "relation", "tail").agg(F.min("ts").alias("from_ts"), F.when(F.max("ts") % 2 == 0, F.max("ts")).alias("to_ts"))


BOTH = "both_ AS (SELECT st.*, a.passage FROM st JOIN m a ON a.entity = st.head JOIN m b ON b.entity = st.tail AND b.passage = a.passage)"


@query(f"WITH {EDGES}, {MENTIONS}, {STATEMENTS}, {BOTH} SELECT passage, count(*) AS n FROM both_ GROUP BY passage")
def both_ends_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    return joins.both_ends(_statements(spark, sf), _mentions(spark, sf)).groupBy("passage").agg(F.count("*").alias("n"))


MID = 900000000


@query(
    f"WITH {EDGES}, {MENTIONS}, {STATEMENTS}, {BOTH}, {CREATED}, s2 AS (SELECT st.*, h.created AS hc, t.created AS tc FROM st JOIN c h ON h.e = st.head JOIN c t ON t.e = st.tail WHERE to_ts IS NULL OR to_ts > {MID} + 100), "
    f"x AS (SELECT DISTINCT m.passage, head, relation, tail FROM s2 JOIN m ON m.entity = s2.head WHERE hc > {CREATED_FROM} AND tc < {CREATED_FROM} UNION SELECT m.passage, head, relation, tail FROM s2 JOIN m ON m.entity = s2.tail WHERE tc > {CREATED_FROM} AND hc < {CREATED_FROM}) "
    "SELECT passage, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.passage = x.passage AND b.head = x.head AND b.relation = x.relation AND b.tail = x.tail) GROUP BY passage"
)
def emerging_end_to_old(spark: SparkSession, sf: str) -> DataFrame:
    st, e = _statements(spark, sf), edges(spark, sf)
    found = joins.emerging_to_old(st, _created(e), _mentions(spark, sf), CREATED_FROM, MID, 100)
    return found.groupBy("passage").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, {MENTIONS}, {STATEMENTS}, {BOTH} SELECT passage, count(*) AS n FROM both_ WHERE from_ts < {MID} AND (to_ts IS NULL OR to_ts > {MID} + 1000) AND head <> tail AND relation <> 'R' GROUP BY passage")
def snapshot_mentions(spark: SparkSession, sf: str) -> DataFrame:
    st, m = _statements(spark, sf), _mentions(spark, sf)
    matched = joins.both_ends(st.where("relation = 'R'"), m).select("passage", "head", "relation", "tail")
    return joins.snapshot_mentions(st, m, MID, MID + 1000, matched).groupBy("passage").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES}, s AS (SELECT head, tail, 0 AS p, 'intersection' AS source FROM edges WHERE relation = 'A' UNION ALL SELECT head, tail, 1, 'emerging' FROM edges WHERE relation = 'N' UNION ALL SELECT head, tail, 2, 'all' FROM edges), f AS (SELECT head, tail, arg_min(source, p) AS source FROM s GROUP BY head, tail) SELECT source, count(*) AS n FROM f GROUP BY source")
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).select("head", "tail", "relation")
    parts = [("intersection", e.where("relation = 'A'")), ("emerging", e.where("relation = 'N'")), ("all", e)]
    return joins.priority_union([(n, d.select("head", "tail")) for n, d in parts], ["head", "tail"]).groupBy("source").agg(F.count("*").alias("n"))


QUAL = f"q AS (SELECT user_id AS head, event_type AS relation, CASE WHEN value > 50 THEN 'P582' ELSE 'P580' END AS pid, {SECONDS.format('ts')} AS q_ts FROM events)"


@query(f"{HISTORY}, {QUAL}, lastq AS (SELECT head, relation, max(q_ts) AS q_ts FROM q WHERE pid = 'P582' AND q_ts < {T15} GROUP BY 1, 2) SELECT iv.head, iv.relation, iv.from_ts, lastq.q_ts AS removal_ts FROM iv LEFT JOIN lastq ON iv.head = lastq.head AND iv.relation = lastq.relation")
def qualifier_removal_attach(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    pid = F.when(F.col("value") > 50, "P582").otherwise("P580")
    q = e.select(F.col("user_id").alias("head"), F.col("event_type").alias("relation"), pid.alias("pid"), seconds("ts").alias("q_ts"), tp.qualifier_polarity(pid).alias("q_action"))
    return joins.removal_qualifiers(validity(spark, sf), q, T15, ["head", "relation"]).select("head", "relation", "from_ts", "removal_ts")


FIX = "fix AS (SELECT o_orderkey AS k, 'X' AS s, o_totalprice * 2 AS p FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT -o_orderkey - 1, 'X', 0.0 FROM orders WHERE o_orderkey % 1000 = 0)"


def _fixes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    real = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return real.unionByName(o.where("o_orderkey % 1000 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")))


@query(f"WITH {FIX} SELECT o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, round(coalesce(p, o_totalprice), 4) AS o_totalprice FROM orders LEFT JOIN fix ON k = o_orderkey")
def splice_by_key(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return joins.splice(base, _fixes(spark, sf), "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(f"WITH {FIX}, u AS (SELECT k, (SELECT count(*) FROM orders WHERE o_orderkey = k) AS uses FROM fix) SELECT count(*) AS corrections, count(*) FILTER (uses = 0) AS orphans, count(*) FILTER (uses > 1) AS multiply_used, CAST(sum(uses) AS BIGINT) AS replaced FROM u")
def orphan_report(spark: SparkSession, sf: str) -> DataFrame:
    return joins.splice_report(table(spark, sf, "orders"), _fixes(spark, sf), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def done_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT count(DISTINCT l_orderkey) AS instances, count(DISTINCT l_returnflag) AS relations, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem UNION SELECT 1000000000 + l_partkey FROM lineitem)) AS entities, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_partkey FROM lineitem)) AS triples FROM lineitem")
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    from tidegraph.sources.foreign import dataset_profile as profile

    e = edges(spark, sf)
    return profile(e.withColumnRenamed("order_id", "instance"))


@query("SELECT year(o_orderdate) AS year, count(DISTINCT o_orderkey) AS instances, count(DISTINCT l_orderkey * 100000000 + l_partkey * 10 + ascii(l_returnflag) % 10) AS operations FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def distinct_operations_per_year(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.ascii("l_returnflag") % 10
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.countDistinct("o_orderkey").alias("instances"), F.countDistinct(key).alias("operations"))


@query("SELECT c_nationkey, c_custkey, \"rank\" FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS \"rank\" FROM customer) WHERE \"rank\" <= 3")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_per_group(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank")


@query("SELECT c_mktsegment, c_custkey, turn FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS turn FROM customer) WHERE turn <= 5")
def roundrobin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf, "customer"), "c_mktsegment", ["c_custkey"], 5).select("c_mktsegment", "c_custkey", "turn")


@query("SELECT c_custkey, n, batch FROM (SELECT c_custkey, n, CAST(floor((n - 1) / 32.0) AS BIGINT) AS batch FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer))")
def numbered_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.numbered(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], 32).select("c_custkey", "n", "batch")


@query("SELECT c_custkey FROM customer ORDER BY md5(concat_ws('|', '7', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 40")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.choose(table(spark, sf, "customer"), "random", 40, "c_acctbal", "c_custkey", seed=7).select("c_custkey")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.choose(table(spark, sf, "customer"), "top", 25, "c_acctbal", "c_custkey").select("c_custkey")


@query("WITH k AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2) SELECT o_custkey, kinds FROM k ORDER BY md5(concat_ws('|', '3', CAST(o_custkey AS VARCHAR))), o_custkey LIMIT 30")
def multi_type_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.of_many_types(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 2, 30, seed=3)


@query(f"WITH r AS (SELECT o_custkey AS page, o_orderkey AS revision, {SECONDS.format('o_orderdate')} AS ts, lead({SECONDS.format('o_orderdate')}) OVER (PARTITION BY o_custkey ORDER BY {SECONDS.format('o_orderdate')}, o_orderkey) AS nx FROM orders) SELECT page, revision, v.t AS \"at\" FROM r, (VALUES (850000000), (900000000), (950000000)) v(t) WHERE ts <= v.t AND (nx IS NULL OR v.t < nx)")
def revision_at_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("revision"), seconds("o_orderdate").alias("ts"))
    return joins.revisions_at(r, [850000000, 900000000, 950000000]).select("page", "revision", "at")


@query(
    f"WITH r AS (SELECT o_custkey AS page, o_orderkey AS revision, {SECONDS.format('o_orderdate')} AS ts, lead(o_orderkey) OVER w AS nr, lead({SECONDS.format('o_orderdate')}) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY {SECONDS.format('o_orderdate')}, o_orderkey)), "
    "t AS (SELECT c_custkey AS page, 900000000 AS ts FROM customer), b AS (SELECT t.page, t.ts, max(r.ts) AS m FROM t LEFT JOIN r ON r.page = t.page AND r.ts <= t.ts GROUP BY 1, 2), "
    f"f AS (SELECT b.page, b.ts, r.revision, r.nr, r.nx, r.ts AS rts, row_number() OVER (PARTITION BY b.page ORDER BY r.revision DESC) AS n FROM b LEFT JOIN r ON r.page = b.page AND r.ts = b.m) SELECT page, ts, CASE WHEN nx IS NULL OR nx - rts > {30 * DAY} THEN revision ELSE nr END AS revision FROM f WHERE n = 1"
)
def revision_for_time(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("revision"), seconds("o_orderdate").alias("ts"))
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("page"), F.lit(900000000).cast("bigint").alias("ts"))
    return joins.revision_for(r, targets, 30 * DAY)


@query(f"WITH RECURSIVE mv AS (SELECT 'T' || (event_id % 400) AS title, 'T' || ((event_id * 7 + 1) % 400) AS new_title, min({SECONDS.format('ts')}) AS ts FROM events GROUP BY 1, 2), one AS (SELECT title, ts, min(new_title) AS new_title FROM mv GROUP BY 1, 2), s AS (SELECT DISTINCT title, {T0} AS ts FROM one), walk(title, ts, final, since, hop) AS (SELECT title, ts, title, ts, 0 FROM s UNION ALL SELECT w.title, w.ts, o.new_title, o.ts, hop + 1 FROM walk w JOIN one o ON o.title = w.final AND o.ts = (SELECT min(x.ts) FROM one x WHERE x.title = w.final AND x.ts > w.since) WHERE hop < 1000) SELECT title, ts, arg_max(final, hop) AS final FROM walk GROUP BY 1, 2")
def move_chain(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = lambda c: F.concat(F.lit("T"), c.cast("string"))
    mv = e.groupBy(name(F.col("event_id") % 400).alias("title"), name((F.col("event_id") * 7 + 1) % 400).alias("new_title")).agg(F.min(seconds("ts")).alias("ts"))
    return joins.follow_moves(mv.select("title", F.lit(T0).cast("bigint").alias("ts")).distinct(), mv)


@query("WITH q AS (SELECT DISTINCT n_name AS title FROM nation UNION SELECT lower(r_name) FROM region), t AS (SELECT n_name AS title, n_nationkey AS page_id FROM nation UNION ALL SELECT lower(n_name), 1000 + n_nationkey FROM nation UNION ALL SELECT r_name, 2000 + r_regionkey FROM region), h AS (SELECT q.title, k, page_id FROM q, LATERAL (SELECT 0 AS k, q.title AS form UNION ALL SELECT 1, upper(q.title[1]) || q.title[2:] UNION ALL SELECT 2, lower(q.title)) f JOIN t ON t.title = f.form) SELECT q.title, (SELECT arg_min(page_id, k * 100000 + page_id) FROM h WHERE h.title = q.title) AS page_id FROM q")
def title_variants(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    q = n.select(F.col("n_name").alias("title")).unionByName(r.select(F.lower("r_name").alias("title"))).distinct()
    t = n.select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("page_id")).unionByName(n.select(F.lower("n_name").alias("title"), (F.col("n_nationkey") + 1000).alias("page_id")))
    return joins.title_variants(q, t.unionByName(r.select(F.col("r_name").alias("title"), (F.col("r_regionkey") + 2000).alias("page_id"))))


@query("SELECT p_partkey AS page, p_brand AS qid FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A') AND p_size > 10")
def both_sides_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Page ids with an entity id, if both sides were parsed."""
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").where("p_size > 10").join(seen, "p_partkey", "left_semi").select(F.col("p_partkey").alias("page"), F.col("p_brand").alias("qid"))


@query(f"WITH {EDGES}, a AS (SELECT DISTINCT head, tail FROM edges WHERE relation = 'A'), r AS (SELECT DISTINCT head, tail FROM edges WHERE relation = 'R') SELECT 'added' AS kind, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM r) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM a)")
def anti_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Additions without a removal and the reverse."""
    e = edges(spark, sf)
    a, r = (e.where(F.col("relation") == x).select("head", "tail").distinct() for x in "AR")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(joins.on_pair(a, r, False), "added").unionByName(count(joins.on_pair(r, a, False), "removed"))


@query("WITH t AS (SELECT o_orderkey AS passage, lower(trim(c_mktsegment)) AS h, lower(trim(o_orderpriority)) AS t FROM orders JOIN customer ON c_custkey = o_custkey), m AS (SELECT DISTINCT o_orderkey AS passage, lower(trim(c_mktsegment)) AS surface, 'Q' || c_nationkey AS entity FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT o_orderkey, lower(trim(o_orderpriority)), 'Q9' || o_orderstatus FROM orders) SELECT t.passage, a.entity AS head, b.entity AS tail FROM t JOIN m a ON a.passage = t.passage AND a.surface = t.h JOIN m b ON b.passage = t.passage AND b.surface = t.t")
def surface_to_entities(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumnRenamed("o_orderkey", "passage")
    m = o.select("passage", F.col("c_mktsegment").alias("mention_text"), F.concat(F.lit("Q"), "c_nationkey").alias("entity")).unionByName(o.select("passage", F.col("o_orderpriority").alias("mention_text"), F.concat(F.lit("Q9"), "o_orderstatus").alias("entity")))
    return joins.surface_to_entities(o.select("passage", F.col("c_mktsegment").alias("head_label"), F.col("o_orderpriority").alias("tail_label")), m).select("passage", "head", "tail")
