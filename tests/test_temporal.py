"""Hand-made cases and randomised checks of the temporal core."""

import random

from pyspark.sql import functions as F

from tidegraph.operators import joins
from tidegraph.operators import temporal as tp

H = 3600


def history(spark, *events):
    return spark.createDataFrame([("a", "r", t, k, x) for k, (t, x) in enumerate(events)], "head string, relation string, ts bigint, seq int, action string")


def kept(df):
    return [(r.ts // H, r.action) for r in df.orderBy("ts", "seq").collect()]


def test_stability_cases(spark):
    cases = [
        ([(0, "A"), (1, "D"), (2, "A"), (500, "D")], [(2, "A"), (500, "D")]),
        ([(0, "A"), (1, "D")], []),
        ([(0, "A"), (10, "A"), (300, "D")], [(0, "A"), (300, "D")]),
        ([(0, "D")], []),
        ([(5, "A")], [(5, "A")]),
    ]
    for events, expected in cases:
        assert kept(tp.stable(history(spark, *[(t * H, x) for t, x in events]), 168)) == expected


def fold(events, hours):
    """The rule as a loop over one statement's events."""
    runs = [e for k, e in enumerate(events) if k == 0 or e[1] != events[k - 1][1]]
    if len(runs) == 1:
        return runs if runs[0][1] == "A" else []
    out, last_add = [], None
    for k, (t, x) in enumerate(runs):
        final = k + 1 == len(runs)
        action = out[-1][1] if out else ""
        if final:
            ok = action != x and not (x == "D" and not out) and not (x == "D" and out[-1][0] == t)
        else:
            ok = (runs[k + 1][0] - t) // H >= hours and ((not out and x == "A") or (out and action != x)) and not (x == "D" and last_add == t)
        if ok:
            out.append((t, x))
        if x == "A":
            last_add = t
    return out


def test_stability_against_fold(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for h in range(150):
        t, events = 0, []
        for _ in range(rng.randint(1, 9)):
            t += rng.choice([0, H, 10 * H, 200 * H])
            events.append((t, rng.choice("AD")))
        rows += [(str(h), "r", t, k, x) for k, (t, x) in enumerate(events)]
        if found := fold(events, 48):
            expected[str(h)] = found
    df = spark.createDataFrame(rows, "head string, relation string, ts bigint, seq int, action string")
    got = {}
    for r in tp.stable(df, 48).orderBy("head", "ts", "seq").collect():
        got.setdefault(r["head"], []).append((r.ts, r.action))
    assert got == expected


def test_intervals_and_snapshots(spark):
    iv = tp.intervals(history(spark, (10, "A"), (20, "D"), (30, "A")))
    assert [(r.from_ts, r.to_ts) for r in iv.orderBy("from_ts").collect()] == [(10, 20), (30, None)]
    for at, n in ((10, 0), (11, 1), (20, 0), (25, 0), (31, 1), (10**9, 1)):
        assert tp.snapshot(iv, at).count() == n


def test_delta_makes_the_later_snapshot(spark):
    rng = random.Random(2)
    rows = [(str(h), "r", rng.randint(0, 100), k, rng.choice("AD")) for h in range(60) for k in range(6)]
    iv = tp.intervals(spark.createDataFrame(rows, "head string, relation string, ts bigint, seq int, action string"))
    at = lambda t: {r["head"] for r in tp.snapshot(iv, t).collect()}
    d = {r["head"]: r.action for r in tp.delta(iv, 30, 70).collect()}
    assert (at(30) | {h for h, a in d.items() if a == 1}) - {h for h, a in d.items() if a == 0} == at(70)


def test_windows():
    assert tp.windows(0, 2) == [(1, 0, 604800), (2, 0, 1209600)]
    assert tp.windows(0, 2, cumulative=False)[1] == (2, 604800, 1209600)
    jan31 = 1706659200
    assert tp.windows(jan31, 1, "month")[0][2] == 1709164800  # 29 February 2024


def test_closure_and_cycles(spark):
    rd = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "source bigint, target bigint")
    assert {(r.source, r.target) for r in joins.closure(rd).collect()} == {(1, 4), (2, 4), (3, 4), (7, 7), (8, 8)}


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20, 40)] + [(1, 2), (5, 5)], "head bigint, tail bigint")
    got = {r.node: r.component for r in tp.components(e).collect()}
    assert got == {**{k: 20 for k in range(20, 41)}, 1: 1, 2: 1}


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("k", 10), ("k", 5), ("z", 1)], "key string, ts bigint")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 9, "b"), ("k", 10, "c")], "key string, ts bigint, v string")
    got = {(r["key"], r.ts): r.v for r in joins.as_of(left, right, ["key"], ["v"]).collect()}
    assert got == {("k", 10): "b", ("k", 5): None, ("z", 1): None}
    loose = {(r["key"], r.ts): r.v for r in joins.as_of(left, right, ["key"], ["v"], strict=False).collect()}
    assert loose[("k", 10)] == "c" and loose[("k", 5)] == "a"
    after = {(r["key"], r.ts): r.v for r in joins.as_of(left, right, ["key"], ["v"], forward=True).collect()}
    assert after == {("k", 10): None, ("k", 5): "b", ("z", 1): None}


def test_splice(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    fix = spark.createDataFrame([(2, "b"), (9, "c"), (1, None)], "k int, v string")
    assert {(r.k, r.v) for r in joins.splice(base, fix, "k").collect()} == {(1, None), (2, "b")}
    r = joins.splice_report(base, fix, "k").first()
    assert (r.corrections, r.orphans, r.multiply_used, r.replaced) == (3, 1, 0, 2)


def test_merge_predictions_is_idempotent(spark):
    base = spark.createDataFrame([("h", {"m": "old"}), ("g", None)], "hash_id string, predictions map<string,string>")
    new = spark.createDataFrame([("h", {"m": "new", "n": "x"}), ("g", {"n": "y"})], "hash_id string, predictions map<string,string>")
    once = joins.merge_predictions(base, new)
    assert {r.hash_id: r.predictions for r in once.collect()} == {"h": {"m": "old", "n": "x"}, "g": {"n": "y"}}
    assert {r.hash_id: r.predictions for r in joins.merge_predictions(once, new).collect()} == {"h": {"m": "old", "n": "x"}, "g": {"n": "y"}}


def test_qualifier_dates(spark):
    df = spark.createDataFrame([(2023, 2, 31), (2024, 2, 30), (2024, 13, 1), (2024, 1, 5)], "y int, m int, d int")
    got = [r.t for r in df.select(F.date_format(F.timestamp_seconds(tp.qualifier_timestamp(F.col("y"), F.col("m"), F.col("d"))), "yyyy-MM-dd").alias("t")).collect()]
    assert got == ["2023-02-28", "2024-02-29", None, "2024-01-05"]


def test_parsed_revisions_against_loop(spark):
    rng, rows, expected = random.Random(7), [], set()
    for page in range(40):
        t, passed, before = 0, 0, None
        for k in range(rng.randint(1, 30)):
            t += rng.choice([10, 100, 5000])
            eligible = rng.random() < 0.8
            rows.append((page, t, k, eligible))
            if before and before[2] and (t - before[0] > 1800 or passed > 4):
                expected.add((page, before[1]))
                passed = 0
            passed += 1
            before = (t, k, eligible)
    df = spark.createDataFrame(rows, "page bigint, ts bigint, revision bigint, eligible boolean")
    assert {(r.page, r.revision) for r in tp.parsed_revisions(df, 1800, 3).collect()} == expected


def test_closure_of_long_chains_and_circles(spark):
    rd = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (201, 202), (202, 200), (199, 200)], "source bigint, target bigint")
    got = {r.source: r.target for r in joins.closure(rd).collect()}
    assert got == {**{k: 100 for k in range(100)}, 199: 199, 200: 200, 201: 201, 202: 202}


def test_components_of_all_pairs(spark):
    from tidegraph.plans import REGISTRY

    sf = "/root/testdata/sf0.001"
    near = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        a, b = r.l_partkey, r.l_suppkey + 1000000
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for start in sorted(near):
        stack = [start] if start not in least else []
        while stack:
            x = stack.pop()
            if x not in least:
                least[x] = start
                stack += near[x]
    assert {r.node: r.component for r in REGISTRY.queries["connected_components"](spark, sf).collect()} == least


def test_emerging_to_old_against_loops(spark):
    """Created rows as they come, filters of listed and of joined ends; equal times, unknown ends, repeated rows, no relation."""
    r = random.Random(8)
    names = [f"e{k}" for k in range(14)]
    created = [(n, t) for n in names[:-1] for t in ([r.choice([5, 10, 20])] + [30] * r.randint(0, 2))] + [("e0", None)]
    edges = [(r.choice(names), r.choice(["r", "s", None]), r.choice(names), r.choice([None, 40, 50, 60])) for _ in range(90)]
    edges += edges[:9]
    mentions = [(r.randint(0, 9), r.choice(names)) for _ in range(60)] + [(None, n) for n in names]
    least = {n: min(t for m, t in created if m == n and t is not None) for n in names[:-1]}
    said = set(mentions)
    want = set()
    for h, rel, t, to in edges:
        for new, old in ((h, t), (t, h)):
            if (to is None or to > 50) and least.get(new, 0) > 10 and 0 < least.get(old, 99) < 10:
                want |= {(h, rel, t, to, p) for p, e in said if e == new and (p is None or rel is None or (p, old) not in said)}
    for few in (tp.FEW, 0):
        was, tp.FEW = tp.FEW, few
        got = joins.emerging_to_old(spark.createDataFrame(edges, "head string, relation string, tail string, to_ts long"), spark.createDataFrame(created, "entity string, created long"), spark.createDataFrame(mentions, "passage int, entity string"), 10, 40, 10).collect()
        tp.FEW = was
        assert len(got) == len(set(got)) and set(map(tuple, got)) == want and want
