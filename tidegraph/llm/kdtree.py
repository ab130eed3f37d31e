"""K-d tree sharding: recursive weighted medians along the widest metadata dimension.

Rows of equal text form one point (their metadata are those of the least id), so copies stay together, always, unless a
point is heavier than a whole shard. Points heavier than HEAVY of a shard, a few hundred at most, are dealt out first, each
wholly to the lightest shard; only one that is heavier than a shard is cut, by its rows' hash, into pieces of at most half a shard.
What room is left in the shards is the goal of the tree: a node that must yield shards i to j is cut so that its left part
weighs as the room of the left half of them. The cut runs along the dimension whose values
spread widest in the node (standard deviation over the whole table's), at a distributed weighted median:
every node's weights are summed in equal slices of the value range, the slice that holds the cut is
sliced again, until the slice is light enough or a single value, and then again by the points' hash within that value.
Each round is one aggregation for all nodes of a level; the driver sees at most SLICES numbers a node.

Laws. `bytes`: weight is the size, sizes come out near equal. `rows`: weight 1.

Results. Null text: size is the overhead alone, and null texts are one point. Repeated rows all get their own slot.
Null metadata sort first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm.store import Scratch

SHARDS = 24
OVERHEAD = 8
SLICES = 256
#: A cut may miss its place by this share of a shard's target.
TOLERANCE = 0.002
SLOT_ROWS = 20_000
#: A point of more than this share of a shard's target is placed before the tree is built.
HEAVY = 0.05


def points(docs: DataFrame, *, key: str, text: str, dims: dict[str, Column], weight: str) -> DataFrame:
    """(id, size, crc, point, row, dims as doubles, w) for every row."""
    body = F.col(text)
    rows = docs.select(
        F.col(key).alias("id"), (F.coalesce(F.octet_length(body), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"), F.xxhash64(body.isNull(), body).alias("point"),
        *[c.cast("double").alias(n) for n, c in dims.items()],
    )
    rows = rows.withColumn("row", F.xxhash64("id", "point"))
    w = F.col("size") if weight == "bytes" else F.lit(1).cast("bigint")
    return rows.withColumn("w", w)


def grouped(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row for each point: its number of rows, its weight, and the metadata of its least id."""
    least = F.min(F.struct("id", *[F.coalesce(n, F.lit(-1.0)).alias(n) for n in names]))
    return rows.groupBy("point").agg(F.count("*").alias("n"), F.sum("w").alias("w"), least.alias("p")).select("point", "n", "w", *[F.col(f"p.{n}").alias(n) for n in names])


def _cut(rows: DataFrame, jobs: dict[int, dict], tolerance: float) -> dict[int, Column]:
    """For each node, a condition that holds for the rows left of its cut.

    jobs: node to {"dim", "low", "high", "goal"}: goal is the weight wanted on the left side.
    """
    # Points are ordered by the value (depth 0), then by their hash (depth 1).
    state = {n: {"depth": 0, "low": j["low"], "high": j["high"], "need": j["goal"], "fixed": [], "dim": j["dim"], "done": False} for n, j in jobs.items()}
    conditions: dict[int, Column] = {}
    while open_ := {n: s for n, s in state.items() if not s["done"]}:
        order = lambda s: F.col("point" if s["depth"] else s["dim"]).cast("double")
        slice_, held = F.lit(None).cast("int"), F.lit(False)
        for n, s in open_.items():
            here = (F.col("node") == n) & (order(s) >= s["low"]) & (order(s) <= s["high"])
            for c, v in s["fixed"]:
                here &= F.col(c).cast("double") == v
            width = (s["high"] - s["low"]) / SLICES
            place = F.least(F.floor((order(s) - s["low"]) / width), F.lit(SLICES - 1)).cast("int") if width > 0 else F.lit(0)
            slice_, held = F.when(here, place).otherwise(slice_), held | here
        key = F.lit(None).cast("double")
        for n, s in open_.items():
            key = F.when(F.col("node") == n, order(s)).otherwise(key)
        sums: dict[int, list] = {n: [] for n in open_}
        counted = rows.where(held).groupBy("node", slice_.alias("slice")).agg(F.sum("w").alias("w"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(counted, key=lambda r: (r["node"], r["slice"])):
            sums[r["node"]].append((float(r["w"]), r["low"], r["high"]))
        for n, s in open_.items():
            before, chosen = 0.0, None
            for w, low, high in sums[n]:
                if before + w >= s["need"]:
                    chosen = (w, low, high)
                    break
                before += w
            c = "point" if s["depth"] else s["dim"]
            if chosen is None:  # nothing left to weigh: all of it goes left
                s["done"], s["bound"] = True, (c, sums[n][-1][2] if sums[n] else s["high"], True)
                continue
            w, low, high = chosen
            s["need"] -= before
            if min(s["need"], w - s["need"]) <= tolerance or (low == high and s["depth"] == 1):
                # The slice is light on one side: it goes wholly to the nearer side.
                left = w - s["need"] <= s["need"]
                s["done"], s["bound"] = True, (c, high if left else low, left)
            elif low == high:
                s["fixed"].append((c, low))
                s["depth"], s["low"], s["high"] = 1, -(2.0**63), 2.0**63
            else:
                s["low"], s["high"] = low, high
    for n, s in state.items():
        c, bound, included = s["bound"]
        x = F.col(c).cast("double")
        left = x <= bound if included else x < bound
        for fixed, v in reversed(s["fixed"]):
            y = F.col(fixed).cast("double")
            left = (y < v) | ((y == v) & left)
        conditions[n] = left
    return conditions


def shards(docs: DataFrame, *, key: str = "doc_id", text: str = "text", dims: dict[str, Column], law: str = "bytes", n_shards: int = SHARDS, label: str = "kdtree") -> tuple[DataFrame, Scratch]:
    """(id, size, crc, shard, slot) of every row and the folder of the tables behind it."""
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    scratch = Scratch(docs.sparkSession, label)
    dims = {f"dim_{n}": c for n, c in dims.items()}
    names = list(dims)
    rows = scratch.keep(points(docs, key=key, text=text, dims=dims, weight=law), "rows")
    groups = scratch.keep(grouped(rows, names), "groups")
    whole = groups.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), *[F.stddev_pop(n).alias(n) for n in names]).first()
    target = float(whole["w"] or 0) / n_shards
    if not target:
        return _slots(rows.withColumn("shard", F.lit(0))), scratch

    # Heavy points: at most n_shards / HEAVY of them, largest first to the emptiest shard.
    room = {s: target for s in range(n_shards)}
    pieces: list[tuple[float, int, int]] = []
    heavy = [(r["point"], float(r["w"])) for r in groups.where(F.col("w") > HEAVY * target).select("point", "w").collect()]
    cut = {p: int(-(-w // (target / 2))) for p, w in heavy if w > target}
    known = rows.sparkSession.createDataFrame([(p, n) for p, n in cut.items()], "point bigint, pieces int")
    piece = F.pmod(F.xxhash64("row", "point"), F.col("pieces")).cast("int")
    if cut:
        got = rows.join(F.broadcast(known), "point").groupBy("point", piece.alias("piece")).agg(F.sum("w").alias("w")).collect()
        pieces = [(float(r["w"]), r["point"], r["piece"]) for r in got]
    pieces += [(w, p, -1) for p, w in heavy if p not in cut]
    placed = []
    for w, p, part in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        shard = max(room, key=lambda s: (room[s], -s))
        room[shard] -= w
        placed.append((p, part, shard))
    hot = F.broadcast(rows.sparkSession.createDataFrame(placed, "point bigint, piece int, hot int"))

    # A node is named by its first shard; splits holds, level by level, which points go right.
    light = groups.where(F.col("w") <= HEAVY * target)
    nodes, node, level = {0: n_shards}, F.lit(0), 0
    left_room = lambda a, n: max(sum(room[s] for s in range(a, a + n)), 0.0)
    measures = [F.sum("w").alias("w"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max), ("sd", F.stddev_pop))]]
    while any(s > 1 for s in nodes.values()):
        at = light.withColumn("node", node)
        stats = {r["node"]: r for r in at.groupBy("node").agg(*measures).collect()}
        jobs = {}
        for n, s in nodes.items():
            r = stats.get(n)
            if s > 1 and r is not None:
                spread = {d: (r[f"sd_{d}"] or 0.0) / ((whole[d] or 0.0) or 1.0) for d in names}
                dim = max(names, key=lambda d: (spread[d], -names.index(d)))
                share = left_room(n, s // 2) / (left_room(n, s) or 1.0)
                jobs[n] = {"dim": dim, "low": r[f"min_{dim}"], "high": r[f"max_{dim}"], "goal": float(r["w"]) * share}
        cuts = _cut(at, jobs, TOLERANCE * target)
        deeper, out = {}, node
        for n, s in nodes.items():
            if s == 1:
                deeper[n] = 1
                continue
            deeper[n], deeper[n + s // 2] = s // 2, s - s // 2
            if n in cuts:
                out = F.when((node == n) & ~cuts[n], n + s // 2).otherwise(out)
        # The nodes of a level are written, so that plans stay as small as one level.
        level += 1
        light = scratch.keep(at.withColumn("next", out.cast("int")).drop("node", "shard").withColumnRenamed("next", "shard"), f"level-{level}")
        if level > 1:
            scratch.drop(f"level-{level - 1}")
        nodes, node = deeper, F.col("shard")
    if n_shards == 1:
        light = light.withColumn("shard", F.lit(0))

    # Rows find the shard of their point: heavy points, and light ones of very many rows, are sent to all tasks.
    dense = light.where(F.col("n") * 1000 > whole["n"]).select("point", F.col("shard").alias("dense"))
    at = rows.join(F.broadcast(known), "point", "left").withColumn("piece", F.coalesce(piece, F.lit(-1))).join(hot, ["point", "piece"], "left").join(F.broadcast(dense), "point", "left")
    at = at.withColumn("known", F.coalesce("hot", "dense"))
    columns = ["id", "size", "crc", "row"]
    rest = at.where("known IS NULL").join(light.select("point", "shard"), "point").select(*columns, "shard")
    return _slots(scratch.keep(at.where("known IS NOT NULL").select(*columns, F.col("known").alias("shard")).unionByName(rest), "shards")), scratch


def _slots(rows: DataFrame) -> DataFrame:
    """Adds gapless slots of each shard, by buckets small enough for one task."""
    n = max(1, -(-rows.count() // (SHARDS * SLOT_ROWS)))
    placed = rows.withColumn("bucket", F.pmod(F.col("row"), F.lit(n)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "row"))
    return placed.withColumn("n", own).join(first, ["shard", "bucket"]).select("id", "size", "crc", "shard", (F.col("first") + F.col("n") - 1).cast("bigint").alias("slot"))
