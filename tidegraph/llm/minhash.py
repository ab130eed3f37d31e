"""Near-duplicate classes by fast similarity sketches, banding and exact verification.

Sketch (t coordinates): in round i each shingle falls into a hashed bin and offers the value
(i, hash); from round t on, round i fills bin i - t whatever falls, so 2t rounds fill every coordinate.
A coordinate keeps its least value, so later rounds only matter for bins still empty;
two sets agree in a coordinate with a chance equal to their Jaccard similarity, with
the concentration of t independent samples.

Banding: rows of t / BANDS coordinates make a key, and documents that share a key are candidates. At
the least similarity that counts (0.8), 48 bands of 5 rows miss a pair with a chance of 5e-9.

Pairs without the square of a group:
1. Texts of equal word sequences (by a 128-bit digest of the whole sequence) are one class from the start; only
   their least id goes on.
2. In each bucket every member is compared with the bucket's hub, exactly, on the full sets; the
   links found give components. Two candidates share a bucket, so both are in the star of its hub. The hub is the member
   that shares its buckets with most others: a text in the middle of its copies, the same in most of their buckets.
3. A member is the hub's set less its removed shingles plus its added ones, and all that follows works on these
   differences. Members of one component need no comparison, as only components count, so of a pair one member is not
   linked with the hub; from that follows how many removed and added shingles the two must have in common at least (see _entries). A
   prefix filter on these, rare ones first, deals members into cells (hub, shingle).
4. Rounds of stars: in each cell every member is compared with one head if their components differ. A round is linear in
   the entries; cells of one component fall out, and families that are not close to the hub grow together.
5. When a round finds no link, what is left are cells of components that hardly touch. There members of
   different components meet, and sizes, sketches and bitmaps of the differences are tested within the join, so that it
   yields few but real links. No possible link between different components is left out, so the
   components are those of all links among candidates.

Results. Null, empty and white-space texts have no shingles and are linked with nothing. A text of fewer than
k words is one shingle. Rows with a null id are left as their own class (component null). Rows that repeat an id share
its component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm import textbatch as tb
from tidegraph.llm.components import components
from tidegraph.llm.store import Scratch

BANDS, ROWS = 48, 5
T = BANDS * ROWS
U = np.uint64


def shingle_sets(chunk: tb.Chunk, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sorted distinct shingle codes of all texts, their n+1 offsets, and a digest of each text's word sequence."""
    starts, ends, own = tb.words(chunk)
    codes = tb.SpanHash(chunk.data, lower=True).of(starts, ends)
    grams, own_k = tb.windows(codes, own, k)
    lengths = np.diff(own)
    # Words in lower case, each followed by one space.
    tail = ends - 1
    kept = ~tb.SPACE[chunk.data]
    sizes = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=sizes[1:])
    body = np.full(int(sizes[-1]) + len(starts), 32, np.uint8)
    at = np.flatnonzero(kept)
    word = np.zeros(len(at), np.int64)
    word[sizes[tail[:-1]] + 1] = 1
    body[np.arange(len(at)) + np.cumsum(word)] = tb.LOWER[chunk.data[at]]
    edges = sizes[chunk.offsets] + own
    parts, digests, counts = [], [], np.zeros(chunk.n, np.int64)
    for i in range(chunk.n):
        digest = hashlib.blake2b(body[edges[i] : edges[i + 1]].tobytes(), digest_size=16).digest()
        if lengths[i] >= k:
            got = np.unique(grams[own_k[i] : own_k[i + 1]])
        else:
            got = np.frombuffer(digest, U)[: 1 if lengths[i] else 0]
        parts.append(got)
        digests.append(digest)
        counts[i] = len(got)
    offsets = np.zeros(chunk.n + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U)), offsets, digests


def sketches(sets: np.ndarray, offsets: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketches, a row of t values for each set; rows of empty sets are all ones."""
    n = len(offsets) - 1
    top = U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, top, U)
    own = tb.owner(offsets)
    live = np.diff(offsets) > 0
    elements, of = sets, own
    for i in range(2 * t):
        if not len(elements):
            break
        h = tb.mix(elements + U((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> U(32)) * U(t)) >> U(32) if i < t else np.full(len(h), i - t, U)
        # Values of one round are compared by the hash alone; filled bins take nothing more.
        value = tb.mix(h + U(i)) >> U(1)
        at = of * t + bins.astype(np.int64)
        empty = out[at] == top
        at, value = at[empty], value[empty]
        np.minimum.at(out, at, value)
        full = (out.reshape(n, t) != top).all(1)
        if (full & live).any():
            live &= ~full
            still = live[of]
            elements, of = elements[still], of[still]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band of each sketch; keys of different bands differ."""
    n, t = sketch.shape
    rows = sketch.reshape(n, bands, t // bands)
    out = np.broadcast_to(tb.mix(np.arange(1, bands + 1, dtype=U)), (n, bands)).copy()
    for k in range(t // bands):
        out = tb.mix(out * U(0xE7037ED1A0B428DB) + rows[:, :, k])
    return out


def packed_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate as 2 x ceil(t / 64) longs."""
    n, t = sketch.shape
    words = -(-t // 64)
    out = np.zeros((n, 2 * words), U)
    for b in range(2):
        bit = (sketch >> U(7 + b)) & U(1)
        for w in range(words):
            part = bit[:, w * 64 : (w + 1) * 64]
            out[:, b * words + w] = (part << np.arange(part.shape[1], dtype=U)).sum(1, dtype=U)
    return out.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _most_different(similarity: float, t: int = T) -> int:
    """Coordinates in which a pair of that similarity may differ in its two bits, six deviations up."""
    p = (1 - similarity) * 0.75
    return int(t * p + 6 * (t * p * (1 - p)) ** 0.5) + 1


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    """(id, n_shingles, whole, bits, keys) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tb.chunks(batches, "__text", 1 << 20):
            sets, offsets, whole = shingle_sets(chunk, k)
            sketch = sketches(sets, offsets)
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column(0), pa.array(np.diff(offsets)), pa.array(whole, pa.binary()), _lists(packed_bits(sketch)), _lists(band_keys(sketch))],
                names=["id", "n", "whole", "bits", "keys"],
            )

    return tb.through_python(rows, run, "id bigint, n bigint, whole binary, bits array<bigint>, keys array<bigint>")


def _full_sets(rows: DataFrame, k: int) -> DataFrame:
    """(id, shingles) with the sorted codes of every text's full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tb.chunks(batches, "__text", 1 << 20):
            sets, offsets, _ = shingle_sets(chunk, k)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), lists], names=["id", "shingles"])

    return tb.through_python(rows, run, "id bigint, shingles array<bigint>")


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches do not rule out the similarity of two sketched rows."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    words = -(-T // 64)
    differ = sum(
        (F.bit_count(F.col(f"{a}.bits")[w].bitwiseXOR(F.col(f"{b}.bits")[w]).bitwiseOR(F.col(f"{a}.bits")[words + w].bitwiseXOR(F.col(f"{b}.bits")[words + w]))) for w in range(words)),
        F.lit(0),
    )
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ <= _most_different(percent / 100))


#: Longs of the bitmap of a member's differences from its hub.
MAP_WORDS = 8


def _bitmap(shingles: Column) -> Column:
    """A bit for each shingle, in MAP_WORDS longs."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))

    def word(w: int) -> Column:
        own = F.filter(shingles, lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(MAP_WORDS - 1)) == w)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda bits, x: bits.bitwiseOR(bit(x)))

    words = [word(w) for w in range(MAP_WORDS)]
    return F.array(*words)


def _close(both: Column, a: str, b: str, percent: int) -> Column:
    """both shared shingles make a link of two members."""
    return both * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent


def _may_share(a: str, b: str, percent: int) -> Column:
    """The bitmaps leave room for a link: a bit that only one of them has is a difference that the other lacks."""
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}.map")[w].bitwiseAND(F.bitwise_not(F.col(f"{y}.map")[w]))) for w in range(MAP_WORDS)), F.lit(0))
    c = lambda x, f: F.col(f"{x}.{f}")
    common = F.least(c(a, "added") + c(a, "removed") - only(a, b), c(b, "added") + c(b, "removed") - only(b, a))
    return _close(common + c(a, "hub") - c(a, "removed") - c(b, "removed"), a, b, percent)


#: Up to so many ids (some 40 MB) go to all tasks to pick their texts; beyond, texts and ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _compared(pairs: DataFrame, rows: DataFrame, k: int, scratch: Scratch, name: str, fan: int = 512) -> DataFrame:
    """For each pair (u, v): sizes of the full sets, of their intersection, and the shingles that v adds to u and lacks.

    Full sets are only made for documents in a pair. A hub u can stand in very many pairs: its set is copied
    once for each fan of its pairs, so that no task gets all pairs of one hub.
    """
    needed = scratch.keep(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), f"{name}-ids")
    few = needed.count() <= BROADCAST_IDS
    sets = scratch.keep(_full_sets(rows.join(F.broadcast(needed) if few else needed, "id", "left_semi"), k).dropDuplicates(["id"]), f"{name}-sets")
    hubs = pairs.groupBy("u").agg(F.ceil(F.count("*") / fan).cast("int").alias("salts"))
    salted = pairs.join(hubs, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"))
    with_v = salted.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    left = hubs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").select("u", "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    out = with_v.join(left, ["u", "salt"]).select("u", "v", F.size("a").alias("hub"), F.size("b").alias("n"), F.array_except("b", "a").alias("plus"), F.array_except("a", "b").alias("minus"))
    out = scratch.keep(out, name)
    scratch.drop(f"{name}-sets")
    scratch.drop(f"{name}-ids")
    return out


def _entries(members: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Cells (u, kind, s) of the members that can have a link with a member of another component there.

    Let a and b be members of one hub of H shingles, x+ and x- the numbers that x adds and removes, t = percent / (100 + percent).
    They are linked if they share t (na + nb), that is, if their common differences S, removed and added ones, are no fewer than
    t (na + nb) - H + a- + b-. If a is not linked with the hub, H - a- < t (na + H), so S > (1 - t) b- + t b+.
    Common removed ones are at most b-, so more than t (b+ - b-) added ones are common: one at least if b+ >= b-. Without a
    common added one, b- > b+, more than (1 - t) b- + t b+ removed ones are common, and both members lie with their t (na + nb)
    shared shingles within the hub, so with percent of their own each.
    All members are such a b, and with two members outside the hub's component both are; near holds the prefix that any
    partner asks for: all elements of a member outside meet the short prefixes of those inside.
    Without a common added one, t (na + nb) <= H - a- also bounds nb by what `room` says of a, so cells of
    removed shingles, which many members of a large group share, only keep members with a partner of a size that fits.
    """
    t = F.lit(100 + percent)
    more = F.col("added") - F.col("removed")
    inside = (F.col("hub") - F.col("removed")) * 100 >= F.col("n") * percent
    taken = F.when(inside & ((more < 0) | F.col("far")), F.col("minus")).otherwise(F.slice("minus", 1, 0))
    tagged = lambda x, kind: F.transform(x, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))
    room = F.floor((F.col("hub") - F.col("removed")) * t / percent) - F.col("n")
    each = members.select("u", "v", "component", "far", "added", "removed", "n", room.alias("room"), F.explode(F.concat(tagged(F.col("plus"), 0), tagged(taken, 1))).alias("e")).select("*", "e.*").drop("e")
    cells = each.groupBy("u", "kind", "s").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("u", "kind", "s", "c")
    shared = each.join(cells, ["u", "kind", "s"])
    # Elements in no such cell come first in the common order, then rare ones; so the prefix ends early.
    rank = F.row_number().over(Window.partitionBy("u", "v", "kind").orderBy("c", "s"))
    many = F.count("*").over(Window.partitionBy("u", "v", "kind"))
    size = F.when(F.col("kind") == 0, F.col("added")).otherwise(F.col("removed"))
    need = F.when(F.col("kind") == 0, F.greatest(F.floor(more * percent / t) + 1, F.lit(1))).otherwise(F.floor((F.col("removed") * 100 + F.col("added") * percent) / t) + 1)
    short = (size - F.col("many") + F.col("rank") <= size - need + 1) & ((F.col("kind") == 0) | (more < 0))
    marked = shared.withColumn("rank", rank).withColumn("many", many).withColumn("short", short).where("short OR far").select("u", "kind", "s", "v", "component", "far", "short", "n", "room")
    marked = scratch.keep(marked, f"{name}-marked")
    # Short prefixes of two members outside meet, and those inside meet all elements of members outside: what is left of the cells.
    meeting = (
        marked.groupBy("u", "kind", "s")
        .agg(F.sum((F.col("short") & ~F.col("far")).cast("int")).alias("inside"), F.sum((F.col("short") & F.col("far")).cast("int")).alias("outside"), F.max("far").alias("any"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.when(F.col("short"), F.col("n"))).alias("least"), F.max(F.when(F.col("far"), F.col("room"))).alias("most"))
        .where("any AND lo <> hi AND (inside > 0 OR outside > 1)")
        .select("u", "kind", "s", (F.col("inside") > 0).alias("inside"), "least", "most")
    )
    fits = (F.col("kind") == 0) | F.when(F.col("far"), F.col("room") >= F.col("least")).otherwise(F.col("n") <= F.col("most"))
    out = scratch.keep(marked.join(meeting, ["u", "kind", "s"]).where((F.col("short") | F.col("inside")) & fits).select("u", "kind", "s", "v", "short"), name)
    scratch.drop(f"{name}-marked")
    return out


def _is_link(percent: int) -> Column:
    return (F.col("n") - F.size("plus")) * (100 + percent) >= (F.col("hub") + F.col("n")) * percent


#: Rounds of stars over cells at most; what they leave is compared member by member, so no link depends on it.
STAR_ROUNDS = 3


def _joined_families(members: DataFrame, links: DataFrame, found: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Components (node, component) with all links among members (u, v, hub, n, plus, minus, bits) of the same hub."""

    def placed(found: DataFrame, name: str) -> DataFrame:
        at = members.join(found.select(F.col("node").alias("v"), "component"), "v", "left").join(found.select(F.col("node").alias("u"), F.col("component").alias("main")), "u", "left")
        at = at.withColumn("component", F.coalesce("component", "v")).withColumn("far", F.col("component") != F.coalesce("main", "u"))
        return scratch.keep(at.drop("main"), name)

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs (u, a, b), from the differences of both to their hub."""
        side = lambda x: members.select("u", F.col("v").alias(x), F.struct("hub", "n", "plus", "minus").alias(f"{x}_"))
        both = F.col("a_.hub") - F.size(F.array_union("a_.minus", "b_.minus")) + F.size(F.array_intersect("a_.plus", "b_.plus"))
        return pairs.join(side("a"), ["u", "a"]).join(side("b"), ["u", "b"]).where(_close(both, "a_", "b_", percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))

    slim = ["u", "v", "component", "far", "hub", "n", "added", "removed", "map", "bits"]
    looks = lambda x, at: at.select("u", F.col("v").alias(x), F.struct("component", "far", "hub", "n", "added", "removed", "map", "bits").alias(x + "_"))
    # Cheap tests first: what both keep of the hub, and the added ones if some are common, must do for a link.
    x = lambda f, best: best(F.col(f"a_.{f}"), F.col(f"b_.{f}"))
    enough = _close(F.col("a_.hub") - x("removed", F.greatest) + F.when(F.col("kind") == 0, x("added", F.least)).otherwise(0), "a_", "b_", percent)
    fits = (F.col("a_.component") != F.col("b_.component")) & enough & _possible("a_", "b_", percent) & _may_share("a_", "b_", percent)
    at = placed(found, "placed-0")
    entries = _entries(at, percent, scratch, "entries")
    at = at.select(*slim)
    for r in range(STAR_ROUNDS):
        heads = entries.groupBy("u", "kind", "s").agg(F.min(F.struct(F.xxhash64("v", F.lit(r)), F.col("v").alias("v")))["v"].alias("a"))
        pairs = entries.join(heads, ["u", "kind", "s"]).where("v <> a").groupBy("u", F.least("a", "v").alias("a"), F.greatest("a", "v").alias("b")).agg(F.min("kind").alias("kind"))
        pairs = pairs.join(looks("a", at), ["u", "a"]).join(looks("b", at), ["u", "b"]).where(fits).select("u", "a", "b")
        new = scratch.keep(verified(pairs), f"star-{r}")
        if new.isEmpty():
            break
        links = links.unionByName(new)
        found = scratch.keep(components(links, scratch, f"cc-{r}"), f"components-{r}")
        at = placed(found, f"placed-{r + 1}").select(*slim)
        scratch.drop(f"placed-{r}")
    # Short prefixes meet each other, and those of members inside the hub's component meet all elements of those outside.
    side = entries.join(at, ["u", "v"]).select("u", "kind", "s", "short", F.struct("v", *slim[2:]).alias("m"))
    a, b = side.select("u", "kind", "s", F.col("short").alias("a_short"), F.col("m").alias("a_")), side.where("short").select("u", "kind", "s", F.col("m").alias("b_"))
    meet = F.col("a_.far") & fits & F.when(F.col("b_.far"), F.col("a_short") & (F.col("a_.v") < F.col("b_.v"))).otherwise(True)
    rest = a.join(b, ["u", "kind", "s"]).where(meet).select("u", F.col("a_.v").alias("a"), F.col("b_.v").alias("b")).distinct()
    new = scratch.keep(verified(rest), "rest")
    if new.isEmpty():
        return found
    return scratch.keep(components(links.unionByName(new), scratch, "cc-rest"), "components-rest")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, label: str = "minhash") -> tuple[DataFrame, Scratch]:
    """Sizes and components of all documents.

    Returns one row for each row of docs (doc_id, n_shingles, component_id, kept, n_copies) and the folder of
    the tables behind it, which the caller may drop once the result is written. key must be integer.
    k: words of a shingle; percent: least Jaccard similarity, in hundredths.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("__text"))
    # One pass of the texts; what it makes is kept: some 600 bytes a document.
    sketched = scratch.keep(_sketched(rows, k), "sketches")
    classes = scratch.keep(sketched.where("n > 0 AND id IS NOT NULL").groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    # Sketches of one row for each class: its least id's first row.
    reps = sketched.join(classes.select("whole", F.col("rep").alias("id")), ["whole", "id"]).dropDuplicates(["id", "whole"])
    reps = scratch.keep(reps.select("id", "n", "bits", "keys"), "reps")

    entries = lambda rows, *more: rows.select(F.explode("keys").alias("key"), "id", *more)
    sizes = entries(reps).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    degrees = scratch.keep(entries(reps).join(sizes, "key").groupBy("id").agg(F.sum("c").alias("degree")), "degrees")
    shared = entries(reps.join(degrees, "id"), "degree")
    hubs = shared.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("least"))).alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", (-F.col("hub.least")).alias("u"))
    stars = scratch.keep(shared.join(hubs, "key").where("id <> u").select("u", F.col("id").alias("v")).distinct(), "stars")
    star = _compared(stars, rows, k, scratch, "star")
    links = scratch.keep(star.where(_is_link(percent)).select("u", "v"), "links")
    found = scratch.keep(components(links, scratch, "cc"), "components")

    # Hubs with a member that no link has brought to them.
    open_ = star.join(found.select(F.col("node").alias("v"), F.col("component").alias("c")), "v", "left").join(found.select(F.col("node").alias("u"), F.col("component").alias("h")), "u", "left")
    open_ = open_.where(F.coalesce("c", "v") != F.coalesce("h", "u")).select("u").distinct()
    members = star.join(open_, "u", "left_semi").join(reps.select(F.col("id").alias("v"), "bits"), "v")
    members = members.withColumn("added", F.size("plus")).withColumn("removed", F.size("minus")).withColumn("map", _bitmap(F.concat("plus", "minus")))
    members = scratch.keep(members, "members")
    scratch.drop("star")
    found = _joined_families(members, links, found, percent, scratch)

    by_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("whole", F.coalesce("component", "rep").alias("component"), "copies")
    by_class = scratch.keep(by_class, "by-class")
    return _labelled(sketched.select("id", "n", "whole"), by_class), scratch


def _labelled(rows: DataFrame, by_class: DataFrame) -> DataFrame:
    """Each row with its class. Classes of over a thousandth of all rows, a thousand at most, are sent to all tasks instead of dealt out."""
    least = by_class.agg(F.sum("copies")).first()[0] or 0
    hot = by_class.where(F.col("copies") * 1000 > least)
    known = F.broadcast(hot.select("whole", F.col("component").alias("hot_component"), F.col("copies").alias("hot_copies")))
    at = rows.join(known, "whole", "left")
    # A row of a hot class looks for nothing: its key is null.
    rest = at.withColumn("seek", F.when(F.col("hot_copies").isNull() & (F.col("n") > 0) & F.col("id").isNotNull(), F.col("whole")))
    out = rest.where("seek IS NOT NULL").join(by_class.withColumnRenamed("whole", "seek"), "seek", "left").select("id", "n", "component", "copies")
    out = out.unionByName(rest.where("seek IS NULL").select("id", "n", F.col("hot_component").alias("component"), F.col("hot_copies").alias("copies")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.coalesce(F.when(F.col("id").isNotNull(), F.col("copies")), F.lit(1)).cast("bigint").alias("n_copies"),
    )
