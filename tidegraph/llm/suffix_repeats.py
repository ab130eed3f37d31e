"""Removal of long repeated byte strings by common-prefix intervals of a sparse suffix array.

A byte goes if a string of L bytes that covers it starts anywhere else too. Sorting all suffixes of a corpus is not
needed to know that: only suffixes at anchors are sorted, chosen by content so that
every string of L bytes holds one at the same place in all its occurrences
(the least hash of a k-gram in a window of L - k + 1; k = L / 2).

1. Anchors: one vectorised pass gives each text's anchors with the hash of the k-gram (the group) and of its whole
   context (up to L - k bytes on both sides, cut only by the text's ends).
2. Groups of one occurrence are dropped. Occurrences of equal context are one entry with a count, so a
   passage copied a million times is one entry; with a count of two or more all of its context
   repeats.
3. Groups with different contexts: the entries' suffixes are sorted, the array of common prefixes is scanned
   with a stack, and each interval of the tree gives all occurrences that share its depth to the right. Where
   left extensions differ within an interval, each member's longest shared one is found from its neighbours
   in the order of reversed left contexts. Left plus right shared length decides (with the k-gram, L or more).
4. Groups of very many different contexts are not put in one task: each of the L - k + 1 windows of an
   entry is hashed, and windows that occur twice are counted by a distributed aggregation, which gives the same stretch.
5. The stretches of each text are united and cut out.

Rows of a key that has very many of them (a group, a context, a window) are joined where they are: what is known of such
keys is sent to all tasks, and all other rows are dealt out by key (matched).

Results. Null and empty texts have no bytes; texts of under L bytes keep all. Repeated rows count as
copies of each other. An empty table gives an empty result. Contexts are taken as equal by two independent 62-bit
hashes, windows in step 4 by one beside that of their group; in step 3 strings are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb
from tidegraph.llm.store import Scratch

LENGTH = 400
#: Groups of more different contexts go by step 4.
HOT_GROUP = 20_000
#: Keys of more rows are not dealt out by key; at most MOST_HEAVY keys, as those rarer than one row in so many never are.
HEAVY = 10_000
MOST_HEAVY = 100_000
U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)


def _sliding(a: np.ndarray, w: int, best, fill) -> np.ndarray:
    """best (minimum or maximum) of each window of w elements, by running values from both ends of blocks."""
    m = len(a)
    block = np.concatenate([a, np.full(-m % w, fill, a.dtype)]).reshape(-1, w)
    ahead = best.accumulate(block, 1).ravel()
    behind = best.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    n = m - w + 1
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(chunk: tb.Chunk, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, position, k-gram hash, two hashes of the context, left and right context sizes) of all anchors of a chunk."""
    k = length // 2
    w = length - k + 1
    hashes = tb.SpanHash(chunk.data)
    out: list[tuple[int, np.ndarray]] = []
    for i in np.flatnonzero(np.diff(chunk.offsets) >= length).tolist():
        a, b = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
        places = np.arange(a, b - k + 1)
        h = hashes.sliding(a, b, k) >> U(1)
        least = _sliding(h, w, np.minimum, TOP)
        edge = np.zeros(w - 1, U)
        of = _sliding(np.concatenate([edge, least, edge]), w, np.maximum, U(0))
        out.append((i, places[of == h]))
    text = np.repeat([i for i, _ in out], [len(p) for _, p in out]).astype(np.int64)
    at = np.concatenate([p for _, p in out]) if out else np.zeros(0, np.int64)
    start, end = chunk.offsets[text], chunk.offsets[text + 1]
    left, right = np.minimum(at - start, length - k), np.minimum(end - at - k, length - k)
    gram = hashes.of(at, at + k)
    context = tb.mix(hashes.of(at - left, at + k + right) + tb.mix((left * 4096 + right).astype(U)))
    check = tb.SpanHash(chunk.data, salt=1).of(at - left, at + k + right)
    return text, at - start, gram, context, check, left, right


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of all intervals of the common-prefix tree; lcp[i] is that of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []  # first suffix and depth of open intervals
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > depth:
            first, d = stack.pop()
            yield first, i, d
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))


def group_stretches(lefts: list[bytes], rights: list[bytes], need: int) -> list[tuple[int, int]]:
    """For each entry of an anchor group, how far it repeats left and right of the k-gram; (-1, -1) if not far enough.

    lefts are reversed, so that a common prefix is a shared extension to the left.
    """
    n = len(rights)
    best = [(-1, -1)] * n
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for first, last, depth in prefix_intervals(lcp):
        members = order[first : last + 1]
        # Left diversity: members sorted by what stands before them; a neighbour shares most.
        members.sort(key=lefts.__getitem__)
        shared = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for j, i in enumerate(members):
            left = max(shared[j - 1] if j else 0, shared[j] if j < len(shared) else 0)
            if left + depth >= need:
                best[i] = (max(best[i][0], left), max(best[i][1], depth))
    return best


def matched(many: DataFrame, one: DataFrame, keys: list[str], heavy: int = HEAVY, how: str = "inner") -> DataFrame:
    """Inner or left join of many with one on keys; one has one row a key, and in `rows` how many rows of many have that key.

    Both are read more than once, so they should be written tables.
    """
    most = max(heavy, many.count() // MOST_HEAVY)
    some, others = one.where(F.col("rows") > most).drop("rows"), one.where(F.col("rows") <= most).drop("rows")
    if some.isEmpty():
        return many.join(others, keys, how)
    rest = many.join(F.broadcast(some.select(*keys)), keys, "left_anti")
    return many.join(F.broadcast(some), keys).unionByName(rest.join(others, keys, how))


def repeated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot_group: int = HOT_GROUP, heavy: int = HEAVY, cleaned: bool = False, label: str = "repeats") -> tuple[DataFrame, Scratch]:
    """Removal counts of every row, with cleaned also the kept text (invalid UTF-8 at cuts replaced).

    Returns (key, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) and the folder of the tables behind it.
    """
    k, side = length // 2, length - length // 2
    scratch = Scratch(docs.sparkSession, label)
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).alias("id"), F.col(text).alias("__text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tb.chunks(batches, "__text"):
            of, at, gram, context, check, left, right = anchors(chunk, length)
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column(0).take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(check.view(np.int64)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))],
                names=["row", "at", "gram", "context", "check", "l", "r"],
            )

    # Under a tenth of the text's size: an anchor in about k / 2 bytes.
    found = scratch.keep(tb.through_python(rows.select("row", "__text").where(F.octet_length("__text") >= length), find, "row bigint, at int, gram bigint, context bigint, check bigint, l smallint, r smallint"), "anchors")
    least_most = [f(c).alias(f"{f.__name__}_{c}") for c in ("context", "check") for f in (F.min, F.max)]
    groups = found.groupBy("gram").agg(F.count("*").alias("rows"), *least_most).where("rows > 1")
    groups = scratch.keep(groups.select("gram", "rows", F.expr("min_context != max_context OR min_check != max_check").alias("differs")), "groups")
    shared = scratch.keep(matched(found, groups, ["gram"], heavy), "shared")
    scratch.drop("anchors")
    scratch.drop("groups")
    entries = shared.where("differs").groupBy("gram", "context", "check").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "l", "r")).alias("e"))
    entries = scratch.keep(entries.select("gram", "context", "check", "n", "e.*"), "entries")
    # All of a context that occurs twice repeats; others are compared within their group.
    large = scratch.keep(entries.groupBy("gram").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_group).withColumn("hot", F.lit(True)), "large")
    flagged = matched(entries, large, ["gram"], heavy, "left").withColumn("hot", F.col("hot").isNotNull())
    asked = flagged.groupBy("row").agg(F.collect_list(F.struct("gram", "context", "check", "n", "at", "l", "r", "hot")).alias("asked"))
    texts = rows.select("row", "__text").join(asked, "row")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "check", "n", "lefts", "rights", "windows"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for body, items in zip(batch.column(1).slice(first, 64).to_pylist(), batch.column(2).slice(first, 64).to_pylist()):
                    raw = body.encode("utf-8")
                    hashes = None
                    for x in items:
                        a, b = x["at"] - x["l"], x["at"] + k + x["r"]
                        if not x["hot"]:
                            out.append((x["gram"], x["context"], x["check"], x["n"], raw[a : x["at"]][::-1], raw[x["at"] + k : b], None))
                            continue
                        if hashes is None:
                            hashes = tb.SpanHash(np.frombuffer(raw, np.uint8))
                        starts = np.arange(a, b - length + 1)
                        # Its place relative to the k-gram is part of a window's hash.
                        w = tb.mix(hashes.of(starts, starts + length) + (x["at"] - starts).astype(U))
                        out.append((x["gram"], x["context"], x["check"], x["n"], None, None, np.stack([x["at"] - starts, w.view(np.int64)], 1).ravel().tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], types[c]) for c in range(7)], names=names)

    ready = scratch.keep(tb.through_python(texts, contexts, "gram bigint, context bigint, check bigint, n bigint, lefts binary, rights binary, windows array<bigint>"), "contexts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group; a group may span batches."""
        # A repeated row brings its contexts once more.
        now, entry = None, {}

        def flush() -> list[tuple[int, ...]]:
            best = group_stretches([e[1] for e in entry.values()], [e[2] for e in entry.values()], side)
            out = []
            for ((context, check), (n, left, right)), (l, r) in zip(entry.items(), best):
                if n > 1 and len(left) + len(right) >= side:
                    l, r = len(left), len(right)
                if l >= 0:
                    out.append((now, context, check, n, l, r))
            return out

        def rows_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(6)], names=["gram", "context", "check", "rows", "left", "right"])

        for batch in batches:
            out: list[tuple[int, ...]] = []
            for gram, context, check, n, left, right in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if gram != now:
                    if entry:
                        out += flush()
                    now, entry = gram, {}
                entry[context, check] = (n, left, right)
            yield rows_of(out)
        if entry:
            yield rows_of(flush())

    cold = ready.where("windows IS NULL").select("gram", "context", "check", "n", "lefts", "rights").repartition("gram").sortWithinPartitions("gram")
    verdicts = tb.through_python(cold, compare, "gram bigint, context bigint, check bigint, rows bigint, left bigint, right bigint")
    hot = None
    if not large.isEmpty():
        at = F.sequence(F.lit(1), F.size("windows") - 1, F.lit(2))
        pairs = F.transform(at, lambda i: F.struct(F.element_at("windows", i).alias("left"), F.element_at("windows", i + 1).alias("hash")))
        hot = ready.where(F.size("windows") > 0).select("gram", "context", "check", "n", F.explode(pairs).alias("w"))
    if hot is not None:
        windows = hot.select("gram", "context", "check", "n", "w.left", "w.hash")
        twice = windows.groupBy("gram", "hash").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).where("total > 1")
        twice = scratch.keep(twice.select("gram", "hash", "rows"), "twice")
        seen = matched(windows, twice, ["gram", "hash"], heavy).groupBy("gram", "context", "check")
        seen = seen.agg(F.max("n").alias("rows"), F.max("left").alias("left"), (side - F.min("left")).alias("right"))
        verdicts = verdicts.unionByName(seen)
    verdicts = scratch.keep(verdicts, "verdicts")

    plain = shared.where("NOT differs").where(F.col("l") + F.col("r") >= side).select("row", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + k + F.col("r")).alias("end"))
    judged = matched(shared.where("differs"), verdicts, ["gram", "context", "check"], heavy).select("row", (F.col("at") - F.col("left")).cast("int").alias("start"), (F.col("at") + k + F.col("right")).cast("int").alias("end"))
    spans = plain.unionByName(judged).distinct().groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = rows.join(spans, "row", "left").select("id", "__text", "starts", "ends")
    kind = joined.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tb.chunks(batches, "__text"):
            starts, ends = chunk.batch.column(2).to_pylist(), chunk.batch.column(3).to_pylist()
            n_removed, n_spans, hashes, kept = [], [], [], []
            for i in range(chunk.n):
                raw = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                removed = spans_ = 0
                if starts[i]:
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, np.array(starts[i]), 1)
                    np.add.at(change, np.array(ends[i]), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed = int(gone.sum())
                    spans_ = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
                    raw = raw[~gone]
                rest = raw.tobytes()
                n_removed.append(removed)
                n_spans.append(spans_)
                hashes.append(hashlib.sha256(rest).hexdigest())
                if cleaned:
                    kept.append(rest.decode("utf-8", "replace"))
            columns = [chunk.batch.column(0), pa.array(np.diff(chunk.offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(hashes, pa.string())]
            names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if cleaned:
                columns.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return tb.through_python(joined, cut, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if cleaned else "")), scratch

