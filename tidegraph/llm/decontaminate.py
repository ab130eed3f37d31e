"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts are normalised (lower case, runs of white space as one space). The windows of a benchmark item are all its passages
of 48 and of 96 characters, at every offset; an item that is no longer is one window. A window of m characters and a text
passage within e edits share q-grams at no less than m + 1 - q - q * e places of the window, all on diagonals that differ
by at most e from the passage's own. So:
1. all q-grams of a chunk of texts are hashed at once and looked up among those of the items;
2. hits are sorted by item, diagonal band and place in the item; bands overlap by half, so every passage lies wholly in one;
3. windows that hold their bound of places are verified by banded alignment (edit distance of
   the window to the best passage of the band), many at a time.
A text is contaminated by an item if a window of it is found within its budget: 2 edits in 48 characters, 5 in 96.

An item of under Q normalised characters has no q-gram; it is found where it is a whole line of a text.

The benchmark goes to the executors in blocks of at most about BLOCK_CHARS characters (40 bytes of index each, some 45 MB),
so a larger one takes more passes and no more memory. Longer items are cut into overlapping pieces, each
with its own rows in the result. A block's items are looked up in parts, and hits are gathered over stretches of text of
about HITS hits, so that a q-gram of very many items does not multiply a long text.

Results. One row for each contaminated row of docs and item; a clean text has none. Null and empty texts are
clean; null and empty items are never found. Repeated rows give repeated results. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb

Q = 12
#: Short windows find excerpts; long ones have room for edits that lie close together.
WINDOWS = (96, 48)
BUDGET = 0.06
BLOCK_CHARS = 1 << 20
#: Items of one part of a block hold about so many characters.
PART_CHARS = 1 << 17
#: Pieces of longer items, and by how much they overlap.
PIECE_CHARS, PIECE_OVERLAP = 1 << 17, 1024
HITS = 1 << 20
FILTER_BITS = 21
U = np.uint64
#: Stands between texts; no character has this code.
BREAK = 0x110000


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower case of each code point where that is one code point, and a space for white space."""
    out = np.arange(BREAK + 1, dtype=np.uint32)
    for c in range(0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        low = s.lower()
        out[c] = 32 if s.isspace() else ord(low) if len(low) == 1 else c
    return out


def normalise(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded codes with runs of spaces collapsed, and the place of each in the input."""
    folded = _fold()[codes]
    space = folded == 32
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return folded[at], at


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all Q-grams (12 = 8 + 4), by doubling."""
    base = 0x9E3779B97F4A7C15
    h = tb.mix(codes.astype(U) + U(1))
    size, parts = 1, {1: h}
    while size * 2 <= Q:
        h = h[: len(h) - size] * U(pow(base, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
        parts[size] = h
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    out, at = np.zeros(n, U), 0
    for size in sorted(parts, reverse=True):
        if at + size <= Q:
            out = out * U(pow(base, size, 1 << 64)) + parts[size][at : at + n]
            at += size
    return tb.mix(out)


@dataclass
class Index:
    """Items of one block of the benchmark and where each q-gram stands in them."""

    items: np.ndarray  # numbers of the items that have q-grams
    codes: np.ndarray  # these items, one after the other
    starts: np.ndarray  # place of each item in codes
    lengths: np.ndarray
    grams: np.ndarray  # sorted different hashes
    offsets: np.ndarray  # of each gram's entries
    entry_item: np.ndarray
    entry_at: np.ndarray
    filter: np.ndarray


@dataclass
class Block:
    """Indices of the parts of a block, and its items without q-grams by their normalised text."""

    parts: list[Index]
    short: dict[str, list[int]]


def build(texts: list[str]) -> Block:
    """The block of items that are numbered as in texts."""
    parts, short = [], {}
    items, rows, held = [], [], 0
    for i, text in enumerate(texts):
        codes, _ = normalise(codes_of(text.strip()))
        if len(codes) >= Q:
            items.append(i)
            rows.append(codes)
            held += len(codes)
        elif len(codes):
            short.setdefault(codes.tobytes().decode("utf-32-le", "surrogatepass"), []).append(i)
        if held >= PART_CHARS:
            parts.append(_index(items, rows))
            items, rows, held = [], [], 0
    if rows:
        parts.append(_index(items, rows))
    return Block(parts, short)


def _index(items: list[int], rows: list[np.ndarray]) -> Index:
    lengths = np.array([len(r) for r in rows], np.int64)
    grams = [gram_hashes(r) for r in rows]
    hashes = np.concatenate(grams)
    own = np.repeat(np.arange(len(rows)), [len(g) for g in grams]).astype(np.int64)
    place = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(hashes, kind="stable")
    different, first = np.unique(hashes[order], return_index=True)
    table = np.zeros(1 << FILTER_BITS, bool)
    table[(different >> U(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(
        np.array(items, np.int64), np.concatenate(rows), np.cumsum(lengths) - lengths, lengths,
        different, np.append(first, len(hashes)), own[order], place[order], table,
    )


def budgets(lengths: np.ndarray) -> np.ndarray:
    """Edits allowed in windows; fewer where the lemma would ask for no shared q-gram at all."""
    return np.minimum((lengths * BUDGET).astype(np.int64), (lengths - Q) // Q)


def candidates(key: np.ndarray, x: np.ndarray, length: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hit and start of every window that holds its bound of places, each window of a key once.

    Hits are places x of q-grams, sorted by key and x and different; size is that of the windows, length the item's.
    """
    bound = size + 1 - Q - Q * budgets(size)
    i = np.arange(len(x))
    j = np.minimum(i + bound - 1, len(x) - 1)
    full = (i + bound <= len(x)) & (key[j] == key) & (x[j] - x <= size - Q)
    low, high = np.maximum(x[j] - (size - Q), 0), np.minimum(x, length - size)
    # Windows that start no later than the hit before are that hit's.
    low[1:] = np.where(key[1:] == key[:-1], np.maximum(low[1:], x[:-1] + 1), low[1:])
    n = np.where(full, np.maximum(high - low + 1, 0), 0)
    hit = np.repeat(i, n)
    return hit, low[hit] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def align(windows: np.ndarray, lengths: np.ndarray, text: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window to a passage that starts in text[at : at + width], and where that passage ends.

    Row i of the banded matrix holds, for each diagonal of the band, the edits of the first i characters.
    A free start is a zero first row. Insertions within a row become a running minimum.
    """
    n = len(windows)
    diagonals = np.arange(width)
    cost = np.zeros((n, width), np.int32)
    best, where = np.full(n, 1 << 20, np.int32), np.zeros(n, np.int64)
    for i in range(int(lengths.max()) if n else 0):
        place = at[:, None] + diagonals + i
        same = text[np.clip(place, 0, len(text) - 1)] == windows[:, i, None]
        same &= (place >= 0) & (place < len(text))
        step = cost + ~same
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - diagonals, axis=1) + diagonals
        ending = lengths == i + 1
        if ending.any():
            k = cost[ending].argmin(1)
            best[ending] = cost[ending][np.arange(len(k)), k]
            where[ending] = at[ending] + k + i + 1
    return best, where


def search(chunk_texts: list[str], block: Block) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, windows found, least edits, start, end) in original characters, for each contaminated text and item."""
    raw = codes_of("\x00".join(chunk_texts)).copy()
    sizes = np.array([len(t) for t in chunk_texts], np.int64)
    first = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=first[1:])
    raw[first[1:-1] - 1] = BREAK
    codes, at = normalise(raw)
    hashes = gram_hashes(codes)
    out = _short_lines(chunk_texts, block.short) if block.short else []
    for index in block.parts:
        places = np.flatnonzero(index.filter[(hashes >> U(64 - FILTER_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(index.grams, hashes[places]), len(index.grams) - 1)
        real = index.grams[k] == hashes[places]
        places, k = places[real], k[real]
        found = [_matches(index, codes, at, first, places[a:b], k[a:b]) for a, b in _stretches(places, index.offsets[k + 1] - index.offsets[k])]
        out += _merged(index, found)
    return sorted(out)


def _stretches(places: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of hit places of about HITS hits; neighbours overlap by what a window and its edits can span."""
    reach = 2 * max(WINDOWS)
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    a = 0
    while a < len(places):
        b = max(int(np.searchsorted(total, total[a] + HITS, side="right")) - 1, int(np.searchsorted(places, places[a] + 2 * reach)))
        b = min(max(b, a + 1), len(places))
        yield a, b
        if b == len(places):
            return
        a = int(np.searchsorted(places, places[b] - reach))


def _short_lines(texts: list[str], short: dict[str, list[int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of items without q-grams: the first line of a text that equals them."""
    out = []
    for t, text in enumerate(texts):
        at, seen = 0, set()
        for line in text.split("\n"):
            body = line.strip()
            if body:
                codes, _ = normalise(codes_of(body))
                key = codes.tobytes().decode("utf-32-le", "surrogatepass") if len(codes) < Q else ""
                if key in short and key not in seen:
                    seen.add(key)
                    start = at + line.index(body)
                    out += [(t, i, 1, 0, start, start + len(body)) for i in short[key]]
            at += len(line) + 1
    return out


def _matches(index: Index, codes: np.ndarray, at: np.ndarray, first: np.ndarray, places: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Rows (text, item, window, edits, start, end), as columns, of the windows found at hit places; k: their q-grams."""
    counts = index.offsets[k + 1] - index.offsets[k]
    entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(index.offsets[k], counts)
    item, x = index.entry_item[entry], index.entry_at[entry]
    diagonal = np.repeat(places, counts) - x
    # Bands of two strides each, a stride apart; a stride holds the diagonals of any passage within budget.
    margin = int(budgets(np.minimum(index.lengths, max(WINDOWS))).max())
    stride = 2 * margin + 1
    band = np.floor_divide(diagonal, stride)
    keys, key, hits = np.unique(np.concatenate([item * (1 << 40) + band + (1 << 38), item * (1 << 40) + band + (1 << 38) - 1]), return_inverse=True, return_counts=True)
    sizes_of = [np.minimum(index.lengths, w) for w in WINDOWS]
    least = np.min([n + 1 - Q - Q * budgets(n) for n in sizes_of], axis=0)
    enough = (hits >= least[keys >> 40])[key]
    longest = int(index.lengths.max())
    pairs = np.unique(key[enough] * longest + np.concatenate([x, x])[enough])
    key, x = pairs // longest, pairs % longest
    item, band = keys[key] >> 40, (keys[key] & ((1 << 40) - 1)) - (1 << 38)
    found_rows = []
    for kind, (w, sizes_) in enumerate(zip(WINDOWS, sizes_of)):
        # An item that is no longer than a window has one, which the first kind holds.
        use = np.flatnonzero((kind == 0) | (index.lengths[item] > w))
        hit, start = candidates(key[use], x[use], index.lengths[item[use]], sizes_[item[use]])
        hit = use[hit]
        for s in range(0, len(hit), 4096):
            h, p = hit[s : s + 4096], start[s : s + 4096]
            it = item[h]
            n, place = sizes_[it], index.starts[it] + p
            rows = index.codes[np.minimum(place[:, None] + np.arange(int(n.max())), len(index.codes) - 1)]
            edits, end = align(rows, n, codes, band[h] * stride - margin + p, 2 * stride + 2 * margin)
            good = edits <= budgets(n)
            begin = at[np.maximum(end[good] - n[good], 0)]
            stop = at[np.minimum(end[good], len(at)) - 1] + 1
            text = np.searchsorted(first, (begin + stop) // 2, side="right") - 1
            found_rows.append(np.stack([text, it[good], place[good] * len(WINDOWS) + kind, edits[good], np.maximum(begin - first[text], 0), stop - first[text]]))
    return np.concatenate(found_rows, axis=1) if found_rows else np.zeros((6, 0), np.int64)


def _merged(index: Index, found: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
    """One row for each text and item; a window that two stretches found counts once."""
    got = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
    if not got.shape[1]:
        return []
    got = got[:, np.lexsort(got[2::-1])]
    new = np.ones(got.shape[1], bool)
    new[1:] = (got[:2, 1:] != got[:2, :-1]).any(0)
    other = new.copy()
    other[1:] |= got[2, 1:] != got[2, :-1]
    group = np.flatnonzero(new)
    columns = [got[0, group], got[1, group], np.add.reduceat(other.astype(np.int64), group), np.minimum.reduceat(got[3], group), np.minimum.reduceat(got[4], group), np.maximum.reduceat(got[5], group)]
    columns[1] = index.items[columns[1]]
    return list(zip(*(c.tolist() for c in columns)))


def blocks(benchmark: DataFrame, item: str, text: str, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Items and texts of the benchmark, block by block; a block holds about block_chars characters."""
    whole = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("__whole"))
    places = F.sequence(F.lit(1), F.greatest(F.length("__whole") - PIECE_OVERLAP, F.lit(1)), F.lit(PIECE_CHARS))
    rows = whole.select("item", "__whole", F.explode(places).alias("at")).select("item", F.substring("__whole", F.col("at"), F.lit(PIECE_CHARS + PIECE_OVERLAP)).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        got = sorted(((r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()), key=str)
        yield [r[0] for r in got], [r[1] for r in got]


def _texts(chunk: tb.Chunk) -> list[str]:
    data = chunk.data.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist())]


def leaks(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The kept columns and item_id, n_windows, edits, start, end for each contaminated document and item."""
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = rows.schema.fields[:-1]
    kind = benchmark.schema[item].dataType
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"item_id {kind.simpleString()}, n_windows bigint, edits bigint, start bigint, end bigint"
    out = None
    for ids, texts in blocks(benchmark, item, item_text, block_chars):
        shared = spark.sparkContext.broadcast((ids, build(texts)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for chunk in tb.chunks(batches, "__text"):
                found = search(_texts(chunk), index)
                if found:
                    take = pa.array([f[0] for f in found], pa.int64())
                    columns = [chunk.batch.column(k).take(take) for k in range(len(fields))]
                    columns += [pa.array([ids[f[1]] for f in found])] + [pa.array([f[k] for f in found], pa.int64()) for k in range(2, 6)]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + ["item_id", "n_windows", "edits", "start", "end"])

        part = tb.through_python(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the contaminated rows, in one pass for each block of the benchmark; no column or row is changed."""
    spark, out = docs.sparkSession, docs
    for _, texts in blocks(benchmark, item, item_text, block_chars):
        shared = spark.sparkContext.broadcast(build(texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for chunk in tb.chunks(batches, text):
                stay = np.ones(chunk.n, bool)
                stay[[f[0] for f in search(_texts(chunk), shared.value)]] = False
                yield chunk.batch.filter(pa.array(stay))

        out = tb.through_python(out, run, out.schema)
    return out
