"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a unit of text exactly one token can be the last one of its
encoding. The table stores that token per prefix: an Aho-Corasick automaton over
the pieces names the pieces that end at the position, longest first, and a
candidate stands if it and the last token of what precedes it are a compatible
pair, that is, if merging their joined text gives back these two tokens. Reading the
table from the end backwards recovers the ids. The work is linear in the text, and no heap
of merges is kept.

Units. No piece holds U+2581 behind another character, so merges never cross the start of a
run of spaces; characters in no piece (newlines among them) never merge. Texts
split there exactly, and a unit's ids are remembered, since words repeat.
Pieces of spaces only share one score, so ties decide there, which the pair test does not cover:
runs are merged by the rule itself (best score, then leftmost) once for each length.

Results. A null text is an empty one: only the end id, decoded as "". NUL and
other control characters fall back to bytes like any unknown character.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb

SPACE = "▁"
#: Units remembered by one worker; the memory is emptied beyond that.
REMEMBERED = 200_000
PAIRS_REMEMBERED = 250_000
#: Of these, so many stay when a task ends.
KEPT_UNITS = 30_000
#: Longer units are not remembered.
LONG_UNIT = 64


class PrefixTableCodec:
    """Encodes and decodes like the library's processor for one BPE model with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and without normalisation are supported")
        self.pieces = [p.piece for p in spec.pieces]
        kinds = [p.type for p in spec.pieces]
        if {1, 2, 3, 6} < set(kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == 1}
        self.sizes = [len(p) for p in self.pieces]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.scores = [p.score for p in spec.pieces]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(kinds) if kind == 6}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, kind in enumerate(kinds) if kind == 3}
        self.texts = ["" if i in self.silent else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.end = next((i for i in self.silent if self.pieces[i] == "</s>"), spec.trainer_spec.eos_id)
        singles = {p for p in self.ids if len(p) == 1}
        if any(c not in singles for p in self.ids for c in p) or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a character that is no piece, or a space behind a character")
        if any(len(p) - len(p.lstrip(SPACE)) > 1 and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece holds several spaces before a character")
        self.known = singles
        self._automaton()
        self.compatible: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.runs: dict[int, tuple[int, ...]] = {}

    def _automaton(self) -> None:
        """Trie of the pieces with failure links; ends[s]: pieces that end in state s, longest first.

        moves[s] starts as the trie's own edges and is completed with failure moves when first needed.
        """
        self.moves: list[dict[str, int]] = [{}]
        own = [-1]
        for p, i in self.ids.items():
            if p.strip(SPACE) or p == SPACE:
                s = 0
                for c in p:
                    if c not in self.moves[s]:
                        self.moves[s][c] = len(self.moves)
                        self.moves.append({})
                        own.append(-1)
                    s = self.moves[s][c]
                own[s] = i
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        queue = [0]
        edges = [dict(m) for m in self.moves]
        for s in queue:
            for c, to in edges[s].items():
                if s:
                    f = self.fail[s]
                    while f and c not in edges[f]:
                        f = self.fail[f]
                    self.fail[to] = edges[f].get(c, 0)
                if own[to] >= 0:
                    self.ends[to] = ((own[to], len(self.pieces[own[to]])), *self.ends[self.fail[to]])
                else:
                    self.ends[to] = self.ends[self.fail[to]]
                queue.append(to)

    def _move(self, s: int, c: str) -> int:
        at = s
        while c not in self.moves[at] and at:
            at = self.fail[at]
        to = self.moves[at].get(c, 0)
        self.moves[s][c] = to
        return to

    def merged(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[int]:
        """The merging rule itself on text: best score first, then leftmost. steps: gets the merges in order."""
        symbols: list[str] = list(text)
        left = list(range(-1, len(symbols) - 1))
        right = [*range(1, len(symbols)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, len(symbols[a]) + len(symbols[b])))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size or right[a] != b:
                continue
            if steps is not None:
                steps.append((symbols[a], symbols[b]))
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids[s] for s in symbols if s]

    def reachable(self, token: int) -> bool:
        """True if merging the token's own text gives the token; notes which two parts merge last."""
        known = self.whole.get(token)
        if known is None:
            steps: list[tuple[str, str]] = []
            known = self.whole[token] = self.merged(self.pieces[token], steps) == [token]
            if steps:
                self.parts[token] = (self.ids[steps[-1][0]], self.ids[steps[-1][1]])
        return known

    def pair(self, before: int, last: int) -> bool:
        """True if both tokens stay as they are when they stand side by side.

        The merges of both are undone, latest first; at each state the two parts
        that touch must not have a merge of their own that comes before the one just undone.
        A merge on the left wins a tie, so the joint merge beats an equal one inside last and loses to one inside before.
        """
        scores, ids, pieces, parts = self.scores, self.ids, self.pieces, self.parts
        a, b = before, last
        limit, ties = float("inf"), True
        while True:
            joint = ids.get(pieces[a] + pieces[b])
            if joint is not None and (-scores[joint] < limit or ties and -scores[joint] == limit):
                return False
            if not self.reachable(a) or not self.reachable(b):
                return False
            ra = -scores[a] if a in parts else None
            rb = -scores[b] if b in parts else None
            if ra is None and rb is None:
                return True
            if rb is None or ra is not None and ra > rb:
                limit, ties, a = ra, False, parts[a][1]
            else:
                limit, ties, b = rb, True, parts[b][0]

    def table(self, text: str) -> list[int]:
        """Ids of a run of known characters that starts with at most one space sign."""
        lasts: list[int] = []
        add, s, moves, ends, compatible = lasts.append, 0, self.moves, self.ends, self.compatible
        end = 0
        for c in text:
            end += 1
            to = moves[s].get(c)
            s = to if to is not None else self._move(s, c)
            for token, size in ends[s]:
                if size < end:
                    before = lasts[end - size - 1]
                    fits = compatible.get(before << 20 | token)
                    if fits is None:
                        fits = self._remember(before, token)
                else:
                    fits = self.reachable(token)
                if fits:
                    add(token)
                    break
            else:
                raise AssertionError(f"no token ends prefix {end} of {text!r}")
        out, sizes = [], self.sizes
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out

    def _remember(self, before: int, token: int) -> bool:
        if len(self.compatible) >= PAIRS_REMEMBERED:
            self.compatible.clear()
        fits = self.compatible[before << 20 | token] = self.pair(before, token)
        return fits

    def run(self, n: int) -> tuple[int, ...]:
        """Ids of n space signs."""
        if n not in self.runs:
            self.runs[n] = tuple(self.merged(SPACE * n))
        return self.runs[n]

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of one unit: space signs, then characters without any."""
        word = text.lstrip(SPACE)
        spaces = len(text) - len(word)
        if spaces <= 1 and self.known.issuperset(word):
            return tuple(self.table(text)) if word else self.run(spaces)
        out: list[int] = []
        first = True
        for part in self._parts(word) if word else ():
            lead = SPACE if first and spaces else ""
            if part[0] not in self.known:
                out += self.run(spaces) if first else ()
                out += [self.byte_ids[b] for b in part.encode("utf-8")]
            else:
                own = self.table(lead + part)
                if lead and self.pieces[own[0]] == SPACE:
                    out += self.run(spaces)
                    own = own[1:]
                elif lead:
                    out += self.run(spaces - 1) if spaces > 1 else ()
                out += own
            first = False
        return tuple(out) if word else self.run(spaces)

    def _parts(self, word: str) -> Iterator[str]:
        """Runs of known characters, and unknown characters one by one."""
        start = 0
        for k, c in enumerate(word):
            if c not in self.known:
                if k > start:
                    yield word[start:k]
                yield c
                start = k + 1
        if start < len(word):
            yield word[start:]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return _UNIT.findall((SPACE + text).replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        """All ids of text with the end id."""
        out: list[int] = []
        for u in self.units(text):
            out += self.unit(u)
        out.append(self.end)
        return out

    def pieces_text(self, ids: tuple[int, ...]) -> str:
        """Text of ids before the first space goes: pieces, bytes as UTF-8 (invalid ones as U+FFFD)."""
        if self.bytes_of.keys().isdisjoint(ids):
            return "".join([self.texts[i] for i in ids])
        out: list[str] = []
        waiting = bytearray()
        for i in ids:
            if i in self.bytes_of:
                waiting.append(self.bytes_of[i])
                continue
            if waiting:
                out.append(_decode_bytes(bytes(waiting)))
                waiting.clear()
            if i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        if waiting:
            out.append(_decode_bytes(bytes(waiting)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Like the library's decode: one space is dropped at the start."""
        text = self.pieces_text(tuple(ids))
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def _decode_bytes(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is part of no valid character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


class _Digest:
    """Remembers a unit's ids as text and the text decoded from them, so that common words cost one lookup.

    When the memory is full it becomes the old one, from which a unit that returns is taken back.
    """

    def __init__(self, codec: PrefixTableCodec):
        self.codec = codec
        self.memory: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def of(self, unit: str) -> tuple[str, int, str]:
        found = self.old.get(unit)
        if found is None:
            codec = self.codec
            ids = codec.unit(unit)
            found = (" ".join([codec.names[i] for i in ids]), len(ids), codec.pieces_text(ids))
            if len(unit) > LONG_UNIT:
                return found
        if len(self.memory) >= REMEMBERED:
            self.old, self.memory = self.memory, {}
        self.memory[unit] = found
        return found

    def forget(self) -> None:
        """Keeps the units that were met first, which are mostly common words, and drops the others."""
        self.memory, self.old = dict(itertools.islice(self.memory.items(), KEPT_UNITS)), {}

    def text(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids as text, sha256 of the decoded text."""
        of, get = self.of, self.memory.get
        got = [get(u) or of(u) for u in self.codec.units(text)]
        n = sum(x[1] for x in got) + 1
        ids = hashlib.sha256(" ".join([*(x[0] for x in got), str(self.codec.end)]).encode()).hexdigest()
        # The first unit starts with the space that encoding put before the text.
        decoded = "".join([x[2] for x in got])[1:]
        return n, ids, hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=1)
def _digest(model: bytes) -> _Digest:
    """One for each Python worker: tasks that follow find the automaton; most of what a task remembers goes with it."""
    return _Digest(PrefixTableCodec(model))


def encode_decode(docs: DataFrame, model: bytes, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns the kept columns, n_tokens long, ids_sha256 and decoded_sha256, and with
    ids the token ids and the decoded text themselves. model holds the bytes of the model file (about half a MB,
    sent with the task). One row out for each row in, repeated rows too; null text counts as empty;
    an empty table gives an empty result.
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    extra = ", ids array<int>, decoded string" if ids else ""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + extra

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digest(model)
        codec = digest.codec
        try:
            for batch in batches:
                texts = batch.column(len(fields))
                for first in range(0, batch.num_rows, 512):
                    part = texts.slice(first, 512).to_pylist()
                    got = [digest.text(t or "") for t in part]
                    columns = [batch.column(k).slice(first, 512) for k in range(len(fields))]
                    columns += [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
                    names = [f.name for f in fields] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                    if ids:
                        each = [codec.encode(t or "") for t in part]
                        columns += [pa.array(each, pa.list_(pa.int32())), pa.array([codec.decode(e) for e in each], pa.string())]
                        names += ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            # Workers live on for the stages that follow, which need their memory.
            digest.forget()

    return tb.through_python(rows, run, schema)
