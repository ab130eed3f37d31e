"""Secret scan: an Aho-Corasick prefilter, anchored expressions near its hits, embedded checksums.

One automaton pass over the lower-cased bytes of a chunk finds every keyword; an
expression is only tried at a hit, anchored there. Hexadecimal runs have no
keyword: their prefilter is the run length of the character class, taken in one vectorised pass.
Kinds with a checksum inside are only reported if it holds.

Base kinds (reported as spans of the whole match): assign, access, hex. Added kinds: github and npm
(six last characters are the base-62 CRC-32 of the body), jwt (the header decodes to
JSON with an alg), pem (private key blocks that end). A span is [start, end) in code points.

Results. Null and empty texts have no spans: counts 0, spans "", and the sha256 of "".
Repeated rows give equal rows; an empty table an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb

#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?!-----)[\x00-\xff])+-----END \1PRIVATE KEY-----")
#: Keyword (lower case) to the kind whose expression it starts.
KEYWORDS = {b"password": "assign", b"passwd": "assign", b"secret": "assign", b"token": "assign", b"apikey": "assign", b"api_key": "assign", b"akia": "access", b"ghp_": "github", b"gho_": "github", b"ghu_": "github", b"ghs_": "github", b"ghr_": "github", b"npm_": "npm", b"eyj": "jwt", b"-----begin ": "pem"}
LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, np.int8)
HEX[list(b"0123456789abcdef")] = 1


def crc_holds(token: bytes) -> bool:
    """True if the six last characters are the base-62 CRC-32 of what stands between prefix and them."""
    body, check = token[4:-6], token[-6:]
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = LETTERS[d : d + 1] + digits
    return digits == check


def header_holds(token: bytes) -> bool:
    head = token.split(b".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):  # a header nested too deep is none
        return False
    return isinstance(found, dict) and "alg" in found


EXPRESSIONS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (ACCESS, lambda m: len(m[0]) >= 18),
    "github": (GITHUB, lambda m: crc_holds(m[0])),
    "npm": (NPM, lambda m: crc_holds(m[0])),
    "jwt": (JWT, lambda m: header_holds(m[0])),
    "pem": (PEM, lambda m: True),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k.decode("ascii"), k)
    a.make_automaton()
    return a


def hex_runs(data: np.ndarray, offsets: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of [0-9a-f] of at least that length, each within one text."""
    inside = HEX[data]
    change = np.diff(inside, prepend=0, append=0) != 0
    if len(data):
        change[offsets] |= np.concatenate([inside, [0]])[offsets].astype(bool)
    edges = np.flatnonzero(change)
    if not len(edges):
        return edges, edges
    starts = edges[:-1]
    ends = edges[1:]
    good = (ends - starts >= least) & (inside[starts] == 1)
    return starts[good], ends[good]


def scan(chunk: tb.Chunk, keywords: ahocorasick.Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """(start byte in the chunk, kind number, end) of every secret, by text of the chunk."""
    data, offsets = chunk.data, chunk.offsets
    raw = data.tobytes()
    hits: dict[str, list[int]] = defaultdict(list)
    # Latin-1 makes a character of each byte, so positions are bytes.
    for end, word in keywords.iter(tb.LOWER[data].tobytes().decode("latin-1")):
        hits[KEYWORDS[word]].append(end - len(word) + 1)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for kind, places in hits.items():
        expression, holds = EXPRESSIONS[kind]
        k = KINDS.index(kind)
        places = sorted(places)
        texts = np.searchsorted(offsets, places, side="right") - 1
        free = 0
        for at, i in zip(places, texts.tolist()):
            if at < free:
                continue
            m = expression.match(raw, at, int(offsets[i + 1]))
            if m:
                free = m.end()
                if holds(m):
                    out[i].append((at, k, free))
    starts, ends = hex_runs(data, offsets)
    for i, a, b in zip((np.searchsorted(offsets, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
        out[i].append((a, KINDS.index("hex"), b))
    return out


def find_secrets(docs: DataFrame, *, text: str = "text", keep: list[str], redact: str | None = None) -> DataFrame:
    """Spans and counts of secrets in every whole text.

    Adds n_assign, n_access, n_hex, n_other (long), base_sha256, spans and, with redact, the column
    redacted: the text with every span replaced by that string (overlapping spans together).
    """
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = rows.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "n_assign bigint, n_access bigint, n_hex bigint, n_other bigint, base_sha256 string, spans string" + (", redacted string" if redact is not None else "")
    names = [f.name for f in fields] + ["n_assign", "n_access", "n_hex", "n_other", "base_sha256", "spans"] + (["redacted"] if redact is not None else [])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for chunk in tb.chunks(batches, "__text"):
            counts = np.zeros((4, chunk.n), np.int64)
            hashes, spans = [nothing] * chunk.n, [""] * chunk.n
            texts = chunk.batch.column(len(fields)).to_pylist() if redact is not None else []
            for i, found in scan(chunk, keywords).items():
                found.sort()
                start = int(chunk.offsets[i])
                own = chunk.data[start : chunk.offsets[i + 1]]
                points = np.zeros(len(own) + 1, np.int64)
                np.cumsum(~tb.CONTINUES[own], out=points[1:])
                named = [(k, f"{KINDS[k]}:{points[a - start]}:{points[b - start]}") for a, k, b in found]
                for k, _ in named:
                    counts[min(k, 3), i] += 1
                hashes[i] = hashlib.sha256(",".join(x for k, x in named if k < 3).encode()).hexdigest()
                spans[i] = ",".join(x for _, x in named)
                if redact is not None:
                    out, at, body = [], 0, own.tobytes()
                    for a, _, b in found:
                        if a - start >= at:
                            out += [body[at : a - start], redact.encode()]
                        at = max(at, b - start)
                    texts[i] = b"".join([*out, body[at:]]).decode("utf-8")
            columns = [chunk.batch.column(k) for k in range(len(fields))] + [pa.array(c) for c in counts] + [pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            if redact is not None:
                columns.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return tb.through_python(rows, run, schema)
