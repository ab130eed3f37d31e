"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at whole-text statistics and votes good (1), bad (0) or abstains (-1).
The rules' accuracies are learnt without labels: the vote vectors of all documents are
counted (at most 3 to the number of rules different ones, however many
documents there are), and expectation-maximisation fits, for the two hidden classes, a
prior and each rule's chances of its three outcomes. A document is kept if
its posterior probability of the good class reaches the threshold.

Results. A null text has no words and counts as empty; an empty text fails the base test.
Repeated rows have equal results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm import textbatch as tb
from tidegraph.llm.store import Scratch

SYMBOLS = b"#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = "the of and to in is that for it was on with as by at this be are from or an not have a de la le et les des en un une que est pour dans du par sur qui au avec ce il pas ne plus der die das und ist von mit den zu im nicht ein eine auf für dem des sich auch als el y los del las por con para su al lo como más se".split()
#: name: (statistic, bad if, good if); each test is (operator, bound). Between the two bounds the rule abstains.
RULES: dict[str, tuple[str, tuple[str, float], tuple[str, float]]] = {
    "symbols": ("symbols_per_word", (">", 0.10), ("<", 0.02)),
    "shouting": ("upper_share", (">", 0.30), ("<", 0.12)),
    "repeated_lines": ("dup_line_share", (">", 0.30), ("<", 0.05)),
    "repeated_words": ("repeat_share", (">", 0.30), ("<", 0.10)),
    "exclamations": ("exclaim_per_word", (">", 0.10), ("<", 0.02)),
    "digits": ("digit_share", (">", 0.20), ("<", 0.05)),
    "word_length": ("word_length", (">", 10.0), ("<", 7.5)),
    "length": ("n_words", ("<", 50), (">", 80)),
    "function_words": ("function_share", ("<", 0.04), (">", 0.12)),
}
ROUNDS = 50
THRESHOLD = 0.5


def _function_codes() -> np.ndarray:
    codes = []
    for w in FUNCTION_WORDS:
        raw = np.frombuffer(w.encode(), np.uint8)
        codes.append(tb.SpanHash(raw, lower=True).of(np.array([0]), np.array([len(raw)]))[0])
    return np.unique(np.array(codes, np.uint64))


def statistics(chunk: tb.Chunk) -> dict[str, np.ndarray]:
    """Counts of each text of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    starts, ends, own = tb.words(chunk)
    codes = tb.SpanHash(data).of(starts, ends)
    lower = tb.SpanHash(data, lower=True).of(starts, ends)
    text_of = tb.owner(own)
    count = lambda table: tb.per_text(table[data], offsets)

    def members(these: bytes) -> np.ndarray:
        t = np.zeros(256, np.int8)
        t[list(these)] = 1
        return t

    points = np.zeros(256, np.int8)
    points[~tb.CONTINUES & ~tb.SPACE] = 1
    out = {
        "n_words": np.diff(own),
        "word_chars": count(points),
        "n_symbols": count(members(SYMBOLS)),
        "n_upper": count(members(bytes(range(65, 91)))),
        "n_letters": count(members(bytes([*range(65, 91), *range(97, 123)]))),
        "n_digits": count(members(b"0123456789")),
        "n_exclaims": count(members(b"!")),
    }
    # Lines that equal an earlier one: sorted by text and hash, all but the first of a run.
    breaks = np.flatnonzero(data == 10)
    at = np.concatenate([offsets[:-1], breaks + 1])
    to = np.concatenate([breaks, offsets[1:]])
    line_start, line_end = np.sort(at, kind="stable"), np.sort(to, kind="stable")
    line_of = np.searchsorted(offsets, line_start, side="right") - 1
    # An empty text starts where the next one does; only its own lines may count, and it has none with a word.
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_of = line_start[has_word], line_end[has_word], line_of[has_word]
    keys = tb.mix(tb.SpanHash(data).of(line_start, line_end) + tb.mix(line_of.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_lines"] = np.bincount(line_of, minlength=chunk.n)
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=chunk.n)
    # Words in three-word windows that occur again in the text.
    grams, own3 = tb.windows(codes, own, 3)
    keys = tb.mix(grams + tb.mix(tb.owner(own3).astype(np.uint64)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    marked = np.zeros(len(codes) + 1, bool)
    if len(twice):
        hits = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
        first = np.flatnonzero(hits) + np.repeat(own[:-1] - own3[:-1], np.diff(own3))[hits]
        for k in range(3):
            marked[first + k] = True
    out["n_repeat_words"] = tb.per_text(marked[:-1], own)
    table = _function_codes()
    known = table[np.minimum(np.searchsorted(table, lower), len(table) - 1)] == lower if len(lower) else np.zeros(0, bool)
    out["n_function"] = np.bincount(text_of[known], minlength=chunk.n)
    return out


def ratios(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The statistics that rules look at."""
    share = lambda a, b: s[a] / np.maximum(s[b], 1)
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "exclaim_per_word": share("n_exclaims", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
        "word_length": share("word_chars", "n_words"),
        "n_words": s["n_words"],
        "function_share": share("n_function", "n_words"),
    }


def votes(r: dict[str, np.ndarray]) -> np.ndarray:
    """Vote vectors, a row for each text: 1 good, 0 bad, -1 abstains."""
    test = {">": np.greater, "<": np.less}
    out = []
    for statistic, (bad_op, bad), (good_op, good) in RULES.values():
        x = r[statistic]
        out.append(np.where(test[bad_op](x, bad), 0, np.where(test[good_op](x, good), 1, -1)))
    return np.stack(out, 1).astype(np.int8)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior of the good class and chances [class, rule, outcome], from counted vote vectors.

    Outcomes are 0 bad, 1 good, 2 abstains. The start is a share of good votes in which, by hand, a bad vote weighs four
    times a good one; it only decides which of the two hidden classes is the good one and where the rounds begin. A
    small count is added everywhere, so that no chance is 0.
    """
    n_rules = patterns.shape[1]
    kinds = np.where(patterns < 0, 2, patterns)
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    # A rule that finds a fault says more than one that finds none.
    posterior = np.clip((good + 1) / (good + 4 * bad + 2), 0.02, 0.98)
    prior, chances = 0.5, np.full((2, n_rules, 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in enumerate(((1 - posterior) * counts, posterior * counts)):
            for k in range(3):
                chances[c, :, k] = (weight[:, None] * (kinds == k)).sum(0) + 0.5
            chances[c] /= chances[c].sum(1, keepdims=True)
        prior = float(np.clip(((posterior * counts).sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        posterior = score(prior, chances, patterns)
    return prior, chances


def score(prior: float, chances: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Posterior probability of the good class of each vote vector."""
    kinds = np.where(patterns < 0, 2, patterns)
    each = np.log(chances[:, np.arange(patterns.shape[1]), kinds]).sum(2)
    odds = np.log(prior) - np.log1p(-prior) + each[1] - each[0]
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = rows.schema.fields[:-1]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, pattern bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tb.chunks(batches, "__text"):
            s = statistics(chunk)
            v = votes(ratios(s)).astype(np.int64) + 1
            pattern = v @ (3 ** np.arange(v.shape[1], dtype=np.int64))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            columns = [chunk.batch.column(k) for k in range(len(fields))]
            columns += [pa.array(s[c].astype(np.int64)) for c in COUNTS] + [pa.array(failed), pa.array(pattern)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields] + [*COUNTS, "base_failed", "pattern"])

    return tb.through_python(rows, run, schema)


def quality(docs: DataFrame, *, text: str = "text", keep: list[str], threshold: float = THRESHOLD, twice: bool = False) -> DataFrame:
    """Base counts, base verdict, posterior and kept flag of every document.

    One pass over the texts: counts and votes are written with the kept columns, and what was learnt of all votes is
    applied to that table. With twice, which suits a kept text, the texts are read twice instead and nothing is
    written. Only the counts of the different vote vectors come to the driver (3**9 at most).
    """
    measured = _measured(docs, text, keep) if twice else Scratch(docs.sparkSession, "rules").keep(_measured(docs, text, keep), "measured")
    counted = (_measured(docs, text, []) if twice else measured).groupBy("pattern").count().collect()
    n_rules = len(RULES)
    codes = np.array([r["pattern"] for r in counted], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(n_rules, dtype=np.int64)) % 3 - 1
    prior, chances = fit(patterns, np.array([r["count"] for r in counted], float)) if counted else (0.5, np.full((2, n_rules, 3), 1 / 3))
    # The posterior is a sum over the rules: a constant array for each, looked up by the vote.
    gains = np.log(chances[1]) - np.log(chances[0])
    odds = F.lit(float(np.log(prior) - np.log1p(-prior)))
    for k in range(n_rules):
        vote = (F.col("pattern") / 3**k).cast("bigint") % 3
        abstain, bad, good = (float(gains[k, j]) for j in (2, 0, 1))
        odds = odds + F.when(vote == 0, abstain).when(vote == 1, bad).otherwise(good)
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return measured.withColumn("quality_posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("quality_posterior") >= threshold)).drop("pattern")
