"""Scalar text functions as column expressions (JVM side); names in brackets are the blueprint's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, though body names it often (inside lambdas a value would be worked out for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def short_hash(x: Column, n: int) -> Column:
    """First n characters of the unpadded url-safe base64 of a sha256."""
    return F.substring(F.translate(F.rtrim(F.base64(F.unhex(F.sha2(x.cast("binary"), 256))), F.lit("=")), "+/", "-_"), 1, n)


def count_of(x: Column, chars: str) -> Column:
    """Number of characters of x that are among chars."""
    return F.length(x) - F.length(F.translate(x, chars, ""))


def n_tokens(x: Column) -> Column:
    """Pieces between single spaces."""
    return F.size(F.split(x, " "))


def special_ratio(x: Column) -> Column:
    """Braces and pipes by token."""
    return count_of(x, "{}|") / n_tokens(x)


def star_groups(x: Column) -> Column:
    """Runs of stars."""
    return F.size(F.regexp_extract_all(x, F.lit(r"\*+"), F.lit(0)))


def line_noise_ok(x: Column) -> Column:
    """The passage after its title is text, not a bare list or template remains."""
    body = F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1))
    title, low = F.lower(F.trim(F.substring_index(x, ":", 1))), F.lower(body)
    words, marks, stars = n_tokens(body), count_of(body, "|:"), star_groups(x)
    see_also = low.startswith("==see also==") | low.startswith("== see also ==")
    cast = low.contains("==cast==") | low.contains("== cast ==")
    dense = (marks > 0) & (words < 3 * marks)
    return F.when(dense, False).when(stars > 1, title.contains("list of") | cast | (words >= stars)).otherwise(~(see_also & (words < 2)))


#: A word character: letters and digits of all scripts, and the underscore.
WORD = r"[\p{L}\p{N}_]"


def tokens2(x: Column) -> Column:
    """Distinct lower-case tokens of two or more word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(WORD + "{2,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two token arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the sum of lengths; 0 if both are empty."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, F.levenshtein(a, b) / total).otherwise(F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter length over longer."""
    return F.try_divide(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def prefix_edit(a: Column, b: Column, n: int) -> Column:
    """Edit distance of the first n characters."""
    return F.levenshtein(F.left(a, F.lit(n)), F.left(b, F.lit(n)))


def words(x: Column) -> Column:
    """All lower-case word runs in order."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD + "+"), F.lit(0))


def max_gram_count(w: Column, n: int = 3) -> Column:
    """How often the commonest n-gram of an array of words occurs: longest run in the sorted n-grams."""
    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), "\u0001"))

    return let(w, lambda v: F.when(F.size(v) >= n, longest_run(F.sort_array(grams(v)))).otherwise(F.lit(0)))


def longest_run(tokens: Column) -> Column:
    """Length of the longest run of one value in an array (W3); 0 if empty."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, t: Column) -> Column:
        run = F.when(s["last"] == t, s["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(tokens, start, step, lambda s: s["best"])


def raw_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))


def degenerate_flags(x: Column) -> Column:
    """Array of flags of degenerate model output (X6), in a fixed order; [empty] alone for null or blank text."""
    def flags(x: Column, w: Column) -> Column:
        n, unique, head = F.size(w), F.size(F.array_distinct(w)), F.upper(F.left(F.trim(x), F.lit(60)))
        low = (n >= 4) & (unique < n * 0.30)
        gram = (n >= 6) & (max_gram_count(w) > 5)
        run = longest_run(raw_tokens(x)) > 4
        punct = x.rlike(r"([^\p{L}\p{N}_\s])\1{7,}")
        long_ = (n > 600) & (n <= 1900)
        first = F.array(F.when(n < 3, F.lit("very_few_words")), F.when(head.contains("YES") & head.contains("NO"), F.lit("contradiction")))
        loops = F.array(F.when(low, F.lit("low_unique_ratio")), F.when(gram, F.lit("repeated_ngram")), F.when(run, F.lit("repeated_token")), F.when(punct, F.lit("repeated_punct")))
        late = let(F.array_compact(loops), lambda found: F.concat(found, F.array_compact(F.array(F.when(n > 1900, F.lit("truncation")), F.when(long_ & (F.size(found) == 0), F.lit("very_long"))))))
        return F.concat(F.array_compact(first), late)

    return F.when(x.isNull() | (F.trim(x) == ""), F.array(F.lit("empty"))).otherwise(let(words(x), lambda w: flags(x, w)))


def clean_wikitext(x: Column) -> Column:
    """Comments, references, tables' markers, files, bold and simple templates out; links to their text.

    Templates are removed innermost first, three levels deep; deeper ones need strip_balanced.
    """
    for pattern, to in (
        (r"(?s)<!--.*?-->", ""), (r"(?s)<ref[^>/]*/>", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"(?i)\{\{(?:lang|nowrap|small)\|(?:[a-z-]+\|)?([^{}|]*)\}\}", "$1"),
        *[(r"\{\{[^{}]*\}\}", "")] * 3, (r"\[\[(?:File|Image|Category|Wiktionary):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", ""),
        (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), (r"\[\[([^\[\]]*)\]\]", "$1"), (r"\[https?://\S+ ([^\]]*)\]", "$1"), (r"'{2,}", ""), (r"</?[a-zA-Z][^>]*>", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.trim(x)


def is_skipped_paragraph(x: Column) -> Column:
    """Paragraphs that are a template or a file, image, category or wiktionary line."""
    return F.trim(x).rlike(r"^(\{\{|\[*(File|Image|Category|Wiktionary):)")


def links(x: Column) -> Column:
    """Array of (target, text) of wiki links (X12, pairs)."""
    inner = F.regexp_extract_all(x, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    return F.transform(inner, lambda i: F.struct(F.substring_index(i, "|", 1).alias("target"), F.regexp_replace(i, r"^[^|]*\|", "").alias("text")))


def context(x: Column, mention: Column, n: int) -> Column:
    """Up to n tokens on both sides of the first occurrence of a mention (X13); null without one."""
    at = F.position(mention, x)
    before = F.split(F.trim(F.left(x, at - 1)), " ")
    after = F.split(F.trim(F.substr(x, at + F.length(mention))), " ")
    left = F.slice(before, F.greatest(F.size(before) - n + 1, F.lit(1)), n)
    return F.when(at > 0, F.trim(F.concat_ws(" ", F.array_join(left, " "), mention, F.array_join(F.slice(after, 1, n), " "))))


def chunks(x: Column, size: int, overlap: int = 0) -> Column:
    """Token chunks of a size, each starting size - overlap after the one before."""
    def parts(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - overlap, F.lit(1)), F.lit(size - overlap))
        return F.transform(starts, lambda s: F.array_join(F.slice(t, s, size), " "))

    return let(F.split(x, " "), parts)


def pack_sentences(x: Column, limit: int) -> Column:
    """Sentences packed in order into chunks of at most limit tokens; a longer sentence is a chunk."""
    sentences = F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, sentence: Column) -> Column:
        n = n_tokens(sentence)
        fits = (s["n"] == 0) | (s["n"] + n <= limit)
        return F.struct(
            F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
            F.when(s["n"] == 0, sentence).when(fits, F.concat_ws(" ", s["open"], sentence)).otherwise(sentence).alias("open"),
            F.when(fits, s["n"] + n).otherwise(n).alias("n"),
        )

    return F.aggregate(sentences, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def first_tokens(x: Column, n: int) -> Column:
    """First n tokens."""
    return F.array_join(F.slice(F.split(x, " "), 1, n), " ")


def date_of(seconds: Column) -> Column:
    """Date string of epoch seconds."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def php_title(x: Column) -> Column:
    """New title in the serialised parameters of a move."""
    return F.regexp_extract(x, r's:9:"4::target";s:\d+:"([^"]*)"', 1)


def verdict(x: Column) -> Column:
    """True if a single answer says YES."""
    return F.upper(x).contains("YES")


def verdicts(x: Column) -> Column:
    """Array of (head, relation, tail, verdict) of a multi-triple answer with lines `[Q1 (l), P2 (l), Q3 (l)] ... YES|NO`."""
    pattern = r"\[(Q\d+)[^,\]]*,\s*(P\d+)[^,\]]*,\s*(Q\d+)[^\]]*\][^\[]*?\b(YES|NO)\b"
    part = [F.regexp_extract_all(x, F.lit(pattern), F.lit(k)) for k in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("head", "relation", "tail", "said"))]), lambda v: F.struct(v["head"].alias("head"), v["relation"].alias("relation"), v["tail"].alias("tail"), (v["said"] == "YES").alias("verdict")))


def first_json(x: Column) -> Column:
    """The first object in free text that parses, as variant; null without one."""
    return F.coalesce(F.try_parse_json(x), F.try_parse_json(F.regexp_extract(x, r"(?s)(\{.*\})", 1)), F.try_parse_json(F.regexp_extract(x, r"(?s)(\{.*?\})", 1)))


def linearized_triplets(x: Column) -> Column:
    """Array of (head, relation, tail) of `<triplet> head <subj> tail <obj> relation` text."""
    parts = F.filter(F.split(x, "<triplet>"), lambda p: p.rlike(r"<subj>.*<obj>"))
    bare = lambda c: F.trim(F.regexp_replace(c, r"</?s>|<pad>", ""))
    return F.transform(parts, lambda p: F.struct(bare(F.substring_index(p, "<subj>", 1)).alias("head"), bare(F.regexp_extract(p, r"(?s)<obj>(.*)$", 1)).alias("relation"), bare(F.regexp_extract(p, r"(?s)<subj>(.*?)<obj>", 1)).alias("tail")))


def literal_triples(x: Column) -> Column:
    """Arrays of three or four quoted items in list literals."""
    items = F.regexp_extract_all(x, F.lit(r"\[((?:\s*['\"][^'\"]*['\"]\s*,?){3,4})\]"), F.lit(1))
    return F.transform(items, lambda i: F.regexp_extract_all(i, F.lit(r"['\"]([^'\"]*)['\"]"), F.lit(1)))


def definitions(x: Column) -> Column:
    """Map of `relation: definition` lines; the first of doubled names stays."""
    lines = F.filter(F.split(x, "\n"), lambda l: l.contains(":"))
    pairs = F.transform(lines, lambda l: F.struct(F.trim(F.substring_index(l, ":", 1)).alias("k"), F.trim(F.regexp_replace(l, r"^[^:]*:", "")).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(first)


def entity_list(x: Column) -> Column:
    """Items of a bracketed list."""
    return F.filter(F.transform(F.split(F.regexp_replace(x, r"^\s*\[|\]\s*$", ""), ","), lambda i: F.trim(F.regexp_replace(i, r"['\"]", ""))), lambda i: i != "")


def fill(template: Column, **values: Column) -> Column:
    """Template with {name} replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def normalize_label(x: Column) -> Column:
    """Lower case, trimmed, underscores and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, "_", " ")), r"\s+", " "))


def thousands(x: Column) -> Column:
    """Number with separators."""
    return F.format_number(x, 0)


def english_share(text_tokens: Column, lexicon: Column) -> Column:
    """Percentage of tokens that a lexicon array holds (F8); for large lexicons join instead."""
    return F.when(F.size(text_tokens) > 0, 100.0 * F.size(F.filter(text_tokens, lambda t: F.array_contains(lexicon, t))) / F.size(text_tokens)).otherwise(F.lit(0.0))


def valid_triple(head: Column, relation: Column, tail: Column) -> Column:
    """Q, P, Q identifiers."""
    return head.rlike(r"^Q\d+$") & relation.rlike(r"^P\d+$") & tail.rlike(r"^Q\d+$")
