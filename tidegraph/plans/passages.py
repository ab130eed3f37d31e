"""Queries over documents, pages and conversations: text functions, curation, wiki ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import assignment as pyfn
from tidegraph.functions import text as tx
from tidegraph.io import table
from tidegraph.operators import curation, instances
from tidegraph.plans import REGISTRY

query = REGISTRY.query


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def simple(name: str, select: Callable[[], dict], oracle: str, source: str = "documents", key: str = "doc_id") -> None:
    """Register a projection of one table; select makes its columns when a session is there."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, source).select(*([key] if isinstance(key, str) else key), *[c.alias(n) for n, c in select().items()])

    run.__name__ = name
    run.__doc__ = f"Projection {name} of {source}."
    query(oracle, name)(run)


BRACES = "(length(text) - length(translate(text, '{}|', '')))"
simple("special_char_ratio", lambda: {"ratio": F.round(tx.special_ratio(F.col("text")), 6), "keep": tx.special_ratio(F.col("text")) <= 0.1}, f"SELECT doc_id, round({BRACES} / CAST(len(string_split(text, ' ')) AS DOUBLE), 6) AS ratio, {BRACES} / CAST(len(string_split(text, ' ')) AS DOUBLE) <= 0.1 AS keep FROM documents")
simple("length_window", lambda: {"tokens": tx.n_tokens(F.col("text")), "keep": tx.n_tokens(F.col("text")).between(25, 1000)}, "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS tokens, len(string_split(text, ' ')) BETWEEN 25 AND 1000 AS keep FROM documents")
simple("star_groups", lambda: {"groups": tx.star_groups(F.col("text"))}, r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\*+')) AS INT) AS groups FROM documents")
def _noise() -> Column:
    return F.concat(F.col("source"), F.lit(": "), F.col("text"))


simple(
    "line_noise_check", lambda: {"ok": tx.line_noise_ok(_noise())},
    r"WITH p AS (SELECT doc_id, source || ': ' || text AS p, trim(text, ' ') AS body FROM documents), f AS (SELECT doc_id, source_low, len(string_split(body, ' ')) AS w, length(body) - length(translate(body, '|:', '')) AS marks, len(regexp_extract_all(p, '\*+')) AS stars, "
    "lower(body) AS low FROM (SELECT p.*, lower(trim(split_part(p, ':', 1))) AS source_low FROM p)), s AS (SELECT *, starts_with(low, '==see also==') OR starts_with(low, '== see also ==') AS see FROM f) "
    "SELECT doc_id, CASE WHEN marks > 0 AND w < 3 * marks THEN FALSE WHEN stars > 1 THEN contains(source_low, 'list of') OR contains(low, '==cast==') OR contains(low, '== cast ==') OR w >= stars ELSE NOT (see AND w < 2) END AS ok FROM s",
)
simple("short_hash", lambda: {"h": tx.short_hash(F.col("text"), 8)}, "SELECT doc_id, substr(translate(rtrim(to_base64(unhex(sha256(text))), '='), '+/', '-_'), 1, 8) AS h FROM documents")
simple("first_n_tokens", lambda: {"head": tx.first_tokens(F.col("text"), 20)}, "SELECT doc_id, array_to_string(string_split(text, ' ')[1:20], ' ') AS head FROM documents")
simple("template_residue", lambda: {"residue": F.col("text").contains("{{"), "table": F.col("text").contains(" | ")}, "SELECT doc_id, contains(text, '{{') AS residue, contains(text, ' | ') AS \"table\" FROM documents")
simple("label_normalize", lambda: {"label": tx.normalize_label(F.col("text"))}, r"SELECT conv_id, turn, trim(regexp_replace(lower(replace(text, '_', ' ')), '\s+', ' ', 'g')) AS label FROM conversations", "conversations", ["conv_id", "turn"])
simple("skipped_paragraphs", lambda: {"skip": tx.is_skipped_paragraph(F.concat(F.when(F.col("doc_id") % 5 == 0, "File:").when(F.col("doc_id") % 7 == 0, "{{x").otherwise(""), F.col("text")))}, r"SELECT doc_id, regexp_matches(trim(CASE WHEN doc_id % 5 = 0 THEN 'File:' WHEN doc_id % 7 = 0 THEN '{{x' ELSE '' END || text), '^(\{\{|\[*(File|Image|Category|Wiktionary):)') AS skip FROM documents")


@query()
def degenerate_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of degenerate text; the repeated-mark rule needs a back reference, which the oracle's expressions lack."""
    return docs(spark, sf).select("doc_id", F.array_join(tx.degenerate_flags(F.col("text")), ",").alias("flags"))


simple(
    "word_flags", lambda: {"n": F.size(tx.words(F.col("text"))), "few": F.size(tx.words(F.col("text"))) < 3, "low_unique": (F.size(tx.words(F.col("text"))) >= 4) & (F.size(F.array_distinct(tx.words(F.col("text")))) < F.size(tx.words(F.col("text"))) * 0.3)},
    r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INT) AS n, len(w) < 3 AS few, len(w) >= 4 AND len(list_distinct(w)) < len(w) * 0.3 AS low_unique FROM w",
)


@query("WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), c AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM t), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c), l AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY 1, 2) SELECT doc_id, CAST(max(n) AS INT) AS longest FROM l GROUP BY doc_id")
def longest_token_run(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.longest_run(F.split("text", " ")).alias("longest"))


@query("WITH t AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 3), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2) SELECT t.doc_id, CAST(coalesce(max(n), 0) AS INT) AS most FROM t LEFT JOIN c ON c.doc_id = t.doc_id GROUP BY t.doc_id")
def ngram_max_count(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tx.max_gram_count(F.split(F.lower("text"), " ")).alias("most"))


@query()
def dup_pairs_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of one source within an edit distance; DuckDB counts bytes, so the oracle is a brute-force test."""
    return curation.similar_pairs(docs(spark, sf), ["source"], "doc_id", "text", most_edits=0.2, least_ratio=0.8).drop("edit_share")


@query(
    "WITH s AS (SELECT source, min(doc_id) AS doc_id, text, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS w FROM documents GROUP BY source, text), t AS (SELECT * FROM s WHERE len(w) > 0) "
    "SELECT a.source, a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, FALSE AS copy, round(len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE), 6) AS jaccard FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id "
    "WHERE len(list_intersect(a.w, b.w)) >= 0.35 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) UNION ALL SELECT t.source, t.doc_id, d.doc_id, TRUE, 1.0 FROM documents d JOIN t ON d.source = t.source AND d.text = t.text WHERE d.doc_id <> t.doc_id"
)
def dup_pairs_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of one source that share their tokens; equal texts are linked to the first of them."""
    return curation.similar_pairs(docs(spark, sf), ["source"], "doc_id", "text", least_jaccard=0.35).withColumn("jaccard", F.round("jaccard", 6))


@query()
def prefix_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Edits between the openings of different texts of one source and nearly one length; DuckDB counts bytes, so the oracle is a brute-force test."""
    a, b = F.col("__t_a"), F.col("__t_b")
    pairs = curation.length_pairs(curation.distinct_texts(docs(spark, sf), ["source"], "doc_id", "text"), ["source"], 0.98)
    return pairs.select("source", F.least("__rep_a", "__rep_b").alias("a"), F.greatest("__rep_a", "__rep_b").alias("b"), tx.prefix_edit(a, b, 40).alias("prefix_edits"), F.round(tx.length_ratio(a, b), 6).alias("ratio"))


@query(
    "WITH s AS (SELECT d.source, d.lang, d.doc_id, d.n_chars, coalesce(l.quality, 0) AS good, CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END AS clean FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) "
    "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY good DESC, clean DESC, n_chars DESC, doc_id) AS k FROM s) WHERE k = 1"
)
def prefer_better_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    """The better of a group by support (here the labels), length and id."""
    labelled = docs(spark, sf).select("source", "lang", "doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    rows = labelled.select("source", "lang", "doc_id", "n_chars", F.coalesce("quality", F.lit(0)).alias("good"), F.when(F.col("toxic") == 0, 1).otherwise(0).alias("clean"))
    return curation.best_of(rows, ["source", "lang"], curation.preference([F.col("good"), F.col("clean")], F.col("n_chars"), -F.col("doc_id"))).select("source", "lang", "doc_id")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_seen_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return curation.first_of(docs(spark, sf).select("text", "doc_id"), ["text"], ["doc_id"]).select("text", "doc_id")


@query(
    "WITH p AS (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS paragraph FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source, paragraph ORDER BY doc_id, line) AS k FROM p) SELECT source, doc_id, CAST(line AS INT) AS line FROM n WHERE k = 1"
)
def paragraph_novelty(spark: SparkSession, sf: str) -> DataFrame:
    p = docs(spark, sf).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    return curation.novel_paragraphs(p, "source", ["doc_id", "line"]).select("source", "doc_id", "line")


@query("WITH t AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), s AS (SELECT doc_id, t, unnest(generate_series(1, greatest(len(t) - 10, 1), 90)) AS s FROM t) SELECT doc_id, CAST((s - 1) // 90 AS INT) AS k, array_to_string(t[s:s + 99], ' ') AS chunk FROM s")
def chunk_packing(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.posexplode(tx.chunks(F.col("text"), 100, 10)).alias("k", "chunk"))


@query()
def sentence_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences packed up to a token limit: a fold, so the oracle is a brute-force test."""
    return docs(spark, sf).select("doc_id", F.posexplode(tx.pack_sentences(F.col("text"), 120)).alias("k", "chunk"))


LEXICON = ["the", "of", "and", "to", "in", "that", "it", "is", "was", "for"]


@query("WITH l AS (SELECT unnest(['the', 'of', 'and', 'to', 'in', 'that', 'it', 'is', 'was', 'for']) AS w), t AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents) SELECT doc_id, round(100.0 * count(l.w) / count(*), 6) AS share FROM t LEFT JOIN l ON l.w = t.t GROUP BY doc_id")
def english_word_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of tokens in a lexicon: a join, as lexicons may be large (F8)."""
    lex = spark.createDataFrame([(w,) for w in LEXICON], "w string")
    t = docs(spark, sf).select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("t"))
    return t.join(F.broadcast(lex), F.col("t") == F.col("w"), "left").groupBy("doc_id").agg(F.round(100.0 * F.count("w") / F.count("*"), 6).alias("share"))


def _verdict_text() -> Column:
    """Two answers a turn; every third turn the first one's relation is no id, so that only the second can be read."""
    relation = F.when(F.col("turn") % 3 == 0, "speaks").otherwise("P1")
    first = F.concat(F.lit("[Q"), F.col("conv_id"), F.lit(" (a), "), relation, F.lit(" (b), Q"), F.col("turn"), F.lit(" (c)] so "), F.when(F.length("text") % 2 == 0, "YES").otherwise("NO"))
    return F.concat(F.lit("Let me see, YES: "), first, F.lit(" because\n[Q"), F.length("text"), F.lit(",P22 (x),  Q7 (y)]: NO, NOT YES"))


@query(
    "SELECT conv_id, turn, 'Q' || conv_id AS head, 'P1' AS relation, 'Q' || turn AS tail, length(text) % 2 = 0 AS verdict FROM conversations WHERE turn % 3 <> 0 "
    "UNION ALL SELECT conv_id, turn, 'Q' || length(text), 'P22', 'Q7', FALSE FROM conversations"
)
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(tx.verdicts(_verdict_text())).alias("v")).select("conv_id", "turn", "v.*")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN NULL ELSE CAST(length(text) AS INT) END AS n FROM conversations")
def first_json_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Objects alone, within talk, before a second object, and cut off."""
    one = F.to_json(F.struct(F.length("text").alias("n"), F.struct(F.col("turn").alias("n")).alias("inner")))
    flat = F.to_json(F.struct(F.length("text").alias("n")))
    noisy = F.when(F.col("turn") % 4 == 0, one).when(F.col("turn") % 4 == 1, F.concat(F.lit("Here: "), F.expr("left(to_json(struct(turn AS n)), 4)"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("Sure, here it is:\n"), one, F.lit(" Anything else?"))).otherwise(F.concat(flat, F.lit(" or "), F.lit('{"n": -1}')))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.try_variant_get(tx.first_json(noisy), "$.n", "int").alias("n"))


@query(
    "SELECT conv_id, turn, 0 AS k, role AS head, 'said to' AS relation, 'conv' || conv_id AS tail FROM conversations UNION ALL SELECT conv_id, turn, 1, 'turn ' || turn, 'of', 'x' FROM conversations WHERE length(text) % 2 = 0"
)
def triplet_decode(spark: SparkSession, sf: str) -> DataFrame:
    """One or two triplets, and one without its object, which is left out."""
    first = F.concat(F.lit("<s><triplet> "), F.col("role"), F.lit(" <subj> conv"), F.col("conv_id"), F.lit(" <obj> said to "))
    second = F.when(F.length("text") % 2 == 0, F.concat(F.lit("<triplet> turn "), F.col("turn"), F.lit("<subj>x<obj>of"))).otherwise("")
    raw = F.concat(first, F.lit("<triplet> no object <subj> here "), second, F.lit("</s><pad>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.linearized_triplets(raw)).alias("k", "t")).select("conv_id", "turn", "k", "t.*")


@query(
    "SELECT conv_id, turn, 0 AS k, role || '/' || CAST(conv_id AS VARCHAR) || '/said' AS items FROM conversations UNION ALL SELECT conv_id, turn, 1, 'a b/' || CAST(turn AS VARCHAR) || '/c/d' FROM conversations WHERE length(text) % 2 = 0"
)
def literal_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of three or four quoted items among lists of two and of five, of both quotes."""
    four = F.concat(F.lit('["a b","'), F.col("turn"), F.lit("\", 'c',\"d\"]"))
    five = F.lit("['1', '2', '3', '4', '5']")
    raw = F.concat(F.lit("ADD: ['two', 'only'] ['"), F.col("role"), F.lit("', '"), F.col("conv_id"), F.lit("', 'said'], "), F.when(F.length("text") % 2 == 0, four).otherwise(five))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tx.literal_triples(raw)).alias("k", "i")).select("conv_id", "turn", "k", F.array_join("i", "/").alias("items"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE role || ': ' || turn END AS definition, CAST(CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END AS INT) AS n FROM conversations")
def relation_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions with colons of their own, doubled and missing names, and lines that are none."""
    said = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("\nsaid : "), F.col("role"), F.lit(": "), F.col("turn"), F.lit("\nsaid: late")))
    found = tx.definitions(F.concat(F.lit("Relations\nother: x"), said))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.try_element_at(found, F.lit("said")).alias("definition"), F.size(found).alias("n"))


@query("SELECT conv_id, turn, 'Role user'::VARCHAR || ': ' || role AS prompt FROM conversations".replace("'Role user'::VARCHAR", "'Role'"))
def prompt_fill(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.fill(F.lit("{what}: {role}"), what=F.lit("Role"), role=F.col("role")).alias("prompt"))


@query("WITH w AS (SELECT conv_id, turn FROM conversations WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = conversations.conv_id AND c.turn = conversations.turn AND c.role = 'assistant')) SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS BIGINT) AS batch FROM w")
def missing_verdict_queue(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return instances.missing_work(c.select("conv_id", "turn"), c.where("role = 'assistant'"), ["conv_id", "turn"], 2)


HREF = 'href="([^"]*)"'


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM l GROUP BY 1, 2")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')) AS plain FROM pages")
def template_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "(?s)<!--.*?-->", ""), "<[^>]*>", "")).alias("plain"))


def _wiki() -> Column:
    return F.concat(F.lit("'''Page''' {{a|{{b}}}} on [["), F.col("source"), F.lit("|the source]] and [["), F.col("lang"), F.lit("]]. {{nowrap|kept}} <!-- no --> "), F.coalesce("text", F.lit("")))


@query()
def wikitext_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Two-stage cleaning: balanced templates by Arrow batches, everything else by expressions."""
    return docs(spark, sf).select("doc_id", tx.clean_wikitext(pyfn.strip_balanced(F.regexp_replace(_wiki(), r"\{\{nowrap\|([^{}]*)\}\}", "$1"))).alias("plain"))


@query("SELECT doc_id, source AS target, 'the source' AS mention FROM documents UNION ALL SELECT doc_id, lang, lang FROM documents")
def wiki_links(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.explode(tx.links(_wiki())).alias("l")).select("doc_id", "l.target", F.col("l.text").alias("mention"))


@query()
def mention_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of link labels in the plain text: a fold over the text."""
    found = docs(spark, sf).select("doc_id", pyfn.mention_offsets(_wiki()).alias("m"))
    return found.select("doc_id", F.explode("m.mentions").alias("x")).select("doc_id", "x.*")


@query()
def coreference(spark: SparkSession, sf: str) -> DataFrame:
    """Later plain mentions of labels that a page linked before."""
    pages = docs(spark, sf).select(F.col("doc_id").alias("page"), F.array(_wiki(), F.concat(F.lit("Again the source, and "), F.col("lang"), F.lit("."))).alias("paragraphs"))
    return pages.mapInPandas(pyfn.corefer, pyfn.COREFERENCES)


@query("WITH t AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents WHERE text LIKE '% the %'), a AS (SELECT doc_id, strpos(text, ' the ') AS p, text FROM documents WHERE text LIKE '% the %'), s AS (SELECT doc_id, string_split(trim(left(text, p - 1), ' '), ' ') AS b, string_split(trim(substr(text, p + 5), ' '), ' ') AS c FROM a) SELECT doc_id, trim(array_to_string(b[greatest(len(b) - 2, 1):], ' ') || '  the  ' || array_to_string(c[1:3], ' '), ' ') AS around FROM s")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("text LIKE '% the %'").select("doc_id", tx.context(F.col("text"), F.lit(" the "), 3).alias("around"))


@query()
def diverse_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy diverse choice within (source, lang) groups of all documents."""
    rows = docs(spark, sf).where("text IS NOT NULL").select("doc_id", "source", "lang", "text")
    return curation.diverse(rows, ["source", "lang"], ["doc_id"], "text", limit=3).select("source", "lang", "doc_id")


@query()
def duplicate_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential near-duplicate removal within source blocks of all documents."""
    rows = docs(spark, sf).where("text IS NOT NULL").select("doc_id", "source", "text").withColumn("good", F.length("text") % 3)
    return curation.fold_duplicates(rows, ["source"], "doc_id", "text", ["good"], most_edits=0.2).select("source", "doc_id")


@query(
    "WITH g AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'add' ELSE 'infer' END || '|' || role || '|' || CAST(length(text) % 3 AS VARCHAR) || '|said', ';' ORDER BY CASE WHEN turn % 2 = 0 THEN 'add' ELSE 'infer' END, role, CAST(length(text) % 3 AS VARCHAR)) AS signature FROM conversations GROUP BY conv_id) "
    "SELECT signature, count(*) AS n FROM g GROUP BY signature"
)
def signature_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Instances with one set of triples (G12): a conversation's turns as triples."""
    triple = F.struct(F.when(F.col("turn") % 2 == 0, "add").otherwise("infer").alias("operation"), F.col("role").alias("head"), (F.length("text") % 3).cast("string").alias("relation"), F.lit("said").alias("tail"))
    each = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(triple).alias("triples"))
    return each.select(curation.signature(F.col("triples")).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 7 AS snapshot, lang, arg_min(doc_id, length(text) * 100000000 + doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def shortest_passage(spark: SparkSession, sf: str) -> DataFrame:
    from tidegraph.operators.sampling import shortest

    return shortest(docs(spark, sf).withColumn("snapshot", F.col("doc_id") % 7), ["snapshot", "lang"], "text", "doc_id").select("snapshot", "lang", "doc_id")


@query()
def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential quota passes within each source, the delta of the driver's data."""
    from tidegraph.operators.sampling import quotas

    ops = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("d-triples")), F.when(F.col("doc_id") % 3 == 0, F.lit("ee-kg-triples")), F.lit("e-triples")))
    return quotas(docs(spark, sf).select("source", "doc_id", ops.alias("ops")), ["source"], "doc_id", "ops", ["d-triples", "ee-kg-triples", "e-triples"], 4).select("source", "doc_id")
