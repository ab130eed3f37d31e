"""Text functions, instances, scoring, sampling, sources and sinks on small inputs."""

import hashlib
import base64
import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.functions import assignment as fn
from tidegraph.functions import text as tx
from tidegraph.operators import agreement, curation, instances, sampling, scoring
from tidegraph.plans import REGISTRY
from tidegraph.sources import foreign, sinks, wiki


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_short_hash(spark):
    expected = base64.urlsafe_b64encode(hashlib.sha256("é?".encode()).digest()).decode().rstrip("=")[:8]
    assert one(spark, tx.short_hash(F.col("t"), 8), t="é?") == expected


@pytest.mark.parametrize(
    ("text", "flags"),
    [("", ["empty"]), (None, ["empty"]), ("one two", ["very_few_words"]), ("YES or NO, who knows it", ["contradiction"]), ("a a a a a b c d e f g", ["repeated_token"]), ("fine words here !!!!!!!!", ["repeated_punct"]),
     (" ".join(["x y z"] * 7), ["low_unique_ratio", "repeated_ngram"]), (" ".join(f"w{k}" for k in range(700)), ["very_long"]), (" ".join(f"w{k}" for k in range(2000)), ["truncation"])],
)
def test_degenerate_flags(spark, text, flags):
    assert one(spark, tx.degenerate_flags(F.col("t")), t=text) == flags


def test_parsers(spark):
    rows = one(spark, tx.verdicts(F.col("t")), t="[Q1 (a), P2 (b), Q3 (c)] well YES fine\n[Q4 (x), P5 (y), Q6 (z)] NO")
    assert [tuple(r) for r in rows] == [("Q1", "P2", "Q3", True), ("Q4", "P5", "Q6", False)]
    assert [tuple(r) for r in one(spark, tx.linearized_triplets(F.col("t")), t="<s><triplet> A <subj> B <obj> r<triplet> C <subj> D <obj> q</s>")] == [("A", "r", "B"), ("C", "q", "D")]
    assert one(spark, tx.definitions(F.col("t")), t="a: x: y\nb: z\na: late") == {"a": "x: y", "b": "z"}
    assert one(spark, tx.entity_list(F.col("t")), t="['a', \"b\" , ]") == ["a", "b"]
    assert one(spark, tx.literal_triples(F.col("t")), t="ADD: ['a', 'r', 'b'], DEPRECATE: [\"c\", \"s\", \"d\", \"e\"]") == [["a", "r", "b"], ["c", "s", "d", "e"]]
    assert one(spark, tx.normalize_label(F.col("t")), t="  A_b   C ") == "a b c"
    assert one(spark, F.to_json(tx.first_json(F.col("t"))), t='so: {"a": 1} done') == '{"a":1}'


def test_chunks_and_packing(spark):
    assert one(spark, tx.chunks(F.col("t"), 3, 1), t="a b c d e") == ["a b c", "c d e"]
    assert one(spark, tx.pack_sentences(F.col("t"), 4), t="A b. C d. E f g h i. J.") == ["A b. C d.", "E f g h i.", "J."]
    assert one(spark, tx.context(F.col("t"), F.lit("M"), 2), t="a b c M d e f") == "b c M d e"


def test_wikitext(spark):
    assert one(spark, tx.clean_wikitext(F.col("t")), t="'''B''' {{x|{{y}}}}[[a|b]] [[c]]<ref>n</ref> <!-- q -->[[File:x.png|thumb|[[k]] t]]end") == "B b c end"
    assert fn.remove_balanced("a{{b{{c}}d}}e{{f") == "ae{{f"
    plain, mentions = fn.plain_and_mentions("x [[A|bb]] y [[C]]")
    assert plain == "x bb y C" and [plain[m["start_char"] : m["end_char"]] for m in mentions] == ["bb", "C"]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = fn.assignment(cost)
        rows = np.flatnonzero(got >= 0)
        assert len(rows) == min(n, m) and len(set(got[rows])) == len(rows)
        big, small = (range(m), range(n)) if n <= m else (range(n), range(m))
        best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in zip(small, p)) for p in itertools.permutations(big, len(small)))
        assert abs(cost[rows, got[rows]].sum() - best) < 1e-9
    assert fn.match_score(np.zeros((0, 2)), np.ones((1, 2))) == (0.0, 0.0, 0.0)


def test_instances(spark):
    row = ('{"hash_id": "h", "chunk": "p", "passage_id": 7, "tkgu_triples": [{"triple": ["Q1", "P1", "Q2"], "tkgu_operations": ["e-triples", "x-triples"], "llm_assessment": [{"llm_name": "a", "llm_assessment": true, "llm_prompt_type": "t"}], "qualifier_info": {}}]}',)
    raw = spark.createDataFrame([row], "v string").select(F.from_json("v", instances.INSTANCE).alias("i")).select("i.*")
    df = instances.normalize_instance(raw)
    r = df.first()
    assert (r.passage, r.revision_id) == ("p", 7)
    assert [x.tkgu_type for x in instances.exploded(df).collect()] == ["e-triples", "x-triples"]
    renamed = df.select(instances.rename_assessors(F.col("tkgu_triples"), {"a": "b"}).alias("t")).first().t
    assert renamed[0].llm_assessment[0].llm_name == "b"
    assert df.select(instances.strip_verdicts(F.col("tkgu_triples"), "a").alias("t")).first().t[0].llm_assessment == []
    assert df.select(instances.verdict_of(F.col("tkgu_triples")[0]["llm_assessment"], "a", "t").alias("v")).first().v is True
    assert df.select(instances.verdict_of(F.col("tkgu_triples")[0]["llm_assessment"], "z", "t").alias("v")).first().v is False


def test_gap_clusters(spark):
    lines = spark.createDataFrame([(x,) for x in (300, 10, 95, 40, 40)], "line bigint")
    got = curation.gap_clusters(lines, 50, 20).orderBy("first").collect()
    assert [(x["first"], x["last"], x["n"]) for x in got] == [(10, 40, 2), (95, 95, 1), (300, 300, 1)]
    assert got[0]["padded_first"] == 0 and got[0]["padded_last"] == 60


def test_folds(spark):
    rows = spark.createDataFrame([("s", 1, "the quick brown fox jumps", 0), ("s", 2, "the quick brown fox jumped", 1), ("s", 3, "something else entirely here", 0)], "b string, k int, t string, g int")
    assert sorted(r.k for r in curation.fold_duplicates(rows, ["b"], "k", "t", ["g"], most_edits=0.1).collect()) == [2, 3]
    assert sorted(r.k for r in curation.diverse(rows, ["b"], ["k"], "t", limit=5).collect()) == [1, 3]
    q = spark.createDataFrame([("d", k, ["d-triples"] if k < 3 else ["e-triples", "d-triples"]) for k in range(6)], "g string, k int, ops array<string>")
    got = sampling.quotas(q, ["g"], "k", "ops", ["d-triples", "e-triples"], 2).collect()
    assert sum("d-triples" in r.ops for r in got) >= 2 and sum("e-triples" in r.ops for r in got) >= 2
    assert sampling.rarest_first({"a": 5, "b": 0}, 2, [("x", ["a"]), ("y", ["b"]), ("z", ["b"])]) == ["y", "z"]


def test_scores(spark):
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 1.0])], "label int, vec_id int, embedding array<double>")
    assert {r.label: r.uniqueness for r in scoring.uniqueness(e, ["label"], "vec_id", 0.5).collect()} == {1: 1.0, 2: 1.0}
    b = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    got = b.select(scoring.bleu(F.col("a"), F.col("b"), 3).alias("x"), scoring.rouge_precision(F.col("a"), F.col("b")).alias("y")).collect()
    assert abs(got[0].x - 1) < 1e-9 and got[0].y == 1.0 and (got[1].x, got[1].y) == (0.0, 0.0)
    same = spark.createDataFrame([(k, k % 2, k % 2) for k in range(10)], "i int, a int, b int")
    m = agreement.measures(agreement.confusion(same, "a", "b")).first()
    assert m.cohen_kappa == 1.0 and m.scott_pi == 1.0 and m.f1 == 1.0


def test_whole_documents_are_curated(spark, tmp_path):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefgh \u00e9"), n))
    for _ in range(200):
        a, b = text(rng.integers(0, 30)), text(rng.integers(0, 30))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        assert curation._edits(a, b) == row[-1]
    # Long and accented copies of a late source, and texts that differ after their first 300 characters.
    long, start = text(1500), text(300)
    rows = [(1, "src9", "fr", long), (2, "src9", "fr", long + "#"), (3, "src9", "fr", start + text(900)), (4, "src9", "fr", start + text(900)), (5, "src9", "fr", None)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # Folding keeps the one of larger length % 3.
    assert sorted(r.doc_id for r in REGISTRY.queries["duplicate_fold"](spark, str(tmp_path)).collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in REGISTRY.queries["diverse_selection"](spark, str(tmp_path)).collect()) == [1, 3, 4]


def test_bleu_rouge_of_whole_turns(spark):
    sf = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): (r.role, re.findall(r"\S+", r.text.lower())) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r for r in REGISTRY.queries["bleu_rouge"](spark, sf).collect()}
    grams = lambda t, n: collections.Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    assert got.keys() == {(c, t) for (c, t), x in turns.items() if x[0] == "assistant" and (c, t - 1) in turns}
    assert any(len(turns[k][1]) > 60 for k in got)
    for (c, t), r in got.items():
        a, b = turns[c, t][1], turns[c, t - 1][1]
        both = {n: ((grams(a, n) & grams(b, n)).total(), grams(a, n).total()) for n in (1, 2, 3, 4)}
        logs = [math.log(max((x + (n > 1)) / max(y + (n > 1), 1), 1e-9)) / 4 for n, (x, y) in both.items()]
        bleu = math.exp(sum(logs) + (0 if len(a) >= len(b) else 1 - len(b) / max(len(a), 1))) if a and b else 0
        assert abs(r.bleu - bleu) < 2e-6 and abs(r.rouge2 - (both[2][0] / both[2][1] if both[2][1] else 0)) < 2e-6


def test_sources(spark, tmp_path):
    dump = tmp_path / "dump.xml"
    dump.write_text("<mediawiki><page><title>T</title><ns>0</ns><id>5</id><revision><id>9</id><timestamp>2024-01-01T00:00:00Z</timestamp><text>x [[y]]</text></revision></page><page><title>U:z</title><ns>2</ns><id>6</id></page></mediawiki>")
    r = wiki.revisions(wiki.pages(spark, str(dump))).collect()
    assert [(x.page, x.title, x.revision, x.ts, x.text) for x in r] == [(5, "T", 9, 1704067200, "x [[y]]")]
    sql = spark.createDataFrame([("INSERT INTO `page` VALUES (1,0,'A_b',0),(2,0,'C\\'d',0),(3,1,'Z',0);",), ("INSERT INTO `redirect` VALUES (1,0,'C\\'d','','');",), ("INSERT INTO `page_props` VALUES (1,'wikibase_item','Q7',NULL),(1,'x','y',NULL);",)], "value string")
    titles = wiki.page_titles(sql)
    assert {(x.page, x.title) for x in titles.collect()} == {(1, "A b"), (2, "C'd")}
    assert [(x.source, x.target) for x in wiki.redirects(sql, titles).collect()] == [(1, 2)]
    assert [(x.page, x.qid) for x in wiki.page_props(sql).collect()] == [(1, "Q7")]
    claim = '{"id":"Q1","claims":{"P1":[{"id":"s","rank":"normal","mainsnak":{"snaktype":"value","property":"P1","datavalue":{"type":"wikibase-entityid","value":{"id":"Q2"}}},"qualifiers":{"P580":[{"snaktype":"value","property":"P580","datavalue":{"type":"time","value":{"time":"+2005-01-00T00:00:00Z","precision":10}}}]}}]}}'
    st = wiki.claims(spark.createDataFrame([(claim,)], "text string"))
    assert [(x.entity, x.relation, x.tail) for x in st.collect()] == [("Q1", "P1", "Q2")]
    assert [(x.pid, x.y, x.m, x.d, x.precision) for x in wiki.temporal_qualifiers(st).collect()] == [("P580", 2005, 1, 0, 10)]
    log = tmp_path / "log.xml"
    log.write_text('<mediawiki><logitem><id>1</id><timestamp>2024-01-01T00:00:00Z</timestamp><type>move</type><action>move</action><logtitle>Old</logtitle><params>a:2:{s:9:"4::target";s:3:"New";}</params></logitem></mediawiki>')
    assert [(x.title, x.new_title) for x in wiki.moves(spark, str(log)).collect()] == [("Old", "New")]
    (tmp_path / "h.tsv").write_text('Q1\tP1\tQ2\te\t1000:A,5000:D,P580:Y2005M1D1:9,\n')
    rows = wiki.history(wiki.tsv(spark, str(tmp_path / "h.tsv"), "subject string, relation string, object string, type string, timestamps string"))
    assert [(x.ts, x.action) for x in rows.orderBy("seq").collect()] == [(1, "A"), (5, "D")]
    (tmp_path / "t.ttl").write_text("@prefix x: <y> .\nx:a x:r x:b .\n")
    assert [tuple(x) for x in foreign.turtle(foreign.read_any(spark, str(tmp_path / "t.ttl"), "ttl")).collect()] == [("x:a", "x:r", "x:b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert sinks.markdown(df).splitlines()[2:] == ["| 1 | a\\|b |", "| 2 |  |"]
    assert sinks.latex(df).startswith("\\begin{tabular}{ll}") and sinks.ascii_table(df).splitlines()[0] == "k  v"
    sinks.write_tsv(df, str(tmp_path / "o"))
    for bad in ("/a/b", "/a", "/a/b/c"):
        with pytest.raises(ValueError):
            sinks.check_paths("/a/b", bad)
    sinks.check_paths("/a/b", "/a/bc")


def test_streaming(spark, tmp_path):
    from tidegraph.streaming import live

    src = tmp_path / "in"
    schema = "head string, relation string, ts timestamp, seq int, action string"
    spark.createDataFrame([("h", "r", "2024-01-01", 1, "A"), ("h", "r", "2024-01-02", 2, "A"), ("h", "r", "2024-01-03", 3, "D")], "head string, relation string, ts string, seq int, action string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = live.live_intervals(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.from_ts)[:10], str(r.to_ts)[:10], r.final) for r in spark.table("live").collect()) == [("2024-01-01", "2024-01-03", True), ("2024-01-01", "None", False)]
    q = live.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").count() == 3
