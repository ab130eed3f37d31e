"""Readers of wiki dumps and of the pipeline's own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Page element of a MediaWiki export, as far as it is used: a narrow schema keeps the parser from the rest.
PAGE = "title string, ns int, id bigint, redirect struct<_title: string>, revision array<struct<id: bigint, timestamp: string, text: struct<_VALUE: string>>>"
SNAK = "struct<snaktype: string, property: string, datavalue: struct<type: string, value: string>>"
CLAIMS = f"map<string, array<struct<id: string, rank: string, mainsnak: {SNAK}, qualifiers: map<string, array<{SNAK}>>>>>"
#: Items whose statements are left out as hubs.
HUBS = ("Q13442814", "Q7318358")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML export, plain, gz or bz2 (S1, S2, S4). 7z archives are converted beforehand: Spark has no codec."""
    return spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)


def revisions(page_rows: DataFrame) -> DataFrame:
    """One row a revision of a main-namespace page (S4, F1): page, title, revision, ts, text."""
    r = page_rows.where("ns = 0").select(F.col("id").alias("page"), "title", F.explode("revision").alias("r"))
    return r.select("page", "title", F.col("r.id").alias("revision"), F.unix_timestamp(F.to_timestamp("r.timestamp")).alias("ts"), F.col("r.text._VALUE").alias("text"))


def claims(entities: DataFrame, json: str = "text") -> DataFrame:
    """(entity, statement, relation, tail, type, qualifiers) of entity JSON (S3); statements about hub items are left out."""
    parsed = entities.select("*", F.from_json(json, f"id string, claims {CLAIMS}").alias("j"))
    each = parsed.select("*", F.explode(F.map_values("j.claims")).alias("group")).select("*", F.explode("group").alias("s"))
    value = F.col("s.mainsnak.datavalue.value")
    tail = F.coalesce(F.get_json_object(value, "$.id"), F.get_json_object(value, "$.time"), F.get_json_object(value, "$.amount"), F.get_json_object(value, "$.text"), value)
    rest = [c for c in entities.columns if c != json]
    out = each.where("s.mainsnak.snaktype = 'value'").select(*rest, F.col("j.id").alias("entity"), F.col("s.id").alias("statement"), F.col("s.mainsnak.property").alias("relation"), tail.alias("tail"), F.col("s.mainsnak.datavalue.type").alias("type"), F.col("s.qualifiers").alias("qualifiers"))
    return out.where(~F.col("entity").isin(*HUBS) & ~F.col("tail").isin(*HUBS))


def temporal_qualifiers(statements: DataFrame) -> DataFrame:
    """(statement, pid, y, m, d, precision) of a claims table's time qualifiers."""
    each = statements.select("statement", F.explode("qualifiers").alias("pid", "snaks")).select("statement", "pid", F.explode("snaks").alias("s")).where("s.datavalue.type = 'time'")
    v, pattern = F.col("s.datavalue.value"), r"^([+-]\d+)-(\d\d)-(\d\d)"
    part = lambda k: F.regexp_extract(F.get_json_object(v, "$.time"), pattern, k).cast("int")
    return each.select("statement", "pid", part(1).alias("y"), part(2).alias("m"), part(3).alias("d"), F.get_json_object(v, "$.precision").cast("int").alias("precision"))


def sql_rows(lines: DataFrame, table: str) -> DataFrame:
    """The tuples of a MediaWiki SQL dump as strings in column tuple (S6-S9); lines as of spark.read.text."""
    inserts = lines.where(F.col("value").startswith(f"INSERT INTO `{table}` VALUES "))
    body = F.regexp_replace(F.regexp_replace("value", r"^INSERT INTO `\w+` VALUES \(", ""), r"\);\s*$", "")
    return inserts.select(F.explode(F.split(body, r"\),\((?=\d)")).alias("tuple"))


def _text(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\(.)", "$1"), "_", " ")


QUOTED = r"'((?:[^'\\]|\\.)*)'"


def page_props(lines: DataFrame) -> DataFrame:
    """(page, qid) of the wikibase_item property."""
    pattern = rf"^(\d+),'wikibase_item',{QUOTED}"
    return sql_rows(lines, "page_props").where(F.col("tuple").rlike(pattern)).select(F.regexp_extract("tuple", pattern, 1).cast("bigint").alias("page"), F.regexp_extract("tuple", pattern, 2).alias("qid"))


def page_titles(lines: DataFrame, namespace: int = 0) -> DataFrame:
    """(page, title) of one namespace."""
    pattern = rf"^(\d+),{namespace},{QUOTED}"
    return sql_rows(lines, "page").where(F.col("tuple").rlike(pattern)).select(F.regexp_extract("tuple", pattern, 1).cast("bigint").alias("page"), _text(F.regexp_extract("tuple", pattern, 2)).alias("title"))


def redirects(lines: DataFrame, titles: DataFrame, namespace: int = 0) -> DataFrame:
    """(source, target) page ids of redirects within one namespace."""
    pattern = rf"^(\d+),{namespace},{QUOTED}"
    found = sql_rows(lines, "redirect").where(F.col("tuple").rlike(pattern)).select(F.regexp_extract("tuple", pattern, 1).cast("bigint").alias("source"), _text(F.regexp_extract("tuple", pattern, 2)).alias("title"))
    return found.join(titles, "title").select("source", F.col("page").alias("target"))


def pages_of_entities(props: DataFrame) -> DataFrame:
    """Entity to the sorted list of its pages."""
    return props.groupBy("qid").agg(F.array_sort(F.collect_set("page")).alias("pages"))


MOVE = "id bigint, timestamp string, type string, action string, logtitle string, params string"
#: Prefixes of namespaces other than the main one.
NAMESPACES = ("talk", "user", "user talk", "wikipedia", "wikipedia talk", "file", "file talk", "mediawiki", "mediawiki talk", "template", "template talk", "help", "help talk", "category", "category talk", "portal", "portal talk", "draft", "draft talk", "module", "module talk", "timedtext", "book", "special")


def in_main_namespace(title: Column) -> Column:
    """The title has no prefix of another namespace (F2)."""
    return ~(title.contains(":") & F.lower(F.trim(F.substring_index(title, ":", 1))).isin(*NAMESPACES))


def moves(spark: SparkSession, path: str) -> DataFrame:
    """Title moves of a logging dump (S10, X18): (title, new_title, ts) in the main namespace."""
    from tidegraph.functions.text import php_title

    log = spark.read.format("xml").option("rowTag", "logitem").schema(MOVE).load(path)
    target = F.when(php_title(F.col("params")) != "", php_title(F.col("params"))).otherwise(F.trim("params"))
    return log.where("type = 'move' AND action = 'move'").where(in_main_namespace(F.col("logtitle"))).select(F.col("logtitle").alias("title"), target.alias("new_title"), F.unix_timestamp(F.to_timestamp("timestamp")).alias("ts"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows without quoting; rows that do not fit the schema are dropped."""
    fields = schema + ", _bad string"
    read = spark.read.option("sep", "\t").option("quote", "").option("maxCharsPerColumn", "-1").option("columnNameOfCorruptRecord", "_bad").schema(fields).csv(path)
    return read.where(F.col("_bad").isNull()).drop("_bad")


def history(rows: DataFrame) -> DataFrame:
    """(head, relation, tail, ts, seq, action) of history text `ms:A,ms:D,...` in column timestamps (S11, 1.1)."""
    each = rows.select(F.col("subject").alias("head"), "relation", F.col("object").alias("tail"), F.posexplode(F.regexp_extract_all("timestamps", F.lit(r"(\d+:[AD])(?=,|$)"), F.lit(1))).alias("seq", "e"))
    return each.select("head", "relation", "tail", F.floor(F.substring_index("e", ":", 1).cast("bigint") / 1000).alias("ts"), "seq", F.right("e", F.lit(1)).alias("action"))


def jsonl(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All .jsonl files below a folder, nested or flat, with their path."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root).withColumn("path", F.col("_metadata.file_path"))


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files (S13): each file is read whole by one task, so files are expected to be of moderate size."""
    files = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("line", "value"))
    return files


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a label file."""
    return tsv(spark, path, "id string, label string")


def snapshot_years(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """(year, head, relation, tail) of yearly snapshot files, further columns left out."""
    out = None
    for year, path in sorted(paths.items()):
        rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
        part = rows.select(F.lit(year).alias("year"), *[F.col(c).alias(n) for c, n in zip(rows.columns[:3], ("head", "relation", "tail"))]).distinct()
        out = part if out is None else out.unionByName(part)
    return out
