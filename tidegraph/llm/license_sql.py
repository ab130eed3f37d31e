"""DuckDB SQL for the licence of every document, with the template constants written out."""

from __future__ import annotations

from tidegraph.llm.license_scan import BLANK, COSINE, MARKERS, TOKEN, weights

#: A document lies one to three folders below its language, by its id.
FOLDERS = "concat_ws('/', source, lang, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 7 AS {0}) END, CASE WHEN doc_id % 3 = 2 THEN CAST(doc_id % 5 AS {0}) END)"


def license_sql() -> str:
    idf, vectors = weights()
    marker, token, blank = MARKERS.replace("'", "''"), TOKEN, BLANK.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    idf_rows = ", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in idf)
    tpl_rows = ", ".join(f"('{n}', '{t}', {x!r}::DOUBLE)" for n, t, x in vectors)
    folder = FOLDERS.format("VARCHAR")
    return f"""
WITH idf(token, idf) AS (VALUES {idf_rows}), tpl(license, token, weight) AS (VALUES {tpl_rows}),
d AS (SELECT doc_id, {folder} AS dir, {folder} || '/' || doc_id AS path, text FROM documents),
u AS (SELECT doc_id, text, length(text) AS size, list_concat(list_transform(string_split(text, chr(10)), lambda x: {{'kind': 0, 'body': x}}),
list_transform(list_filter(regexp_split_to_array(text, '{blank}'), lambda x: contains(x, chr(10))), lambda x: {{'kind': 1, 'body': x}}),
CASE WHEN regexp_matches(text, '{blank}') THEN [{{'kind': 2, 'body': text}}] ELSE [] END) AS units FROM d WHERE regexp_matches(text, '{marker}')),
l AS (SELECT doc_id, size, generate_subscripts(units, 1) AS line, unnest(units) AS u FROM u),
t AS (SELECT doc_id, line, size, u.kind AS kind, length(u.body) AS chars, unnest(regexp_extract_all(lower(u.body), '{token}')) AS token FROM l WHERE regexp_matches(u.body, '{marker}')),
c AS (SELECT doc_id, line, token, count(*) AS n, max(kind) AS kind, max(chars) AS chars, max(size) AS size FROM t GROUP BY 1, 2, 3),
w AS (SELECT c.doc_id, c.line, c.token, c.kind, c.chars, c.size, c.n * idf.idf AS x FROM c JOIN idf ON idf.token = c.token),
dots AS (SELECT w.doc_id, w.line, tpl.license, sum(w.x * tpl.weight) AS dot FROM w JOIN tpl ON tpl.token = w.token GROUP BY 1, 2, 3),
norms AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm, max(kind) AS kind, max(chars) AS chars, max(size) AS size FROM w GROUP BY 1, 2),
cosines AS (SELECT dots.doc_id, dots.line, split_part(dots.license, '/', 1) AS license, round(dot / norm, 6) AS cosine, kind, chars, size FROM dots JOIN norms ON dots.doc_id = norms.doc_id AND dots.line = norms.line),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY cosine DESC, license) AS k FROM cosines WHERE cosine >= {COSINE}) WHERE k = 1),
own AS (SELECT doc_id, arg_min(license, concat(lpad(CAST(CAST(round((1 - cosine) * 1000000) AS BIGINT) AS VARCHAR), 9, '0'), license)) AS own_license, max(cosine) AS own_cosine, count(*) FILTER (kind < 2) AS n_notices,
greatest(coalesce(sum(chars) FILTER (kind = 0), 0), coalesce(sum(chars) FILTER (kind = 1), 0), coalesce(sum(chars) FILTER (kind = 2), 0)) * 2 >= max(size) AS is_license_file FROM best GROUP BY doc_id),
declared AS (SELECT dir, license FROM (SELECT d.dir, own.own_license AS license, row_number() OVER (PARTITION BY d.dir ORDER BY own_cosine DESC, own_license) AS r FROM own JOIN d ON d.doc_id = own.doc_id WHERE is_license_file) WHERE r = 1),
above AS (SELECT dir, unnest(generate_series(0, len(string_split(dir, '/')))) AS depth FROM (SELECT DISTINCT dir FROM d)),
inherited AS (SELECT above.dir, arg_max(declared.license, depth) AS license FROM above JOIN declared ON declared.dir = array_to_string(string_split(above.dir, '/')[1:depth], '/') GROUP BY above.dir)
SELECT d.doc_id, d.path, own.own_license, own.own_cosine, coalesce(own.n_notices, 0) AS n_notices, coalesce(own.is_license_file, FALSE) AS is_license_file, coalesce(own.own_license, inherited.license) AS license,
CASE WHEN own.own_license IS NOT NULL THEN CASE WHEN own.is_license_file THEN 'file' ELSE 'header' END WHEN inherited.license IS NOT NULL THEN 'inherited' END AS via
FROM d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN inherited ON inherited.dir = d.dir"""
