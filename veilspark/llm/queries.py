"""The queries of this subpackage and SQL with the same rows, where SQL can express them."""

from __future__ import annotations

from veilspark.llm.media import op4_media_columns
from veilspark.llm.mixing import op2_source_mixing
from veilspark.llm.ngram_join import op1_ngram_join
from veilspark.llm.packing import op3_packing
from veilspark.llm.pii import op8_pii
from veilspark.llm.quality import op6_quality_rules
from veilspark.llm.secrets import op10_secret_scan
from veilspark.llm.sharding import op9_sharding
from veilspark.llm.token_counts import op5_token_counts
from veilspark.llm.token_files import op7_token_files

OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o WHERE 100 * k >= 75 * (nx + ny - k)),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT DISTINCT x, x AS r FROM both_ways UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce((SELECT min(r) FROM reach WHERE reach.x = s.doc_id), s.doc_id) AS component_id
FROM s
"""


def _hits(kinds: dict[str, str]) -> str:
    """SQL: kind (its place), i, txt, group 2 if any, start of each match of each pattern, leftmost and without overlap."""
    one = """SELECT doc_id, {k} AS kind, '{name}' AS name, i, h[i] AS txt, {two} AS two, CAST(length(array_to_string(g[1:i], '')) + length(array_to_string(h[1:i-1], '')) AS BIGINT) AS start
  FROM (SELECT doc_id, h, g, two, unnest(range(1, len(h) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{q}') AS g, {all_two} AS two FROM d))"""
    out = []
    for k, (name, p) in enumerate(kinds.items()):
        plain = p.replace("'", "''")
        two = name == "assign"
        out.append(one.format(k=k, name=name, p=plain, q=plain, two="two[i]" if two else "''", all_two=f"regexp_extract_all(t, '{plain}', 2)" if two else "['']"))
    return " UNION ALL ".join(out)


_LUHN = "list_sum(list_transform(range(1, len(n) + 1), lambda j: CASE WHEN (len(n) - j) % 2 = 0 THEN CAST(n[j] AS INT) ELSE (2 * CAST(n[j] AS INT)) // 10 + (2 * CAST(n[j] AS INT)) % 10 END)) % 10 = 0"
_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_hits(_PII)}),
v AS (SELECT *, regexp_replace(txt, '[^0-9]', '', 'g') AS n FROM m),
k AS (SELECT * FROM v WHERE CASE kind WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(txt, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(concat('0', right(p, 3)) AS INT) > 255)) = 0
  WHEN 2 THEN length(n) BETWEEN 16 AND 19 AND {_LUHN} ELSE length(n) BETWEEN 8 AND 15 END)
SELECT d.doc_id, {", ".join(f"count(k.kind) FILTER (k.kind = {j}) AS n_{name}" for j, name in enumerate(_PII))},
  sha256(coalesce(string_agg(concat(k.name, ':', k.start, ':', k.start + length(k.txt)), ',' ORDER BY k.kind, k.start) FILTER (k.kind IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
_SECRETS = {"assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_hits(_SECRETS)}),
k AS (SELECT * FROM m WHERE CASE kind WHEN 0 THEN length(two) >= 6 WHEN 1 THEN length(txt) >= 20 ELSE length(txt) >= 24 END)
SELECT d.doc_id, {", ".join(f"count(k.kind) FILTER (k.kind = {j}) AS n_{name}" for j, name in enumerate(_SECRETS))},
  sha256(coalesce(string_agg(concat(k.name, ':', k.start, ':', k.start + length(k.txt)), ',' ORDER BY k.start, k.kind) FILTER (k.kind IS NOT NULL), '')) AS base_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""
OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
"""
OP3_SQL = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS length FROM documents"
OP4_SQL = "SELECT doc_id, n AS n_bytes, greatest(64, 64 * CAST(ceil(n / 64) AS BIGINT)) AS payload_bytes FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)"
OP9_SQL = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'bytes' AS law FROM documents"
#: Of the queries whose whole result SQL can't express, the columns that it can: query, operator's query, columns, SQL.
BASES = {
    "base_op3_packing": (op3_packing, ("doc_id", "length"), OP3_SQL),
    "base_op4_media_columns": (op4_media_columns, ("doc_id", "n_bytes", "payload_bytes"), OP4_SQL),
    "base_op6_quality_rules": (op6_quality_rules, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), OP6_SQL),
    "base_op8_pii": (op8_pii, ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), OP8_SQL),
    "base_op9_sharding": (op9_sharding, ("doc_id", "size", "law"), OP9_SQL),
    "base_op10_secret_scan": (op10_secret_scan, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), OP10_SQL),
}


def _base(query, columns):
    return lambda spark, sf_dir: query(spark, sf_dir).select(*columns)


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    ops = (op1_ngram_join, op2_source_mixing, op3_packing, op4_media_columns, op5_token_counts, op6_quality_rules, op7_token_files, op8_pii, op9_sharding, op10_secret_scan)
    return {f.__name__: f for f in ops} | {name: _base(f, columns) for name, (f, columns, _) in BASES.items()} | {"pipeline": _pipeline}


def oracle_sql():
    return {"op1_ngram_join": OP1_SQL} | {name: sql for name, (_, _, sql) in BASES.items()}
