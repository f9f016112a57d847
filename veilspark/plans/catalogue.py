"""The registered queries over the driver's tables, and SQL with the same rows.

The driver's texts hold few kinds of identifiers and no Chinese, so most queries run over texts made from table columns
by the same SELECT in Spark and in DuckDB (FIXTURES); what they must find is then known from the columns.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veilspark.functions import masks, normalize, patterns, spans as sp
from veilspark.operators import batch, dictionary, models, report
from veilspark.operators.detect import detect, without_excluded
from veilspark.plans import cases
from veilspark.plans.cases import dealt


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR(20))"


def _z(x: str, n: int, c: str = "0") -> str:
    return f"lpad({_s(x)}, {n}, '{c}')"


K = "c_custkey"
_DATE = f"concat({_s(f'2000 + {K} % 24')}, '-', {_s(f'1 + {K} % 12')}, '-', {_s(f'1 + {K} % 28')})"
_TIME = f"concat({_s(f'10 + {K} % 12')}, ':', {_s(f'10 + {K} % 50')})"
#: type -> what stands before, the value as SQL over customer, what stands behind.
VALUES = {
    "id_card": ("身份证", f"concat('11010119850312', {_z(f'{K} % 1000', 3)}, 'X')", "。"), "passport": ("护照", f"concat('G', {_z(K, 8)})", "号"), "hk_macau_pass": ("证件", f"concat('C', {_z(K, 8)})", "。"),
    "taiwan_pass": ("证件", f"concat('T', {_z(K, 8)})", "。"), "military_id": ("见 ", f"concat('军字第', {_z(K, 6)}, '号')", "。"), "credit_code": ("代码", f"concat('91', {_z(K, 6)}, 'MA01ABCD2X')", "。"),
    "org_code": ("机构", f"concat({_z(K, 8)}, '-X')", "。"), "tax_number": ("税号", _z(K, 15, "1"), "。"), "case_number": ("见", f"concat('（2024）京01民初', {_s(K)}, '号')", "。"),
    "contract_number": ("按", f"concat('合同编号：HT-', {_z(K, 8)})", "，"), "invoice_number": ("开", f"concat('发票号码：', {_z(K, 10)})", "，"), "phone": ("手机", f"concat('13', {_z(K, 9)})", "，"),
    "fax": ("传真", f"concat('010-8', {_z(K, 7)})", "，"), "toll_free": ("电话", f"concat('400-', {_z(f'{K} % 1000', 3)}, '-', {_z(f'{K} % 10000', 4)})", "，"), "email": ("邮箱", f"concat('u', {_s(K)}, '@mail.example.com')", "，"),
    "website": ("见", f"concat('https://example.com/p/', {_s(K)})", "，"), "social_account": ("加", f"concat('微信号：user_', {_s(K)})", "，"), "ip_address": ("地址", f"concat('10.', {_s(f'{K} % 256')}, '.1.7')", "，"),
    "mac_address": ("网卡", f"concat('0A:1B:2C:3D:4E:', {_z(f'{K} % 100', 2)})", "，"), "bank_account": ("付", f"concat('账号：6', {_z(K, 11)})", "，"), "amount": ("付", f"concat('人民币', {_s(f'{K} * 7')}, '元')", "，"),
    "price": ("付", f"concat('USD ', {_s(K)})", "，"), "license_plate": ("车", f"concat('京A', {_z(f'{K} % 100000', 5)})", "，"), "vin": ("车架", f"concat('LSVAA49J1', {_z(K, 8)})", "，"), "date": ("于", _DATE, "，"), "time": ("于", _TIME, "，"),
    "datetime": ("于", f"concat({_DATE}, ' ', {_TIME})", "，"), "full_address": ("to ", f"concat('北京市朝阳区建国路', {_s(K)}, '号')", "。"), "postal_code": ("邮编", _s(f"200000 + {K}"), "。"), "house_number": ("to ", f"concat({_s(K)}, '号楼')", "。"),
    "property_cert": ("to ", f"concat('深房地字第', {_z(K, 8)}, '号')", "。"), "permit_number": ("to ", f"concat('环评字第', {_z(K, 6)}, '号')", "。"), "patent_number": ("按", f"concat('专利申请号：CN', {_z(K, 8)})", "，"),
    "document_number": ("按", f"concat('函件编号：AB-', {_z(K, 6)})", "，"), "project_name": ("to ", "concat('青山大桥', '项目')", "，"),
}

_BRAND = "CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '青禾' WHEN 1 THEN '澜舟' ELSE '启辰' END"
_FULL = "CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '杭州青禾软件有限公司' WHEN 1 THEN '苏州澜舟软件有限公司' ELSE '长沙启辰软件有限公司' END"
_PERSON = "CASE CAST(s_suppkey % 2 AS INT) WHEN 0 THEN '周岩' ELSE '沈语' END"
_MAIL, _PHONE, _ID = f"concat('u', {_s(K)}, '@mail.example.com')", f"concat('13', {_z(K, 9)})", f"concat('11010119850312', {_z(f'{K} % 1000', 3)}, 'X')"
FIXTURES = {
    "contacts": ("customer", K, f"concat('联系人编号', {_z(K, 4)}, '，手机', {_PHONE}, '，身份证号', {_ID}, '，邮箱', {_MAIL}, '，邮编', {_s(f'200000 + {K}')}, '。')"),
    "contracts": ("orders", "o_orderkey", f"concat('合同编号：HT-', {_z('o_orderkey', 8)}, '，金额人民币', {_s('o_orderkey * 7')}, '元，日期', {_s('2000 + o_orderkey % 24')}, '-', {_s('1 + o_orderkey % 12')}, '-', {_s('1 + o_orderkey % 28')}, '，账号', {_z('o_orderkey', 12, '6')}, '，时间', {_s('10 + o_orderkey % 12')}, ':', {_s('10 + o_orderkey % 50')}, '。')"),
    "orgs": ("supplier", "s_suppkey", f"concat('原告', {_FULL}, '（以下简称“', {_BRAND}, '”）与被告', {_PERSON}, '，男，签订协议，', {_BRAND}, '已付款。')"),
    "broken": ("part", "p_partkey", f"concat('甲', {_s('p_size')}, chr(10), '号楼', chr(10), chr(10), '第二', chr(10), '段A', chr(10), '座')"),
    "scans": ("part", "p_partkey", f"concat('甲 乙', {_s('p_size')}, ' |丙', chr(10), '丁。', chr(10), '-', chr(10), '戊', {_s('p_size')})"),
    "replies": ("supplier", "s_suppkey", f"concat('```json', chr(10), '{{\"entities\":[{{\"text\":\"', {_PERSON}, {_s('s_suppkey')}, '\",\"type\":\"person\"}},{{\"text\":\"x\",\"type\":\"person\"}}]}}', chr(10), '```')"),
}


def _select(name: str) -> str:
    table, key, text = FIXTURES[name]
    return f"SELECT {key} AS doc_id, {text} AS text FROM {table}"


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fixture(spark, sf, name):
    table, key, text = FIXTURES[name]
    columns = [c for c in _table(spark, sf, table).columns if re.search(rf"\b{c}\b", text) or c == key]
    return dealt(_table(spark, sf, table).select(*columns)).selectExpr(f"{key} AS doc_id", f"{text} AS text")


def _docs(spark, sf):
    return dealt(_table(spark, sf, "documents").select("doc_id", "text"))


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__.lstrip("_")] = f
        if sql:
            SQL[f.__name__.lstrip("_")] = sql
        return f

    return keep


def _pattern_query(etype: str):
    before, value, behind = VALUES[etype]

    def run(spark, sf):
        docs = dealt(_table(spark, sf, "customer").select(K)).selectExpr(f"{K} AS doc_id", f"concat('{before}', {value}, '{behind}') AS text")
        return sp.exploded(patterns.with_pattern_spans(docs, only=[etype], into="spans")).select("doc_id", "etype", "txt", "pos")

    Q[f"pat_{etype}"] = run
    SQL[f"pat_{etype}"] = f"SELECT {K} AS doc_id, '{etype}' AS etype, {value} AS txt, CAST({len(before)} AS INT) AS pos FROM customer"


for _t in VALUES:
    _pattern_query(_t)

_EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"


@query(f"SELECT doc_id, 'email' AS type, m AS text, count(*) AS occurrence_count FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS m FROM documents) GROUP BY doc_id, m")
def findings_email(spark, sf):
    df = patterns.with_pattern_spans(_docs(spark, sf), only=["email"], into="spans")
    return report.findings(df).select("doc_id", "type", "text", "occurrence_count")


@query(f"""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '{_EMAIL}') AS m, string_split_regex(text, '{_EMAIL}') AS g FROM documents),
p AS (SELECT doc_id, text, unnest(range(1, len(m) + 1)) AS i, m, g FROM h),
q AS (SELECT doc_id, text, m[i] AS txt, CAST(length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i-1], '')) AS INT) AS pos FROM p)
SELECT doc_id, txt AS text, min(pos) AS first_pos,
 arg_min(translate(concat('…', substr(text, greatest(1, pos - 39), least(40, pos)), '【', txt, '】', substr(text, pos + length(txt) + 1, 40), '…'), chr(10) || chr(13), '  '), pos) AS context
FROM q GROUP BY doc_id, txt""")
def findings_context(spark, sf):
    df = patterns.with_pattern_spans(_docs(spark, sf), only=["email"], into="spans")
    return report.findings(df).select("doc_id", "text", "first_pos", "context")


@query(r"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS m FROM documents)
SELECT doc_id, 'bank_account' AS etype, m AS txt, count(*) AS n FROM runs WHERE length(m) BETWEEN 16 AND 19 GROUP BY ALL
UNION ALL SELECT doc_id, 'tax_number', m, count(*) FROM runs WHERE length(m) IN (15, 20) GROUP BY ALL""")
def overlap_greedy(spark, sf):
    """Bank accounts beat tax numbers on the same digits."""
    df = patterns.with_pattern_spans(_docs(spark, sf), only=["tax_number", "bank_account"], into="spans")
    return sp.exploded(df).groupBy("doc_id", "etype", "txt").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda m: length(m) BETWEEN 15 AND 20)) AS BIGINT) AS n FROM documents")
def type_filter_only(spark, sf):
    df = patterns.with_pattern_spans(_docs(spark, sf), only=["tax_number"], exclude=["bank_account"], into="spans")
    return df.select("doc_id", F.size("spans").cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(4 AS BIGINT) AS total_findings, CAST(4 AS BIGINT) AS type_count FROM ({_select('contacts')})")
def analysis_totals(spark, sf):
    df = patterns.with_pattern_spans(_fixture(spark, sf, "contacts"), into="spans")
    return report.totals(df)


_MASKED_MAIL = f"concat(CASE WHEN length(concat('u', {_s(K)})) <= 2 THEN repeat('*', length(concat('u', {_s(K)}))) ELSE concat(substr(concat('u', {_s(K)}), 1, 2), repeat('*', length({_s(K)}) - 1)) END, '@mail.example.com')"


@query(f"""SELECT {K} AS doc_id, concat('联系人编号', {_z(K, 4)}, '，手机', substr({_PHONE}, 1, 3), '******', substr({_PHONE}, 10, 2), '，身份证号110*************', substr({_ID}, 17, 2),
 '，邮箱', {_MASKED_MAIL}, '，邮编[POSTAL_CODE_1]。') AS masked_text FROM customer""")
def mask_contacts(spark, sf):
    df = detect(_fixture(spark, sf, "contacts"), entities=False)
    return masks.masked(df, made=("masked_text",), keep=["doc_id"])


@query("SELECT o_orderkey AS doc_id, '[CONTRACT_NUMBER_1]，金额[AMOUNT_1]，日期[DATE_1]，[BANK_ACCOUNT_1]，时间[TIME_1]。' AS masked_text FROM orders")
def mask_placeholders(spark, sf):
    df = detect(_fixture(spark, sf, "contracts"), entities=False)
    return masks.masked(df, everything="placeholder", made=("masked_text",), keep=["doc_id"])


@query("SELECT o_orderkey AS doc_id, '〔合同号1〕，金额〔金额1〕，日期〔日期1〕，〔银行卡1〕，时间〔时间1〕。' AS masked_text FROM orders")
def mask_chinese_style(spark, sf):
    df = detect(_fixture(spark, sf, "contracts"), entities=False)
    return masks.masked(df, everything="placeholder", style="chinese_bracket", made=("masked_text",), keep=["doc_id"])


@query(f"SELECT doc_id, text AS restored_text, '[CONTRACT_NUMBER_1]，金额[AMOUNT_1]，日期[DATE_1]，[BANK_ACCOUNT_1]，时间[TIME_1]。' AS masked_text FROM ({_select('contracts')})")
def restore_roundtrip(spark, sf):
    df = masks.masked(detect(_fixture(spark, sf, "contracts"), entities=False), everything="placeholder", made=("masked_text", "mapping"))
    return masks.restored(df, keep=["doc_id", "masked_text"]).select("doc_id", "restored_text", "masked_text")


@query(f"""SELECT {K} AS doc_id, '[PHONE_1]' AS placeholder, 'phone' AS type, {_PHONE} AS original FROM customer UNION ALL SELECT {K}, '[ID_CARD_1]', 'id_card', {_ID} FROM customer
UNION ALL SELECT {K}, '[EMAIL_1]', 'email', {_MAIL} FROM customer UNION ALL SELECT {K}, '[POSTAL_CODE_1]', 'postal_code', {_s(f'200000 + {K}')} FROM customer""")
def mapping_export(spark, sf):
    df = masks.masked(detect(_fixture(spark, sf, "contacts"), entities=False), everything="placeholder", made=("mapping",), keep=["doc_id"])
    return df.select("doc_id", F.explode("mapping").alias("placeholder", "v")).select("doc_id", "placeholder", "v.type", "v.original")


@query(f"SELECT {K} AS doc_id, {_PHONE} AS original_text, 'phone' AS type, CAST(12 AS INT) AS position FROM customer")
def replacement_log(spark, sf):
    df = masks.masked(detect(_fixture(spark, sf, "contacts"), only=["phone"], entities=False))
    return df.select("doc_id", F.inline("log")).select("doc_id", "original_text", "type", "position")


@query("SELECT s_suppkey AS doc_id, '原告[COMPANY_1]（以下简称“[COMPANY_1_ABBR]”）与被告[PERSON_1]，男，签订协议，[COMPANY_1_ABBR]已付款。' AS masked_text FROM supplier")
def rule_entities(spark, sf):
    return masks.masked(detect(_fixture(spark, sf, "orgs")), abbreviations="abbreviations").select("doc_id", "masked_text")


@query(f"SELECT s_suppkey AS doc_id, {_BRAND} AS abbreviation, {_FULL} AS full_name FROM supplier")
def abbreviation_claims(spark, sf):
    return detect(_fixture(spark, sf, "orgs")).select("doc_id", F.explode("abbreviations").alias("abbreviation", "full_name"))


@query(f"SELECT s_suppkey AS doc_id, 'person' AS etype, {_PERSON} AS txt FROM supplier")
def person_names(spark, sf):
    return sp.exploded(detect(_fixture(spark, sf, "orgs"), only=["person"])).select("doc_id", "etype", "txt")


@query(f"SELECT doc_id, masked_text FROM (SELECT s_suppkey AS doc_id, concat('原告', {_FULL}, '（以下简称“', {_BRAND}, '”）与被告[PERSON_1]，男，签订协议，', {_BRAND}, '已付款。') AS masked_text FROM supplier)")
def excluded_pairs(spark, sf):
    gone = [("company", x) for x in ("杭州青禾软件有限公司", "苏州澜舟软件有限公司", "长沙启辰软件有限公司", "青禾", "澜舟", "启辰")]
    return masks.masked(without_excluded(detect(_fixture(spark, sf, "orgs")), gone)).select("doc_id", "masked_text")


_WORDS = ["token", "License", "example"]


@query(" UNION ALL ".join(f"SELECT doc_id, '{w}' AS txt, CAST((length(text) - length(replace(text, '{w}', ''))) / {len(w)} AS BIGINT) AS n, CAST(strpos(text, '{w}') - 1 AS INT) AS first_pos FROM documents WHERE contains(text, '{w}')" for w in _WORDS))
def dict_scan(spark, sf):
    df = dictionary.with_dictionary_spans(_docs(spark, sf), [("word", w) for w in _WORDS], into="spans")
    return sp.exploded(df).groupBy("doc_id", "txt").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("""WITH cur AS (SELECT 'place' AS type, n_name AS name FROM nation WHERE n_nationkey < 15), new AS (SELECT 'place' AS type, n_name AS name FROM nation WHERE n_nationkey > 8 UNION SELECT 'other', r_name FROM region)
SELECT * FROM cur UNION SELECT * FROM new""")
def dict_merge(spark, sf):
    n, r = _table(spark, sf, "nation"), _table(spark, sf, "region")
    cur = dictionary.cleaned(n.filter("n_nationkey < 15").selectExpr("'place' AS type", "n_name AS name"))
    new = n.filter("n_nationkey > 8").selectExpr("'place' AS type", "concat(' ', n_name) AS name").union(r.selectExpr("'' AS type", "r_name AS name"))
    return dictionary.merged(cur, new).select("type", "name")


@query("SELECT 'place' AS type, n_name AS name FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 2")
def dict_scope(spark, sf):
    scope = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("n_nationkey") % 5).cast("int")))
    d = dictionary.cleaned(_table(spark, sf, "nation").select(F.lit("place").alias("type"), F.col("n_name").alias("name"), scope.alias("item_indices")))
    return dictionary.for_item(d, 2)


@query(f"""SELECT doc_id, etype, txt FROM (SELECT {K} AS doc_id, 'custom' AS etype, '联系人' AS txt FROM customer UNION ALL SELECT {K}, 'custom', 'mail.example' FROM customer UNION ALL SELECT {K}, 'phone', {_PHONE} FROM customer)""")
def custom_first(spark, sf):
    """The dictionary's name takes the e-mail address's place."""
    df = detect(_fixture(spark, sf, "contacts"), [("custom", "联系人"), ("custom", "mail.example")], only=["custom", "email", "phone"], entities=False)
    return sp.exploded(df).select("doc_id", "etype", "txt")


@query(f"SELECT {K} AS doc_id, 'phone' AS etype, {_PHONE} AS txt FROM customer UNION ALL SELECT {K}, 'word', '邮编' FROM customer")
def fill_gaps(spark, sf):
    """A model's spans only fill gaps: one begins before the phone number and ends in it."""
    df = detect(_fixture(spark, sf, "contacts"), only=["phone"], detectors=[models.stub_detector({"手机1": "word", "邮编": "word"})], entities=False)
    return sp.exploded(df).select("doc_id", "etype", "txt")


@query(f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS text FROM documents), o AS (SELECT DISTINCT * FROM a WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT * FROM a WHERE doc_id % 3 <> 1)
SELECT doc_id, 'email' AS type, count(*) FILTER (o.text IS NULL) AS added, count(*) FILTER (n.text IS NULL) AS removed, count(*) FILTER (o.text IS NOT NULL AND n.text IS NOT NULL) AS unchanged
FROM o FULL JOIN n USING (doc_id, text) GROUP BY doc_id""")
def snapshot_diff(spark, sf):
    found = report.snapshot(report.findings(patterns.with_pattern_spans(_docs(spark, sf), only=["email"], into="spans")))
    return report.snapshot_diff(found.filter("doc_id % 3 <> 0"), found.filter("doc_id % 3 <> 1"))


@query("SELECT doc_id, CASE WHEN c + l < 10 OR c >= l THEN 'chinese_bracket' ELSE 'english_bracket' END AS style FROM (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)")
def style_detect(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.placeholder_style(F.col("text")).alias("style"))


@query("SELECT doc_id, CASE WHEN n >= 200 THEN 'native' WHEN n < 50 OR doc_id % 2 = 0 THEN 'ocr' ELSE 'native' END AS route FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS n FROM documents)")
def scan_route(spark, sf):
    return _docs(spark, sf).select("doc_id", normalize.page_route(F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 0).alias("route"))


@query("SELECT doc_id // 3 AS doc_id, sum(length(trim(coalesce(text, '')))) < 80 * count(*) AS is_scanned FROM documents GROUP BY 1")
def scanned_classifier(spark, sf):
    """Three documents are the pages of one."""
    from veilspark.sources import files

    return files.scanned(_docs(spark, sf).select(F.expr("doc_id div 3").alias("doc_id"), (F.col("doc_id") % 3 + 1).alias("page_num"), F.coalesce("text", F.lit("")).alias("native_text")))


@query("""SELECT doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN greatest(8.0, (doc_id % 9) * 13.0 + 3) WHEN 1 THEN greatest(2.0, (doc_id % 9) * CAST(0.8 AS DOUBLE) + 1.5) WHEN 2 THEN greatest(2.0, n_chars / 100.0) ELSE greatest(1.0, n_chars / 200.0) END AS eta FROM documents""")
def eta(spark, sf):
    k = F.col("doc_id") % 4
    suffix = F.when(k < 2, ".pdf").when(k == 2, ".docx").otherwise(".txt")
    return _table(spark, sf, "documents").select("doc_id", normalize.eta_seconds(suffix, (F.col("doc_id") % 9).cast("double"), F.col("n_chars").cast("double"), k == 0).alias("eta"))


@query(f"SELECT p_partkey AS doc_id, concat('甲', {_s('p_size')}, '号楼', chr(10), chr(10), '第二段A座') AS text FROM part")
def normalize_linebreaks(spark, sf):
    return _fixture(spark, sf, "broken").select("doc_id", normalize.joined_lines(F.col("text")).alias("text"))


@query(f"SELECT p_partkey AS doc_id, concat('甲乙', {_s('p_size')}, '丙丁。', chr(10), '戊', {_s('p_size')}) AS text FROM part")
def ocr_fold(spark, sf):
    return _fixture(spark, sf, "scans").select("doc_id", normalize.fixed_ocr(F.col("text")).alias("text"))


@query("SELECT doc_id, text, CAST(greatest(1, 0) AS BIGINT) * len(text) AS n FROM (SELECT doc_id, text FROM documents)")
def chunks_rejoined(spark, sf):
    df = _docs(spark, sf).select("doc_id", normalize.chunked(F.col("text"), 3000, ("\n\n", "\n", "。", ". ")).alias("c"))
    text = F.array_join(F.transform("c", lambda c: c["chunk"]), "")
    return df.select("doc_id", text.alias("text"), F.aggregate("c", F.lit(0).cast("long"), lambda a, c: a + F.length(c["chunk"])).alias("n"))


@query(f"SELECT s_suppkey AS doc_id, concat({_PERSON}, {_s('s_suppkey')}) AS text, 'person' AS type FROM supplier")
def llm_json_parse(spark, sf):
    return _fixture(spark, sf, "replies").select("doc_id", F.inline(models.parsed_reply(F.col("text"))))


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 60 AS b FROM events),
n AS (SELECT *, CASE WHEN max(b) OVER w IS NULL OR a - max(b) OVER w > 3600 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, min(a) AS start, max(b) AS stop, count(*) AS n FROM i GROUP BY user_id, island""")
def merge_adjacent(spark, sf):
    e = _table(spark, sf, "events").select("user_id", F.unix_timestamp("ts").alias("a")).withColumn("b", F.col("a") + 60)
    return report.islands(e, ["user_id"], "a", "b", 3600).groupBy("user_id", "island").agg(F.min("a").alias("start"), F.max("b").alias("stop"), F.count("*").alias("n")).drop("island")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS y, 10.0 + o_orderkey % 7 AS h FROM orders),
n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY o_custkey ORDER BY y, o_orderkey) > greatest(avg(h) OVER (PARTITION BY o_custkey) * 0.5, 5.0) THEN 1 ELSE 0 END AS f FROM o),
r AS (SELECT o_custkey, o_orderkey, CAST(sum(f) OVER (PARTITION BY o_custkey ORDER BY y, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "row" FROM n)
SELECT o_custkey, o_orderkey, "row", CAST(row_number() OVER (PARTITION BY o_custkey, "row" ORDER BY o_orderkey) AS INT) AS place FROM r""")
def visual_rows(spark, sf):
    o = _table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("y_center"), (F.lit(10.0) + F.col("o_orderkey") % 7).alias("h"), F.col("o_orderkey").alias("x0"))
    return report.visual_rows(o, ["o_custkey"]).select("o_custkey", "o_orderkey", "row", "place")


@query("SELECT l_orderkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS median_quantity FROM lineitem GROUP BY l_orderkey")
def median_upper(spark, sf):
    rows = _table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return rows.select("l_orderkey", report.upper_median(F.col("v")).alias("median_quantity"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, CAST(floor(100 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS BIGINT) AS percent FROM orders")
def batch_progress(spark, sf):
    items = _table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"))
    return batch.progress(items)


@query("SELECT o_orderkey FROM orders WHERE TIMESTAMP '1998-01-01' - o_orderdate < CASE WHEN o_orderstatus = 'F' THEN INTERVAL 48 HOUR * 100 ELSE INTERVAL 24 HOUR * 300 END")
def expiry(spark, sf):
    o = _table(spark, sf, "orders")
    return batch.unexpired(o, "o_orderdate", F.lit("1998-01-01").cast("timestamp"), {"F": 4800, "O": 7200, "P": 7200}, "o_orderstatus").select("o_orderkey")


@query("SELECT o_orderkey AS idx, concat(o_orderstatus, ' 甲公司 ', o_orderpriority, ' 甲公司') AS restored_text, CAST(2 AS BIGINT) AS occurrences FROM orders")
def restore_report(spark, sf):
    t = _table(spark, sf, "orders").selectExpr("o_orderkey AS idx", "concat(o_orderstatus, ' [COMPANY_1] ', o_orderpriority, ' [COMPANY_1]') AS text")
    return batch.restore_report(t, [("[COMPANY_1]", "甲公司"), ("[COMPANY_10]", "乙公司")])


@query(f"""SELECT doc_id, type, text, CAST(rank AS INT) AS rank, greatest(0, n - 3) AS more FROM (
SELECT doc_id, 'email' AS type, m AS text, row_number() OVER (PARTITION BY doc_id ORDER BY min(strpos(text, m)), m) AS rank, count(*) OVER (PARTITION BY doc_id) AS n
FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) AS m FROM documents) GROUP BY doc_id, m) WHERE rank <= 3""")
def findings_top3(spark, sf):
    found = report.findings(patterns.with_pattern_spans(_docs(spark, sf), only=["email"], into="spans"))
    return report.top_examples(found).select("doc_id", "type", "text", "rank", "more")


@query("SELECT page_id, regexp_replace(concat('a b', chr(1), CAST(page_id AS VARCHAR(20)), '.pdf'), '[\\x00-\\x1f\\x7f]+', '_', 'g') AS name FROM pages")
def safe_filenames(spark, sf):
    return _table(spark, sf, "pages").selectExpr("page_id", "concat('dir/ a b', chr(1), CAST(page_id AS VARCHAR(20)), '.pdf. ') AS p").select("page_id", normalize.safe_filename(F.col("p")).alias("name"))


@query()
def masked_documents(spark, sf):
    """All documents through all layers, with default strategies."""
    return masks.masked(detect(_docs(spark, sf)), abbreviations="abbreviations", made=("masked_text", "replacements"), keep=["doc_id"])


@query()
def masked_documents_native(spark, sf):
    """All documents through the layers that are expressions alone."""
    return masks.masked(detect(_docs(spark, sf), entities=False), made=("masked_text", "replacements"), keep=["doc_id"])


@query()
def supported_types(spark, sf):
    return patterns.catalogue(spark)


def flagship(spark, sf_dir):
    """Masked text and number of findings of every document."""
    df = masks.masked(detect(_docs(spark, sf_dir)), abbreviations="abbreviations")
    return df.select("doc_id", "masked_text", F.size("log").alias("replacements"), F.to_json("mapping").alias("mapping"))


def queries():
    return Q | cases.Q


def oracle_sql():
    return SQL | cases.SQL
