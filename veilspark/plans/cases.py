"""Queries over made cases: each row of a driver table gets one of a query's texts by its key, and the SQL says what must
come out of it, so that every rule meets positives, negatives and borders.

In texts and results {k} is the row's key and {n} a line break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import layout, masks, normalize, patterns, spans as sp
from veilspark.operators import batch, dictionary, models, report
from veilspark.operators.detect import detect, reviewed_abbreviations
from veilspark.sources import files, sinks

Q: dict = {}
SQL: dict[str, str] = {}
K = "c_custkey"


def lit(x: str, key: str = K) -> str:
    """A SQL string of a text with {k} and {n}, for Spark and DuckDB."""
    if x == "":
        return "''"
    parts = []
    for k, by_key in enumerate(x.split("{k}")):
        parts += [f"CAST({key} AS VARCHAR(20))"] if k else []
        for j, by_line in enumerate(by_key.split("{n}")):
            parts += ["chr(10)"] if j else []
            parts += ["'" + by_line.replace("'", "''") + "'"] if by_line else []
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def chosen(values: list[str], key: str = K) -> str:
    return f"CASE CAST({key} % {len(values)} AS INT) " + " ".join(f"WHEN {k} THEN {lit(v, key)}" for k, v in enumerate(values)) + " END"


def dealt(df):
    """df on all cores: a small table is one split, and what follows is work on texts. One with as many splits as cores is
    left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def cases(name: str, made: Callable[[DataFrame], Column | DataFrame], *pairs: tuple[str, str], table: str = "customer", key: str = K) -> None:
    """Registers a query: texts by key, made() gives their result (a string column of a table with doc_id and text, or a
    table with doc_id and found)."""

    def run(spark, sf):
        docs = dealt(spark.read.parquet(f"{sf}/{table}.parquet").select(key)).selectExpr(f"{key} AS doc_id", f"{chosen([t for t, _ in pairs], key)} AS text")
        out = made(docs)
        return out.select("doc_id", "found") if isinstance(out, DataFrame) else docs.select("doc_id", out.alias("found"))

    run.__name__ = name
    Q[name], SQL[name] = run, f"SELECT {key} AS doc_id, {chosen([r for _, r in pairs], key)} AS found FROM {table}"


def listed(spans: Column, *fields: str) -> Column:
    """Spans as text: fields joined by colons, spans by bars."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", *(s[f].cast("string") for f in fields))), "|")


def pattern(*types: str):
    return lambda d: patterns.with_pattern_spans(d, only=list(types), into="spans").select("doc_id", listed(F.col("spans"), "txt").alias("found"))


def entities(**how):
    """Distinct names of the rules, as type:name, in order."""

    def made(d):
        found = detect(d, expand=False, **how).select("doc_id", F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["layer"] == "entity"), lambda s: F.concat_ws(":", s["etype"], s["txt"])))).alias("f"))
        return found.select("doc_id", F.array_join("f", "|").alias("found"))

    return made


def masking(dictionary=(), **how):
    def made(d):
        given = {k: how[k] for k in ("overrides", "everything", "style") if k in how}
        found = detect(d, list(dictionary), **{k: v for k, v in how.items() if k not in given})
        return masks.masked(found, abbreviations="abbreviations", made=("masked_text",), keep=["doc_id"], **given).withColumnRenamed("masked_text", "found")

    return made


# ---- tests in context (PF) and borders of patterns (PAT)
cases("pf_01_address_prefix", pattern("full_address"), ("住所地北京市朝阳区建国路{k}号", "北京市朝阳区建国路{k}号"), ("住所北京市朝阳区建国路{k}号", "北京市朝阳区建国路{k}号"), ("地址北京市朝阳区建国路{k}号", "北京市朝阳区建国路{k}号"), ("to 北京市朝阳区建国路{k}号", "北京市朝阳区建国路{k}号"))
cases("pf_02_court_addresses", pattern("full_address"), ("to 广东省深圳市南山区人民法院", ""), ("to 北京市海淀区上地三街9号", "北京市海淀区上地三街9号"), ("to 河北省某某县人民检察院", ""), ("to 江苏省苏州市干将路{k}号", "江苏省苏州市干将路{k}号"))
cases("pf_03_legal_addresses", pattern("full_address"), ("to 深圳市证券交易所大厦", ""), ("to 上海市上市公司监管路88号", ""), ("to 上海市黄浦区人民大道88号", "上海市黄浦区人民大道88号"))
cases("pf_04_securities_codes", pattern("postal_code"), ("证券代码：{n}200123", ""), ("股票简称某某 200123", ""), ("邮编200123", "200123"), ("股票代码" + "甲" * 31 + "200123", "200123"), ("基金代码 200123，", ""))
cases("pf_05_sums", pattern("postal_code"), ("共200123元", ""), ("共200123万元", ""), ("共200123，大约是5元", "200123"), ("共200123，约5元", ""), ("共200123", "200123"))
cases("pf_06_signs_after", pattern("postal_code"), ("见200123 x 2", ""), ("见200123+1", ""), ("见200123年", ""), ("见200123 日", ""), ("见200123 xa", ""), ("见200123 of", "200123"), ("见200123*", ""), ("见200123-1", ""))
cases("pf_07_signs_before", pattern("postal_code"), ("见(200123", ""), ("见（ 200123", ""), ("a=200123", ""), ("a - 200123", ""), ("a，200123", "200123"), ("a*  200123", ""), ("a*   200123", "200123"))
cases("pf_08_stock_prefixes", pattern("postal_code"), ("见600519", ""), ("邮编600519", "600519"), ("见000001。", ""), ("见300750，邮政", "300750"), ("见301000", ""), ("见610041", "610041"), ("见603288，邮区", "603288"))
cases("pf_09_projects", pattern("project_name"), ("to 管理系统，", ""), ("to 青山大桥项目，", "青山大桥项目"), ("to 本项目。", ""), ("to 智慧停车平台 x", "智慧停车平台"), ("to 网络投票平台，", ""), ("to 南水北调工程通知", ""), ("to 绿色校园计划{n}", "绿色校园计划"), ("to 行动计划；", ""))
cases("pf_10_patents", pattern("patent_number"), ("see CN1234 x", "CN1234"), ("see CN123 x", ""), ("专利申请号：A1.2", "专利申请号：A1.2"), ("see US1234567B2.", "US1234567B2"), ("商标注册号:9", "商标注册号:9"))
cases("pf_11_house_numbers", pattern("house_number"), ("住12号楼", "12号楼"), ("指导案例12号楼", ""), ("第12栋", ""), ("依公告住3室", ""), ("住3单元-2", "3单元-2"), ("第" + "甲" * 15 + "12栋", "12栋"), ("住{k}座", "{k}座"))
cases("pf_12_passports", pattern("passport"), ("P1234567 x", ""), ("护照 P1234567", "P1234567"), ("Passport P1234567", "P1234567"), ("G12345678", "G12345678"), ("P1234567" + "甲" * 51 + "签证", ""), ("P1234567，签证", "P1234567"), ("p7654321，旅行证件", "p7654321"))
cases("pf_13_cut_sums", pattern("amount", "price"), ("USD 12-3", ""), ("USD 125", "USD 125"), ("付￥12元-", "￥12元"), ("付12,500元", "12,500元"), ("付￥12-", ""), ("壹佰贰拾元整", "壹佰贰拾元整"), ("EUR 3.5，", "EUR 3.5"), ("x1人民币5", ""), ("x人民币5", "人民币5"))
cases("pf_14_articles", pattern("amount"), ("第2条第3元", ""), ("本条第3元", ""), ("第2条，付3元", "3元"), ("付3元", "3元"), ("前条所称第50元", ""))
for _name, _types, _pairs in (
    ("identity", ("id_card", "passport", "hk_macau_pass", "taiwan_pass"), (("9110101198503121234", ""), ("110101198513121234", ""), ("11010119850312123X。", "11010119850312123X"), ("aG12345678", ""), ("W12345678b", ""), ("w12345678，", "w12345678"), ("T12345678", "T12345678"), ("t123456789", ""), ("EA1234567", "EA1234567"))),
    ("registers", ("credit_code", "org_code", "tax_number", "military_id"), (("91{k}", ""), ("9112345601MA01ABC2", "9112345601MA01ABC2"), ("12345678-9", "12345678-9"), ("a12345678-X", "12345678-X"), ("123456789-X", ""), ("12345678901234", ""), ("123456789012345", "123456789012345"), ("士 字 第 1234 号", "士 字 第 1234 号"), ("军字第123号", ""))),
    ("documents", ("case_number", "contract_number", "invoice_number", "document_number", "permit_number", "property_cert"), (("(2024)粤03民终{k}号", "(2024)粤03民终{k}号"), ("〔2024〕1号", "〔2024〕1号"), ("(202)粤号", ""), ("合同编号：AB-12", "编号：AB-12"), ("合同编号：AB1", ""), ("合同编号：AB-123", "合同编号：AB-123"), ("Contract No. 12345-A", "Contract No. 12345-A"), ("Contract No. 12345", ""), ("Contract No: A12345", "Contract No: A12345"), ("发票代码:1234567", ""), ("发票号码:12345678", "发票号码:12345678"), ("编号：A12", ""), ("文件编号：A123", "文件编号：A123"), ("安全生产字第123号", "安全生产字第123号"), ("FH12345号", "FH12345号"))),
    ("contacts", ("phone", "fax", "toll_free", "email", "website", "social_account", "ip_address", "mac_address"), (("12812345678", ""), ("13812345678a", ""), ("x13812345678", "13812345678"), ("(010)12345678", "(010)12345678"), ("0755-1234567", "0755-1234567"), ("400 123 4567", "400 123 4567"), ("500-123-4567", ""), ("a@b", ""), ("a.b+c@d-e.co.uk，", "a.b+c@d-e.co.uk"), ("http://a.b/c，d", "http://a.b/c"), ("xwww.a.cn", ""), ("去www.a.cn/b", "www.a.cn/b"), ("QQ：12345", "QQ：12345"), ("加QQ12345", ""), ("WeChat: ab_12", "WeChat: ab_12"), ("微信ab", ""), ("1.2.3.256", ""), ("a10.0.0.7", "10.0.0.7"), ("110.0.0.256", ""), ("00-1a-2B-3c-4D-5e", "00-1a-2B-3c-4D-5e"))),
    ("money", ("bank_account", "amount", "price"), (("123456789012345", ""), ("1234567890123456", "1234567890123456"), ("户口號碼 12345678", "户口號碼 12345678"), ("账号：1234567", ""), ("1,234.50元", "1,234.50元"), ("12万元", "12万元"), ("¥ 8", "¥ 8"), ("HK$1,000.5", "HK$1,000.5"), ("8圆", ""), ("捌圆整", "捌圆整"), ("伍拾元贰角", "伍拾元贰角"))),
    ("things", ("license_plate", "vin"), (("粤B12345", "粤B12345"), ("粤B1234学", "粤B1234学"), ("粤b12345", ""), ("LSVAA49J1{k}", ""), ("LSVAA49J132047583", "LSVAA49J132047583"), ("LSVAA49J13204758O", ""), ("12345678901234567", "12345678901234567"))),
    ("times", ("date", "time", "datetime"), (("2024-3-5", "2024-3-5"), ("2024年3月5日 10:20:30", "2024年3月5日 10:20:30"), ("24-3-5", ""), ("10:5", ""), ("9时5分", ""), ("9时5分7秒", "9时5分7秒"), ("2024/12/31号", "2024/12/31号"), ("2024-3-5T10:20", "2024-3-5|10:20"))),
):
    cases(f"pat_borders_{_name}", pattern(*_types), *_pairs)
cases("pat_precedence", lambda d: patterns.with_pattern_spans(d, into="spans").select("doc_id", listed(F.col("spans"), "etype", "pos").alias("found")),
      ("110101198503121234", "id_card:0"), ("6222021234567890123", "bank_account:0"), ("12345678901234567", "vin:0"), ("2024-03-05 10:20", "datetime:0"), ("合同编号：AB12345", "contract_number:0"), ("123456789012345", "tax_number:0"), ("邮编200123，13812345678", "postal_code:2|phone:9"), ("x{k}y", ""))
SQL["supported_types"] = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s.etype}', {s.prio}, '{s.label}')" for k, s in enumerate(patterns.SPECS)) + ") AS t(seq, etype, prio, label)"

# ---- rule entities
cases("ent_01_organisations", entities(), *((f"由{n}出具", f"{k}:{n}") for k, n in (
    ("company", "杭州青禾软件有限公司"), ("company", "苏州澜舟软件有限责任公司"), ("company", "长沙启辰股份有限公司"), ("company", "云帆（深圳）供应链有限公司"), ("law_firm", "北京市康远律师事务所"), ("company", "立衡会计师事务所"), ("court", "广州市天河区人民法院"), ("court", "青岛市人民检察院"),
    ("government", "南京市公安局"), ("government", "成都市武侯区人民政府"), ("institution", "江南大学"), ("institution", "青山医院"), ("institution", "北辰研究所"), ("bank_name", "江州银行"), ("company", "晨光基金会"), ("company", "长岭商会"), ("company", "九州出版社"), ("company", "同德大药房"), ("institution", "明德小学"), ("government", "城东街道办事处"),
)))
cases("ent_03_vetoes", entities(only=["company"]), ("x目标公司y", ""), ("科技有限公司", ""), ("由审计委员会决定", ""), ("由财务中心办理", ""), ("星河中心大厦", ""), ("原审人民法院", ""), ("寿保险有限公司", ""), ("全国商业银行", ""), ("号楼青山学院", ""), ("由人民法院扣银行", ""), ("x管理委员会", ""), ("由杭州青禾软件有限公司签", "company:杭州青禾软件有限公司"))
cases("ent_04_short_companies", entities(only=["company"]), ("由长风公司付款", "company:长风公司"), ("由子公司付款", ""), ("由其全资子公司付", ""), ("由云海物流公司付", "company:云海物流公司"), ("由本公司付", ""), ("云海公司律师付", ""))
cases("ent_05_cleaning", entities(only=["company"]), ("原告张三诉被告北京示例软件有限公司", "company:北京示例软件有限公司"), ("普洛股份有限公司北京市康达律师事务所", "company:普洛股份有限公司|law_firm:北京市康达律师事务所"), ("判决解除云海置地有限公司", "company:云海置地有限公司"), ("持有的远山木业有限公司", "company:远山木业有限公司"), ("和风数据有限公司", "company:和风数据有限公司"), ("和风木业有限公司", "company:风木业有限公司"), ("肥宁波济南昆明南昌北京市康达律师事务所", "law_firm:北京市康达律师事务所"), ("第二条青山木业有限公司", "company:青山木业有限公司"))
cases("ent_06_foreign", entities(), ("by Acme Legal Services, Inc. today", "company:Acme Legal Services, Inc."), ("The Company", ""), ("with Blue River Trading Ltd.", "company:Blue River Trading Ltd."), ("see Nordwind GmbH, a firm", "company:Nordwind GmbH"), ("an inc. b", ""))
cases("ent_07_roles", entities(only=["person"]), ("原告：刘明，", "person:刘明"), ("原告{n}刘明，", ""), ("审判长 王建国{n}", "person:王建国"), ("证人、欧阳修文，", "person:欧阳修文"), ("原告：法院，", ""), ("被告：东方红，", "person:东方红"))
cases("ent_08_adjacent_roles", entities(only=["person"]), ("被告人刘明，由", "person:刘明"), ("被告刘明犯罪", "person:刘明"), ("监事窦文涛的", "person:窦文涛"), ("监事某某某的", ""))
cases("ent_09_named_roles", entities(only=["person"]), ("法定代表人为郑友妹，", "person:郑友妹"), ("总经理是狄云。", "person:狄云"), ("联系人系卞之琳，", "person:卞之琳"), ("联系人系今天，", ""))
cases("ent_10_reversed", entities(only=["person"]), ("周岩亦系公司董事长", "person:周岩"), ("与饶平为监事", "person:饶平"), ("沈语是本案证人", "person:沈语"), ("苹果是本案证人", ""))
cases("ent_11_defined_people", entities(only=["person"]), ("周岩（身份证略，以下简称甲某）", "person:周岩"), ("周岩（略）", ""), ("，房玄（下称，简称房）", "person:房玄"))
cases("ent_12_signed", entities(only=["person"]), ("签名：周岩", "person:周岩"), ("落款: 宗泽", "person:宗泽"), ("签字：今日", ""))
cases("ent_13_bench", entities(only=["person"]), ("审 判 长：王 建 国{n}书 记 员：李 雷", "person:李 雷|person:王 建 国"), ("审判员 封 云，", "person:封 云"))
cases("ent_14_several", entities(only=["person"]), ("周岩、沈语分别担任公司董事", "person:周岩|person:沈语"), ("解珍和车胜任股东", "person:解珍|person:车胜"))
cases("ent_15_role_lists", entities(only=["person"]), ("股东为周岩、沈语。", "person:周岩|person:沈语"), ("董事是牛皋，", "person:牛皋"), ("股东为甲某。", ""))
cases("ent_16_titles", entities(only=["person"]), ("周岩，男，汉族", "person:周岩"), ("沈语（女，", "person:沈语"), ("，景阳先生", "person:景阳"), ("见景阳先生", ""), ("见今天先生", ""))
cases("ent_17_signs", entities(only=["person"]), ("周岩身份证号略", "person:周岩"), ("沈语（签字）", "person:沈语"), ("甲方：宁远，", "person:宁远"), ("判处石坚有期徒刑", "person:石坚"), ("周岩向长岭区法院", "person:周岩"))
cases("ent_18_surnames", entities(only=["person"]), *((f"证人：{n}，", f"person:{n}") for n in ("窦娥", "狄青", "卞和", "饶雪", "房遗", "解晋", "宗悫", "封德", "车臣", "牛郎", "景差", "燕青", "冀州生", "司马迁", "上官云", "诸葛亮生")), ("证人：曌云，", ""), ("证人：如下，", ""))
cases("ent_19_split", entities(only=["person"]), ("保荐代表人：江海伊王飞{n}", "person:江海伊|person:王飞"), ("经办律师：欧阳修文沈语。", "person:欧阳修文|person:沈语"), ("签字会计师：曌云曌雨。", ""))
cases("ent_20_definitions", lambda d: detect(d).select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("abbreviations"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|").alias("found")),
      ("杭州青禾软件有限公司（以下简称“青禾”）", "青禾=杭州青禾软件有限公司"), ("苏州澜舟有限公司(下称\"澜舟\"或\"澜舟公司\")", "澜舟=苏州澜舟有限公司|澜舟公司=苏州澜舟有限公司"), ("甲乙科贸有限公司与丙丁实创有限公司（简称“丙丁”）", "丙丁=丙丁实创有限公司"), ("戊己有限公司称“市场环境”", ""), ("戊己有限公司（称为“戊己”）", "戊己=戊己有限公司"),
      ("甲乙科贸有限公司（简称“目标”）。丙丁实创有限公司（简称“目标”）。", ""), ("甲乙科贸有限公司（简称“发行人”）", ""), ("甲乙科贸有限公司。（简称“甲乙”）", ""))
SQL["ent_21_22_23_claims"], Q["ent_21_22_23_claims"] = SQL["ent_20_definitions"], Q["ent_20_definitions"]
cases("ent_24_gates_only_kind", entities(only=["law_firm"]), ("由北京市康远律师事务所出具", ""), ("由广州市天河区人民法院出具", ""))
cases("ent_24_gates_company", entities(only=["company"]), ("由广州市天河区人民法院出具", "court:广州市天河区人民法院"), ("证人：周岩，", ""))
cases("ent_24_gates_exclude", entities(exclude=["court"]), ("由广州市天河区人民法院出具", "court:广州市天河区人民法院"), ("由江州银行出具", "bank_name:江州银行"))
cases("dic_06_spaced_names", lambda d: sp_found(detect(d, [("person", "王建国")])), ("王 建 国与王建国", "person:王 建 国|person:王建国"), ("王建 国，", "person:王建 国"), ("王x建国", ""))
cases("dic_07_without_entities", lambda d: sp_found(detect(d, entities=False)), ("原告周岩，电话13812345678", "phone:13812345678"), ("由杭州青禾软件有限公司付", ""))
cases("dic_types", lambda d: sp_found(detect(d, [("code", "AB1"), ("word", "x")], only=["code", "phone"], entities=False)), ("AB1 x 13812345678", "code:AB1|phone:13812345678"), ("xAB1AB1", "code:AB1|code:AB1"))


def sp_found(df: DataFrame) -> DataFrame:
    return df.select("doc_id", listed(F.col("spans"), "etype", "txt").alias("found"))


# ---- fusion
def model(*found):
    """A layer that finds these words as types."""
    return models.stub_detector(dict(found))


cases("mrg_02_arbitration", lambda d: sp_found(detect(d, arbiter=model(("长风木业公司", "company"), ("周岩", "person"), ("周岩岩", "person"), ("青山路3号楼", "full_address"), ("13812345678", "person")), expand=False)),
      ("原告：周岩岩，", "person:周岩岩"), ("x青山路3号楼", "full_address:青山路3号楼"), ("t 13812345678", "phone:13812345678"), ("by 长风木业公司", "company:长风木业公司"))
cases("mrg_03_gaps", lambda d: sp_found(detect(d, entities=False, detectors=[model(("Jane Roe", "person"), ("345", "secret")), model(("Roe x", "person"), ("x", "other"))])), ("Jane Roe 13812345678", "person:Jane Roe|phone:13812345678"), ("Jane Roe x", "person:Jane Roe|other:x"), ("345", "secret:345"))
cases("mrg_04_same_names", lambda d: sp_found(detect(d, only=["person"])), ("原告：周岩，后周岩又说周岩。", "person:周岩|person:周岩|person:周岩"), ("证人：沈语，沈语语", "person:沈语|person:沈语"))
cases("mrg_05_brands", masking(only=["company"], everything="placeholder"), ("由深圳市长风（北京）融资租赁有限公司付，长风付", "由[COMPANY_1]付，[COMPANY_2]付"), ("由北京银行付，北京付", "由[BANK_NAME_1]付，北京付"), ("由云海物流有限公司付，云海付", "由[COMPANY_1]付，[COMPANY_2]付"))
cases("mrg_06_custom_first", lambda d: sp_found(detect(d, [("mine", "长风融资")])), ("由长风融资租赁有限公司付", "mine:长风融资"), ("见长风融资", "mine:长风融资"))
cases("mrg_08_reviewed", lambda d: masks.masked(reviewed_abbreviations(detect(d).withColumn("own", F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("map<string,string>")).when(F.col("doc_id") % 3 == 1, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.create_map(F.lit("青禾"), F.lit("苏州澜舟有限公司")))), "own"), abbreviations="abbreviations", made=("masked_text",)).select("doc_id", F.col("masked_text").alias("found")),
      *[("由苏州澜舟有限公司（简称“青禾”）付", r) for r in ("由[COMPANY_1]（简称“[COMPANY_1_ABBR]”）付", "由[COMPANY_1]（简称“[COMPANY_2]”）付", "由[COMPANY_1]（简称“[COMPANY_1_ABBR]”）付")])

# ---- masks
cases("msk_03_partial", masking(entities=False, everything="partial", dictionary=[("person", "张三丰"), ("company", "深圳某某物流有限公司"), ("court", "长岭法院"), ("vin", "LSV12"), ("secret", "abc")]), ("手机13812345678", "手机138******78"), ("138 110101198503121234", "138 110*************34"), ("座机0755-1234567", "座机075*-*****67"), ("a@b.cn wxyz@b.cn", "*@b.cn wx**@b.cn"), ("卡6222021234567890123", "卡6222***********0123"), ("G12345678", "G1*****78"), ("粤B12345，", "粤B****5，"), ("张三丰见", "张**见"),
      ("由深圳某某物流有限公司付", "由深*****有限公司付"), ("见长岭法院", "见[COURT_1]"), ("x LSV12", "x *****"), ("x abc", "x ***"), ("付50元。", "付***。"), ("电400-123-4567", "电400-***-**67"), ("91123456MA01ABCD2X", "9112**********CD2X"))
cases("msk_04_numbers", masking(entities=False, everything="placeholder"), ("13812345678、13912345678、13812345678", "[PHONE_1]、[PHONE_2]、[PHONE_1]"), ("400-123-4567与13812345678", "[PHONE_1]与[PHONE_2]"), ("a@b.cn，ab@b.cn，abc@b.cn", "[EMAIL_3]，[EMAIL_2]，[EMAIL_1]"), ("2024-01-01至2024-01-02至2024-01-03", "[DATE_1]至[DATE_2]至[DATE_3]"))
cases("msk_06_styles", masking(entities=False, everything="placeholder", style="chinese_angle"), ("13812345678、13912345678", "<电话1>、<电话2>"), ("CN1234567", "<专利号1>"))
cases("msk_07_longest_first", masking(entities=False, everything="placeholder", dictionary=[("a", "甲乙"), ("b", "乙丙丁"), ("c", "丁戊")]), ("甲乙丙丁戊", "甲[UNKNOWN_1]戊"), ("甲乙丁戊", "[UNKNOWN_1][UNKNOWN_2]"))
cases("msk_09_log", lambda d: masks.masked(detect(d, entities=False), everything="placeholder").select("doc_id", listed(F.col("log"), "position", "masked_text", "context_before", "context_after").alias("found")), ("a 13812345678 b@c.cn d", "14:[EMAIL_1]:a 13812345678 : d|2:[PHONE_1]:a : [EMAIL_1] d"), ("x", ""))


def seeded(d):
    fact = lambda t, o: F.struct(F.lit(t).alias("type"), F.lit(o).alias("original"), F.lit(False).alias("is_abbreviation"), F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("full_placeholder"))
    seed = F.create_map(F.lit("[PHONE_1]"), fact("phone", "13912345678"), F.lit("[PHONE_3]"), fact("phone", "13712345678"))
    return masks.masked(detect(d, entities=False).withColumn("seed", seed), everything="placeholder", seed="seed").select("doc_id", F.col("masked_text").alias("found"))


cases("msk_11_seeds", seeded, ("13812345678 13912345678", "[PHONE_2] [PHONE_1]"), ("13712345678", "[PHONE_3]"), ("13512345678 13612345678 13812345678", "[PHONE_2] [PHONE_4] [PHONE_5]"))
SQL["msk_12_kept_numbers"], Q["msk_12_kept_numbers"] = SQL["msk_11_seeds"], Q["msk_11_seeds"]
cases("msk_14_file_names", lambda d: masks.masked(detect(d, [("person", "周岩"), ("x", "甲")], entities=False), everything="placeholder").select("doc_id", sinks.masked_name(F.concat(F.col("text"), F.lit(".docx")), F.col("mapping")).alias("found")), ("周岩13812345678", "[PERSON_1][PHONE_1].docx"), ("甲周岩", "甲[PERSON_1].docx"), ("none", "none.docx"))
cases("agg_06_counters", lambda d: masks.masked(detect(d, entities=False), everything="placeholder").select("doc_id", F.concat_ws("/", F.size("spans"), F.size("mapping"), F.size("log")).alias("found")), ("13812345678 13812345678", "2/1/2"), ("13812345678 a@b.cn", "2/2/2"), ("x", "0/0/0"))
cases("agg_08_used_placeholders", lambda d: masks.masked(detect(d, entities=False), everything="placeholder").select("doc_id", F.size(F.array_distinct(F.transform("log", lambda x: x["masked_text"]))).cast("string").alias("found")), ("13812345678 13812345678", "1"), ("13812345678 a@b.cn c@d.cn", "3"), ("x", "0"))
cases("rst_01_restored", lambda d: masks.restored(d.withColumn("mapping", F.from_json(F.lit('{"[A_1]":{"original":"甲"},"[A_10]":{"original":"乙"},"[B]":{"original":""}}'), f"map<string,{masks.FACT}>")), "mapping", "text").select("doc_id", F.col("restored_text").alias("found")), ("[A_1][A_10][B]", "甲乙[B]"), ("x{k}", "x{k}"), ("[A_10]1", "乙1"))

# ---- batches
_MASKED_BATCH = "SELECT CAST(o_orderkey AS BIGINT) AS idx, 'done' AS status, CASE WHEN n = 1 THEN concat('电话[PHONE_', p, ']，周岩') ELSE concat('[PHONE_', p, ']') END AS masked_text FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY f) AS VARCHAR) AS p FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey % 3) AS f FROM orders))"


def bat_02_in_order(spark, sf):
    """A batch for each customer: the numbers follow the order of first appearance, and equal numbers are equal names."""
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS batch", "o_orderkey AS idx", "concat('1380000000', CAST(o_orderkey % 3 AS INT)) AS p", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n")
    items = o.selectExpr("batch", "idx", "CASE WHEN n = 1 THEN concat('电话', p, '，周岩') ELSE p END AS text")
    return batch.masked_in_order(items, "batch", everything="placeholder", entities=False).select("idx", "status", "masked_text")


Q["bat_02_in_order"], SQL["bat_02_in_order"] = bat_02_in_order, _MASKED_BATCH


def bat_03_updated(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("concat('[N_', CAST(n_nationkey AS VARCHAR(20)), ']') AS placeholder", "n_name AS original", "n_nationkey AS k")
    return batch.updated(n.filter("k < 15").drop("k"), n.filter("k > 9").selectExpr("placeholder", "lower(original) AS original"))


Q["bat_03_updated"], SQL["bat_03_updated"] = bat_03_updated, "SELECT concat('[N_', CAST(n_nationkey AS VARCHAR(20)), ']') AS placeholder, CASE WHEN n_nationkey > 9 THEN lower(n_name) ELSE n_name END AS original FROM nation"


def bat_01_isolated(spark, sf):
    def failing(texts):
        if texts[0].endswith("0"):
            raise ValueError("bad")
        return [[] for _ in texts]

    items = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_nationkey AS batch", "c_custkey AS idx", "concat('13800000000 ', CAST(c_custkey AS VARCHAR(20))) AS text")
    return batch.masked_in_order(items, "batch", everything="placeholder", entities=False, detectors=[failing]).select("idx", "status", F.coalesce("masked_text", F.lit("")).alias("masked_text"))


Q["bat_01_isolated"], SQL["bat_01_isolated"] = bat_01_isolated, "SELECT CAST(c_custkey AS BIGINT) AS idx, CASE WHEN c_custkey % 10 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('[PHONE_1] ', CAST(c_custkey AS VARCHAR(20))) END AS masked_text FROM customer"


def bat_04_reviewed(spark, sf):
    items = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("CAST(n_nationkey AS INT) AS batch", "CAST(n_nationkey AS BIGINT) AS idx", "concat('13800000000 ', n_name) AS text")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    review = n.selectExpr("CAST(n_nationkey AS BIGINT) AS idx", "CASE CAST(n_nationkey % 3 AS INT) WHEN 0 THEN 'deleted' WHEN 1 THEN 'custom' ELSE 'edited' END AS action", "CASE WHEN n_nationkey % 3 = 1 THEN 'place' ELSE 'phone' END AS type", "CASE WHEN n_nationkey % 3 = 1 THEN n_name ELSE '13800000000' END AS name", "concat('13800000000 ', n_name) AS new_name")
    scoped, excluded = batch.reviewed(report.findings(detect(items, entities=False), "idx"), review)
    return batch.masked_in_order(items, "batch", everything="placeholder", entities=False, scoped=scoped, excluded=excluded, only=["phone", "place"]).select("idx", F.regexp_replace("masked_text", r"\[([A-Z]+)_[0-9]+\]", "[$1]").alias("masked_text"))


Q["bat_04_reviewed"], SQL["bat_04_reviewed"] = bat_04_reviewed, "SELECT CAST(n_nationkey AS BIGINT) AS idx, CASE CAST(n_nationkey % 3 AS INT) WHEN 0 THEN concat('13800000000 ', n_name) WHEN 1 THEN '[PHONE] [UNKNOWN]' ELSE '[PHONE]' END AS masked_text FROM nation"


def bat_07_relations(spark, sf):
    r = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("' company ' AS type", "concat(n_name, ' ') AS full_name", "CASE CAST(n_nationkey % 4 AS INT) WHEN 0 THEN n_name WHEN 1 THEN '' WHEN 2 THEN repeat('x', 501) ELSE substr(n_name, 1, 2) END AS abbreviation")
    return batch.relations_cleaned(r.union(r))


Q["bat_07_relations"], SQL["bat_07_relations"] = bat_07_relations, "SELECT DISTINCT 'company' AS type, n_name AS full_name, substr(n_name, 1, 2) AS abbreviation FROM nation WHERE n_nationkey % 4 = 3"


def bat_02_global(spark, sf):
    """Masked texts with one mapping for all suppliers: numbers by length, then name."""
    items = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS idx", "concat('见', CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '周岩' WHEN 1 THEN '沈语' ELSE '欧阳修文' END, '和', CASE CAST(s_suppkey % 2 AS INT) WHEN 0 THEN '青禾公司' ELSE '澜舟' END) AS text")
    return batch.run_global(items, [("person", "周岩"), ("person", "沈语"), ("person", "欧阳修文"), ("company", "青禾公司"), ("company", "澜舟")], entities=False)[0]


Q["bat_02_global"], SQL["bat_02_global"] = bat_02_global, "SELECT s_suppkey AS idx, concat('见[PERSON_', CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '1' END, ']和[COMPANY_', CASE CAST(s_suppkey % 2 AS INT) WHEN 0 THEN '1' ELSE '2' END, ']') AS masked_text FROM supplier"


def rst_03_report(spark, sf):
    """300 placeholders, each in the text of one customer."""
    t = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS idx", "concat('a [NAME_', CAST(c_custkey % 300 + 1 AS VARCHAR(20)), '] b [NAME_1]') AS text")
    return batch.restore_report(t, [(f"[NAME_{k}]", f"名{k}") for k in range(1, 301)])


Q["rst_03_report"], SQL["rst_03_report"] = rst_03_report, "SELECT c_custkey AS idx, concat('a 名', CAST(c_custkey % 300 + 1 AS VARCHAR(20)), ' b 名1') AS restored_text, CAST(2 AS BIGINT) AS occurrences FROM customer"


# ---- model spans
def raw(*rows: tuple[str, int, str, float]) -> str:
    return "|".join(f"{a}~{b}~{c}~{d}" for a, b, c, d in rows)


def spans_of(text: Column) -> Column:
    part = lambda x: F.split(x, "~")
    return F.transform(F.filter(F.split(F.element_at(F.split(text, "#"), 1), r"\|"), lambda x: x != ""), lambda x: F.struct(part(x)[0].alias("label"), part(x)[1].cast("int").alias("pos"), part(x)[2].alias("txt"), part(x)[3].cast("double").alias("score")))


def of_model(rule):
    """Cases are raw spans, #, and the text."""
    return lambda d: listed(rule(spans_of(F.col("text")), F.element_at(F.split(F.col("text"), "#"), -1)), "label", "pos", "txt")


cases("ner_02_usable", of_model(lambda s, t: models.usable(s)), (raw(("B-name", 0, "王明", 0.9), ("name", 3, "王", 0.9), ("E-name", 4, "李雷", 0.69)) + "#", "name:0:王明"), (raw(("S-company", 0, " a ", 0.9), ("I-x", 2, "ab", 0.7)) + "#", "x:2:ab"))
cases("ner_03_glued", of_model(lambda s, t: models.glued_surnames(s)), (raw(("position", 0, "欧阳", 0.9), ("name", 2, "修文", 0.8)) + "#", "name:0:欧阳修文"), (raw(("position", 0, "经理", 0.9), ("name", 2, "修文", 0.8)) + "#", "position:0:经理|name:2:修文"), (raw(("position", 0, "欧阳", 0.9), ("name", 3, "修文", 0.8)) + "#", "position:0:欧阳|name:3:修文"))
cases("ner_04_plausible", of_model(lambda s, t: models.plausible(models.typed(s, models.NER_TYPES))), (raw(("name", 0, "王的", 0.9), ("name", 3, "王明", 0.9), ("company", 6, "Delaware", 0.9), ("book", 9, "红楼", 0.9)) + "#", "person:3:王明"), (raw(("government", 0, "人民法院", 0.9), ("organization", 5, "第三条法院", 0.9), ("address", 9, "青山路", 0.9)) + "#", "full_address:9:青山路"))
cases("ner_05_types", of_model(lambda s, t: models.typed(s, models.PII_TYPES)), (raw(("private_person", 0, "Jo", 0.9), ("secret", 3, "k", 0.9), ("other", 5, "x", 0.9)) + "#", "person:0:Jo|secret:3:k"), (raw(("account_number", 0, "12", 0.9), ("private_url", 3, "a.b", 0.9)) + "#", "bank_account:0:12|website:3:a.b"))
cases("ner_06_anchored", of_model(lambda s, t: models.anchored(s, t)), (raw(("person", 0, "，Jo ，", 0.9), ("phone", 5, "1。", 0.9)) + "#，Jo ，1。", "person:1:Jo"), (raw(("person", 0, "王明", 0.9), ("email", 2, "?????", 0.9)) + "#王明 a@b；", "email:3:a@b"))
cases("ner_07_neighbours", of_model(lambda s, t: models.merged_neighbours(s, t)), (raw(("phone", 0, "138", 0.9), ("phone", 4, "12", 0.8)) + "#138-12", "phone:0:138-12"), (raw(("phone", 0, "138", 0.9), ("email", 4, "12", 0.8)) + "#138-12", "phone:0:138|email:4:12"), (raw(("phone", 0, "138", 0.9), ("phone", 4, "12", 0.8)) + "#138x12", "phone:0:138|phone:4:12"), (raw(("phone", 0, "1", 0.9), ("phone", 5, "2", 0.9)) + "#1    2", "phone:0:1|phone:5:2"), (raw(("a", 0, "1", 0.9), ("a", 2, "2", 0.9), ("a", 4, "3", 0.9)) + "#1 2@3", "a:0:1 2@3"))
cases("ner_08_urls", of_model(lambda s, t: models.joined_urls(s)), (raw(("website", 0, "https", 0.9), ("secret", 5, "://x", 0.9)) + "#", "website:0:https://x"), (raw(("website", 0, "a.b", 0.9), ("secret", 3, "x", 0.9)) + "#", "website:0:a.b|secret:3:x"), (raw(("website", 0, "a.b", 0.9), ("secret", 4, "/x", 0.9)) + "#", "website:0:a.b|secret:4:/x"))
cases("ner_09_extended", of_model(lambda s, t: models.extended(s, t)), (raw(("phone", 0, "12", 0.9)) + "#12-3 - x", "phone:0:12-3"), (raw(("secret", 0, "ab", 0.9)) + "#ab_c.d+e", "secret:0:ab_c.d"), (raw(("website", 0, "a.b", 0.9)) + "#a.b/c?d=1+@（", "website:0:a.b/c?d=1+@"), (raw(("phone", 0, "12- ", 0.9)) + "#12- +", "phone:0:12- "), (raw(("email", 0, "a@b", 0.9)) + "#a@bc", "email:0:a@b"))
cases("ner_10_distinct", of_model(lambda s, t: models.in_order(s)), (raw(("b", 5, "y", 0.9), ("a", 1, "x", 0.9), ("b", 5, "y", 0.9)) + "#", "a:1:x|b:5:y"), (raw(("a", 1, "x", 0.9), ("b", 1, "x", 0.9)) + "#", "a:1:x|b:1:x"))
cases("ner_13_everywhere", lambda d: F.array_join(F.transform(models.everywhere(F.split(F.col("text"), "#")[0], F.split(F.col("text"), "#")[1]), lambda p: p.cast("string")), ","), ("aaa#aa", "0,1"), ("abcab#ab", "0,3"), ("abc#x", ""), ("王明王明#王明", "0,2"))

# ---- normalisation, layout, sources, sinks
cases("nrm_02_joined_names", lambda d: normalize.joined_names(F.col("text")), ("长风木业{n}有限公司付", "长风木业有限公司付"), ("长风{n}木业有限公司付", "长风木业有限公司付"), ("他已付{n}款。", "他已付款。"), ("他已付。{n}款。", "他已付。{n}款。"))
cases("nrm_05_cuts", lambda d: listed(normalize.chunked(F.col("text"), 10, ("\n\n", "\n", "。", "；")), "offset", "chunk"), ("一二三四五六七。九十一二", "0:一二三四五六七。|8:九十一二"), ("一。三四五六七八九十一二", "0:一。三四五六七八九十|10:一二"), ("一二三四五六{n}八。十一", "0:一二三四五六{n}|7:八。十一"), ("一二三", "0:一二三"))
cases("nrm_06_lines", lambda d: listed(normalize.document_lines(F.col("text")), "title", "line"), ("第一章{n}正文{n}==========", "true:第一章|false:正文"), ("一、概况{n}第 3 页{n}民事判决书", "true:一、概况|true:民事判决书"), (" {n}1. 说明{n}" + "长" * 23 + "合同", "true:1. 说明|true:" + "长" * 23 + "合同"), ("长" * 24 + "合同", "false:" + "长" * 24 + "合同"))
cases("nrm_07_marks", lambda d: normalize.folded_marks(F.col("text")), ("【甲】《乙》＜丙＞，。；：！？", "<甲><乙><丙>,.;:!?"), ("（{k}）", "（{k}）"))
cases("src_03_fields", lambda d: F.regexp_replace(F.col("text"), files.FIELD_CODES, ""), ("见HYPERLINK http://a.b 甲", "见 甲"), ("HYPERLINK", ""), ("无", "无"))
cases("src_08_scores", lambda d: listed(layout.kept_lines(F.transform(F.split(F.col("text"), ","), lambda x: F.struct(F.split(x, "=")[0].alias("t"), F.split(x, "=")[1].cast("double").alias("score"))), 0.5, True), "t"), ("a=0.9,b=0.5,c=0.51", "a|c"), ("a=0.1,b=0.5", "a|b"))
cases("src_09_scores", lambda d: listed(layout.kept_lines(F.transform(F.split(F.col("text"), ","), lambda x: F.struct(F.split(x, "=")[0].alias("t"), F.split(x, "=")[1].cast("double").alias("score"))), 0.6, False), "t"), ("a=0.9,b=0.6,c=0.61", "a|c"), ("a=0.1,b=0.5", ""))
cases("src_13_accepted", lambda d: files.accepted(d.select("doc_id", F.concat(F.lit("/in/"), "text").alias("path"), (F.col("doc_id") * 400_000).alias("length"))).select("doc_id", F.when((F.col("doc_id") * 400_000 <= 50 << 20), F.col("status")).otherwise(F.concat(F.lit("large "), "status")).alias("found")), ("a.TXT", "?"), ("b.exe", "?"))
SQL["src_13_accepted"] = f"SELECT {K} AS doc_id, CASE WHEN {K} * 400000 <= 52428800 THEN CASE WHEN {K} % 2 = 0 THEN 'accepted' ELSE 'rejected' END ELSE 'large rejected' END AS found FROM customer"
cases("src_14_peek", lambda d: files.peek_parts(F.split(F.col("text"), ","), 3, 8), ("abc,def,ghi,jkl", "abc{n}def{n}"), ("a,b", "a{n}b"), ("{k},b,c,d,e", "{k}{n}b{n}c"))
cases("snk_03_names", lambda d: sinks.relative_name(F.col("text"), "file:///data/in"), ("file:/data/in/x/a.txt", "x/a.txt"), ("/data/in/y/a.txt", "y/a.txt"), ("/other/{k}.txt", "other/{k}.txt"), ("", "file"), ("/data/in/../b.md", "_/b.md"))
cases("snk_11_common", lambda d: layout.common_part(F.split(F.col("text"), "#")[0], F.split(F.col("text"), "#")[1]), ("长风木业#见长风木", "长风木"), ("abcd#xxbcxx", "bc"), ("ab#cd", ""), ("a#a", ""), ("abab#ab", "ab"))
cases("snk_12_least", lambda d: layout.least_match(F.col("text")).cast("string"), ("AB12345", "4"), ("周岩", "2"), ("长风木", "3"), ("长风木业公司", "3"), ("A1", "4"))
cases("snk_14_offsets", lambda d: layout.pixel_offset(F.col("text"), F.lit(2), F.lit(10.0), F.lit(70.0)).cast("int").cast("string"), ("甲乙丙", "50"), ("ab甲乙", "30"), ("abcdef", "30"))


def snk_08_boxes(spark, sf):
    chars = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS e", "l_linenumber AS place", "10.0 * l_linenumber AS x0", "CASE WHEN l_linenumber > 4 THEN 20.0 WHEN l_linenumber > 2 THEN 1.5 ELSE 0.0 END AS y0", "10.0 * l_linenumber + 8 AS x1", "12.0 AS y1")
    return layout.entity_boxes(chars.selectExpr("e", "place", "CAST(x0 AS DOUBLE) AS x0", "CAST(y0 AS DOUBLE) AS y0", "CAST(x1 AS DOUBLE) AS x1", "CAST(y1 AS DOUBLE) AS y1"), ["e"]).select("e", "x0", "y0", "x1")


Q["snk_08_boxes"], SQL["snk_08_boxes"] = snk_08_boxes, "SELECT l_orderkey AS e, CAST(min(10.0 * l_linenumber) AS DOUBLE) AS x0, CAST(min(CASE WHEN l_linenumber > 4 THEN 20.0 WHEN l_linenumber > 2 THEN 1.5 ELSE 0.0 END) AS DOUBLE) AS y0, CAST(max(10.0 * l_linenumber + 8) AS DOUBLE) AS x1 FROM lineitem GROUP BY l_orderkey, l_linenumber > 4"


def snk_13_near(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey", "o_orderkey", "CAST(o_totalprice / 100 AS DOUBLE) AS y", "o_orderkey % 4 AS m")
    return layout.near_rows(o, o.filter("m = 0").select("o_custkey", "y"), ["o_custkey"], 100.0).select("o_custkey", "o_orderkey")


Q["snk_13_near"], SQL["snk_13_near"] = snk_13_near, "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice / 100 AS DOUBLE) AS y, o_orderkey % 4 AS m FROM orders) SELECT o_custkey, o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM o p WHERE p.o_custkey = o.o_custkey AND p.m = 0 AND abs(p.y - o.y) <= 100)"


def src_11_all_pages(spark, sf):
    p = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 50).alias("doc_id"), F.when(F.col("doc_id") % 50 < 25, F.col("text")).otherwise(F.lit("x")).alias("native_text"))
    return files.scanned_in_all(p)


Q["src_11_all_pages"], SQL["src_11_all_pages"] = src_11_all_pages, "SELECT doc_id % 50 AS doc_id, sum(CASE WHEN doc_id % 50 < 25 THEN length(trim(coalesce(text, ''))) ELSE 1 END) <= 100 AS is_scanned FROM documents GROUP BY 1"


# ---- quality
def qa_01_cases(spark, sf):
    d = dealt(spark.read.parquet(f"{sf}/customer.parquet").select(K)).selectExpr("CAST(c_custkey AS VARCHAR(20)) AS name", "concat('13800000000 ', CASE WHEN c_custkey % 2 = 0 THEN 'a@b.cn' ELSE 'x' END) AS text")
    wish = "array(named_struct('text', 'a@b.cn', 'type', 'email'))"
    must = d.selectExpr("name", f"{wish} AS must_detect", "array(named_struct('text', '13800000000', 'type', 'phone')) AS must_not_detect")
    out = report.check_cases(must, detect(d, entities=False).select("name", "spans"))
    return out.select("name", F.size("missing").cast("long").alias("missing"), F.size("unwanted").cast("long").alias("unwanted"))


Q["qa_01_cases"], SQL["qa_01_cases"] = qa_01_cases, "SELECT CAST(c_custkey AS VARCHAR(20)) AS name, CAST(c_custkey % 2 AS BIGINT) AS missing, CAST(1 AS BIGINT) AS unwanted FROM customer"


def qa_04_planted_leaks(spark, sf):
    """Masked texts to which every fifth row's number is put back."""
    d = dealt(spark.read.parquet(f"{sf}/customer.parquet").select(K)).selectExpr("c_custkey AS doc_id", "concat('电话13800000000，邮箱u', CAST(c_custkey AS VARCHAR(20)), '@b.cn') AS text")
    m = masks.masked(detect(d, entities=False), everything="placeholder").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("masked_text", F.lit(" 13900000000 13900000000"))).otherwise(F.col("masked_text")).alias("masked_text"))
    return report.leaks(m).select("doc_id", "type", "text", "occurrences")


Q["qa_04_planted_leaks"], SQL["qa_04_planted_leaks"] = qa_04_planted_leaks, "SELECT c_custkey AS doc_id, 'phone' AS type, '13900000000' AS text, CAST(2 AS BIGINT) AS occurrences FROM customer WHERE c_custkey % 5 = 0"


def qa_05_capped(spark, sf):
    return report.capped(spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey"), 3, ["o_custkey"], ["o_orderkey"])


Q["qa_05_capped"], SQL["qa_05_capped"] = qa_05_capped, "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3"
cases("qa_06_coverage", lambda d: detect(d, entities=False).withColumn("m", F.array(sp.span(F.lit(0), F.lit("138"), "x", "model"), sp.span(F.lit(20), F.lit("zz"), "y", "model"))).select("doc_id", F.concat_ws("/", listed(report.coverage(F.col("m"), F.col("spans"))["covered"], "etype"), listed(report.coverage(F.col("m"), F.col("spans"))["novel"], "etype")).alias("found")), ("13812345678", "x/y"), ("none", "/x|y"), ("a 13812345678 13912345678", "x|y/"), ("abc 13812345678 13912345678", "y/x"))
cases("agg_01_findings", lambda d: report.analysis(detect(d, entities=False)).select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("findings"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ",")))), "|").alias("found")), ("a@b.cn 13812345678 c@d.cn a@b.cn", "email=a@b.cn,c@d.cn|phone=13812345678"), ("x", ""))


def dic_12_session(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("'place' AS type", "n_name AS name", "CAST(NULL AS ARRAY<INT>) AS item_indices", "n_nationkey AS k")
    cur = dictionary.cleaned(n.filter("k < 12").drop("k"))
    return dictionary.without(dictionary.merged(cur, n.filter("k between 8 and 20").drop("k")), n.filter("k % 5 = 0").drop("k")).select("type", "name")


Q["dic_12_session"], SQL["dic_12_session"] = dic_12_session, "SELECT 'place' AS type, n_name AS name FROM nation WHERE n_nationkey <= 20 AND n_nationkey % 5 <> 0"


def src_17_corpus(spark, sf):
    listed_files = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("CASE CAST(n_nationkey % 3 AS INT) WHEN 0 THEN concat(' ', n_name, ' ') WHEN 1 THEN concat('# ', n_name) ELSE '' END AS value")
    return files.corpus_paths(listed_files, spark.read.parquet(f"{sf}/nation.parquet").filter("n_nationkey < 20").selectExpr("n_name AS path"))


Q["src_17_corpus"], SQL["src_17_corpus"] = src_17_corpus, "SELECT n_name AS path FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 20"
