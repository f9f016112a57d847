"""Spans, patterns, masks, restore, reports and rule entities on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import masks, names, normalize, patterns, spans as sp
from veilspark.operators import batch, dictionary, models, report
from veilspark.operators.detect import arbitrated, detect, model_wins, without_excluded


def docs(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def found(df):
    return [[(s.etype, s.txt, s.pos) for s in r.spans] for r in df.orderBy("doc_id").collect()]


MIXED = "张某身份证110105198503121234，电话13812345678，邮箱zhangsan@example.com，金额USD 125,000和50,000 元，卡6222021234567890123，2024-03-05 10:20，京A12345，邮编200001。"


def test_pattern_scan_and_precedence(spark):
    got = found(patterns.with_pattern_spans(docs(spark, MIXED, None, ""), into="spans"))
    assert [(k, t) for k, t, _ in got[0]] == [
        ("id_card", "110105198503121234"), ("phone", "13812345678"), ("email", "zhangsan@example.com"), ("price", "USD 125,000"), ("amount", "50,000 元"),
        ("bank_account", "6222021234567890123"), ("datetime", "2024-03-05 10:20"), ("license_plate", "京A12345"), ("postal_code", "200001"),
    ]
    assert all(MIXED[p : p + len(t)] == t for _, t, p in got[0]) and got[1:] == [[], []]


ATOMS = ["138", "12345678", "0", "1985", "0312", "X", "-", "－", " ", "　", "\n", "号", "第", "编号：", "元", "¥", ",", ".", "@", "a", "B", "www.", "http://", "京", "省", "市", "路", "12", "年", "月", "日", ":", "QQ", "微信", "（", "）", "2024", "项目", "字", "FH", "G12345678", "0A:", "CN", "😀", "张", "楼", "VX", "weİbo", "qq1234567", "专利申请号：", "军字第", "时", "壹佰元整", "USD "]


def fuzzed(n, seed=8):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choices(ATOMS, k=rng.randint(5, 40))) for _ in range(n)]


def test_no_text_with_a_match_is_left_out():
    """What a text must have for a search is never stricter than the pattern."""
    for t in fuzzed(3000):
        longest = max(map(len, re.findall(r"\d+", t)), default=0)
        low = t.lower().replace("i\u0307", "i").replace("ı", "i")
        for s in patterns.SPECS:
            assert patterns.may_have(s, t, low, longest) or not re.search(s.pattern, t), (s.etype, t)


def test_scan_of_fuzzed_texts(spark):
    """All matches without resolving; with it none overlap and none that stays is beaten by one that went."""
    texts = fuzzed(300)
    for t, spans in zip(texts, found(patterns.with_pattern_spans(docs(spark, *texts), into="spans", resolve=False)), strict=True):
        plain = [s for s in patterns.SPECS if s.etype not in patterns.VETOES]
        assert {x for x in spans if x[0] not in patterns.VETOES} == {(s.etype, m[0], m.start()) for s in plain for m in re.finditer(s.pattern, t)}, t
        every = sorted(patterns.scan(t, patterns.selected(), resolve=False), key=lambda s: (s[4], -len(s[1]), s[5], s[0]))
        kept = []
        for s in every:
            if all(s[0] + len(s[1]) <= k[0] or k[0] + len(k[1]) <= s[0] for k in kept):
                kept.append(s)
        assert sorted(kept) == sorted(patterns.scan(t, patterns.selected())) or "地址" in t or "住所" in t


def test_many_hits_in_one_text(spark):
    """100,000 hits take seconds: the work grows with n log n."""
    text = " ".join(f"10.{k % 250}.{k % 199}.7" for k in range(100_000))
    df = patterns.with_pattern_spans(docs(spark, text), only=["ip_address", "phone"], into="spans")
    assert df.select(F.size("spans").alias("n"), F.element_at("spans", -1)["pos"].alias("p")).first() == (100_000, text.rindex(" ") + 1)
    r = masks.masked(detect(docs(spark, " ".join(f"138{k:08d}" for k in range(20_000))), entities=False), everything="placeholder").select(F.size("mapping").alias("n")).first()
    assert r.n == 20_000


def test_occupied_ranges():
    import random

    rng = random.Random(3)
    for _ in range(200):
        taken, held = sp.Occupied(), set()
        for _ in range(30):
            a = rng.randint(0, 60)
            b = a + rng.randint(1, 8)
            free = not held & set(range(a, b))
            assert taken.free(a, b) is free
            if rng.random() < 0.5:
                assert taken.take(a, b) is free
                held |= set(range(a, b)) if free else set()
            else:
                taken.add(a, b)
                held |= set(range(a, b))


@pytest.mark.parametrize("text,etype,kept", [
    ("股票代码600519", "postal_code", 0), ("邮编600519", "postal_code", 1), ("共200001元", "postal_code", 0), ("200001年", "postal_code", 0), ("(200001", "postal_code", 0),
    ("P1234567", "passport", 0), ("护照P1234567", "passport", 1), ("第2条3元", "amount", 0), ("指导案例12号楼", "house_number", 0), ("住12号楼", "house_number", 1), ("管理系统，", "project_name", 0),
    ("某某大桥项目，", "project_name", 1), ("地址北京市朝阳区建国路88号", "full_address", 1), ("广东省深圳市南山区人民法院", "full_address", 0),
])
def test_context_tests(spark, text, etype, kept):
    assert len(found(patterns.with_pattern_spans(docs(spark, text), only=[etype], into="spans"))[0]) == kept


def test_address_prefix_is_cut(spark):
    assert found(patterns.with_pattern_spans(docs(spark, "地址北京市朝阳区建国路88号"), only=["full_address"], into="spans"))[0] == [("full_address", "北京市朝阳区建国路88号", 2)]


def test_type_lists(spark):
    d = docs(spark, MIXED)
    assert {k for k, *_ in found(patterns.with_pattern_spans(d, only=["phone", "email"], exclude=["email"], into="spans"))[0]} == {"phone"}
    assert len(found(patterns.with_pattern_spans(d, only=[], into="spans"))[0]) == 9


def test_partial_masks():
    cases = [("id_card", "110105198503121234", "110*************34"), ("phone", "138-1234-5678", "138-****-**78"), ("phone", "1234", "1234"), ("email", "ab@x.com", "**@x.com"), ("email", "abcd@x.com", "ab**@x.com"), ("bank_account", "1234567", "*******"),
             ("passport", "G12345678", "G1*****78"), ("license_plate", "京A12345", "京A****5"), ("vin", "12345", "*****"), ("person", "张三丰", "张**"), ("company", "深圳市某某物流有限公司", "深******有限公司"), ("company", "甲乙", "甲*"), ("amount", "50元", "***")]
    assert [masks.partly(t, k) for k, t, _ in cases] == [w for *_, w in cases]


def test_masking_numbers_log_and_restore(spark):
    text = "甲公司A与丙公司长，电话4001234567和4007654321，甲公司A。"
    rows = [(0, "甲公司A", "company"), (5, "丙公司长名", "company"), (5, "丙公司长", "company"), (12, "4001234567", "toll_free"), (23, "4007654321", "phone")]
    d = docs(spark, text).withColumn("spans", F.array(*(sp.span(F.lit(text.find(t) if text.find(t) >= 0 else p), F.lit(t), k, "custom") for p, t, k in rows if t in text), sp.span(F.lit(text.rfind("甲公司A")), F.lit("甲公司A"), "company", "custom")))
    r = masks.restored(masks.masked(d, everything="placeholder")).first()
    assert r.masked_text == "[COMPANY_1]与[COMPANY_2]，电话[PHONE_1]和[PHONE_2]，[COMPANY_1]。" and r.restored_text == text
    assert [x.position for x in r.log] == sorted((x.position for x in r.log), reverse=True)
    assert r.log[-1].context_after == r.masked_text[len("[COMPANY_1]") :][:40] and r.mapping["[COMPANY_2]"].original == "丙公司长"
    assert masks.masked(d, everything="placeholder", style="chinese_angle").first().masked_text.startswith("<公司1>与<公司2>，电话<电话1>")
    facts = F.struct(F.lit("company").alias("type"), F.lit("旧").alias("original"), F.lit(False).alias("is_abbreviation"), F.lit(None).cast("string").alias("full_name"), F.lit(None).cast("string").alias("full_placeholder"))
    seeded = d.withColumn("seed", F.create_map(F.lit("[COMPANY_1]"), facts))
    assert masks.masked(seeded, everything="placeholder", seed="seed").first().masked_text.startswith("[COMPANY_2]与[COMPANY_3]")


ORGS = "原告杭州青禾软件有限公司（以下简称“青禾”）与被告周岩，男，签订协议，青禾已付款。"


def test_rule_entities_and_abbreviations(spark):
    r = masks.masked(detect(docs(spark, ORGS)), abbreviations="abbreviations").first()
    assert r.masked_text == "原告[COMPANY_1]（以下简称“[COMPANY_1_ABBR]”）与被告[PERSON_1]，男，签订协议，[COMPANY_1_ABBR]已付款。"
    assert r.mapping["[COMPANY_1_ABBR]"].full_placeholder == "[COMPANY_1]" and masks.restored(masks.masked(detect(docs(spark, ORGS)), abbreviations="abbreviations")).first().restored_text == ORGS


@pytest.mark.parametrize("text,want", [
    ("被告人刘明，由审判长王建国主持", {("刘明", "person")}), ("法定代表人为郑友妹，", {("郑友妹", "person")}), ("某市长风数据有限公司", {("某市长风数据有限公司", "company")}), ("广州市天河区人民法院", {("广州市天河区人民法院", "court")}),
    ("科技有限公司", set()), ("审计委员会", set()), ("signed by Acme Legal Services, Inc. today", {("Acme Legal Services, Inc.", "company")}), ("保荐代表人：江海伊王飞\n", {("江海伊", "person"), ("王飞", "person")}),
])
def test_rules(text, want):
    got, _ = names.auto_entities(text)
    assert want <= got and (want or not got)


def test_definitions_go_to_the_nearest_name_and_not_to_two():
    text = "甲乙科贸有限公司与丙丁实创有限公司（简称“丙丁”）。戊己有限公司称“市场环境”。"
    _, short = names.auto_entities(text)
    assert short == {"丙丁": "丙丁实创有限公司"}
    _, short = names.auto_entities("甲乙科贸有限公司（简称“目标”）。丙丁实创有限公司（简称“目标”）。")
    assert short == {}


def test_brand():
    assert names.brand("深圳市长风（北京）融资租赁有限公司") == "长风" and names.brand("北京银行") is None


def test_dictionary_wins_and_exclusion(spark):
    d = docs(spark, "call 13812345678 now, 138 too")
    df = detect(d, [("code", "3812"), ("code", "138")], entities=False)
    assert found(df)[0][0][0] == "code" and all(k == "code" for k, *_ in found(df)[0])
    assert found(without_excluded(df, [("code", "138")])) == [[("code", "3812", 6)]]
    many = [("w", f"w{k}x") for k in range(300)] + [("code", "138")]
    a, b = found(dictionary.with_dictionary_spans(d, many, into="spans"))[0], found(dictionary.with_dictionary_spans(d, [("code", "138")], into="spans"))[0]
    assert sorted(a) == sorted(b)


def test_fusion_rules():
    assert model_wins((0, "长风公司", "company"), (0, "长风", "person")) and not model_wins((0, "长风", "company"), (0, "长风公司等等等", "company"))
    assert arbitrated([(0, "长风", "person"), (4, "x", "phone")], [(0, "长风公司", "company"), (4, "x", "person")]) == [(4, "x", "phone"), (0, "长风公司", "company")]


def test_model_layers(spark):
    stub = models.stub_detector({"Jane Roe": "person", "13812345678": "secret"})
    got = found(detect(docs(spark, "Jane Roe 13812345678"), detectors=[stub]))[0]
    assert got == [("person", "Jane Roe", 0), ("phone", "13812345678", 9)]
    raw = [("position", 0, "欧阳", 0.9), ("name", 2, "修文", 0.8), ("phone", 10, "138", 0.9), ("phone", 14, "1234", 0.9), ("website", 20, "https", 0.9), ("secret", 25, "://x", 0.9)]
    df = spark.createDataFrame([("欧阳修文xxxxxx138 123456 https://xyz", [dict(zip(("label", "pos", "txt", "score"), r, strict=True)) for r in raw])], f"text string, raw array<{models.RAW}>")
    r = df.select(models.glued_surnames(F.col("raw")).alias("a"), models.merged_neighbours(F.col("raw"), F.col("text")).alias("b"), models.joined_urls(F.col("raw")).alias("c")).first()
    assert r.a[0].txt == "欧阳修文" and [x.txt for x in r.b if x.label == "phone"] == ["138 1234"] and [x.txt for x in r.c if x.label == "website"] == ["https://x"]
    reply = spark.createDataFrame([('```json\n{"entities":[{"text":"张三","type":"person"},{"text":"x","type":"person"},{"text":"yy","type":"odd"}]}\n```',)], "r string")
    assert [x.text for x in reply.select(models.parsed_reply(F.col("r")).alias("e")).first().e] == ["张三"]


def test_normalisers(spark):
    d = spark.createDataFrame([("甲1\n号楼\n\n第二\n段A\n座\x00",)], "t string")
    assert d.select(normalize.joined_lines(F.col("t")).alias("x")).first().x == "甲1号楼\n\n第二段A座"
    d = spark.createDataFrame([("甲 乙 丙|\n丁戊。 ab\n己庚\n\n-\n辛壬",)], "t string")
    assert d.select(normalize.fixed_ocr(F.col("t")).alias("x")).first().x == "甲乙丙丁戊。\n己庚\n辛壬"
    d = spark.createDataFrame([("一二。" * 50 + "x" * 40,)], "t string")
    chunks = d.select(normalize.chunked(F.col("t"), 40).alias("c"), "t").first()
    assert "".join(c.chunk for c in chunks.c) == chunks.t and all(len(c.chunk) <= 40 for c in chunks.c) and [c.offset for c in chunks.c] == [sum(len(x.chunk) for x in chunks.c[:k]) for k in range(len(chunks.c))]


def test_reports(spark):
    d = detect(docs(spark, MIXED, "13812345678 13812345678"), entities=False)
    f = {(r.doc_id, r.type): r for r in report.findings(d).collect()}
    assert f[1, "phone"].occurrence_count == 2 and f[1, "phone"].first_pos == 0 and f[1, "phone"].context.startswith("…【13812345678】")
    a = report.snapshot(report.findings(d))
    diff = {r.type: (r.added, r.removed, r.unchanged) for r in report.snapshot_diff(a, a.filter("type <> 'email'")).filter("doc_id = 0").collect()}
    assert diff["email"] == (0, 1, 0) and diff["phone"] == (0, 0, 1)
    assert report.leaks(masks.masked(d, everything="placeholder")).count() == 0


def test_batch(spark):
    items = spark.createDataFrame([(0, "联系人：周岩，男，电话13812345678。"), (1, "周岩已付款。")], "idx long, text string")
    rows, mapping = batch.run_exact(items)
    assert [r["masked_text"] for r in rows] == ["联系人：[PERSON_1]，男，电话138******78。", "[PERSON_1]已付款。"]
    rows, mapping2, _ = batch.refined(items, [], mapping, [("other", "已付款")], targets=[1])
    assert rows[0]["masked_text"] == "[PERSON_1][OTHER_1]。" and mapping.items() <= mapping2.items()
    out, m = batch.run_global(items)
    assert [r.masked_text for r in out.orderBy("idx").collect()] == ["联系人：[PERSON_1]，男，电话[PHONE_1]。", "周岩已付款。"]
    assert {(r.placeholder, r.type, r.original) for r in m.collect()} == {("[PERSON_1]", "person", "周岩"), ("[PHONE_1]", "phone", "13812345678")}
    with pytest.raises(ValueError):
        batch.refined(items, [("other", "x")], mapping, [("other", "x")])


def test_spans_are_extended_to_the_end_of_their_characters(spark):
    tails = {"secret": "aB3_" * 100, "website": "/p-1+@x" * 75, "phone": "12 34" * 60, "bank_account": "5-6" * 90}
    rows = [(f"见 9x{tail}，后", [(kind, 2, "9x", 0.9)]) for kind, tail in tails.items()]
    got = spark.createDataFrame(rows, f"text string, raw array<{models.RAW}>").select(models.extended(F.col("raw"), F.col("text")).alias("s")).collect()
    assert [r.s[0].txt for r in got] == ["9x" + tail for tail in tails.values()]
    ends = [("phone", "12- ", "+3"), ("secret", "ab", "+/="), ("phone", "12", "-3 - x")]
    rows = [(f"见 {x}{tail}", [(kind, 2, x, 0.9)]) for kind, x, tail in ends]
    got = spark.createDataFrame(rows, f"text string, raw array<{models.RAW}>").select(models.extended(F.col("raw"), F.col("text")).alias("s")).collect()
    assert [r.s[0].txt for r in got] == ["12- ", "ab", "12-3"]


def test_pages_are_routed_by_their_whole_text(spark, tmp_path):
    from veilspark.plans import catalogue

    rows = [(300, "x" * 1000), (170, "x" * 100), (2, ""), (4, "x" * 199), (6, " " + "x" * 200 + "\n"), (1, "x" * 49), (3, "x" * 50), (5, " " * 300), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalogue.queries()
    routes = {r.doc_id: r.route for r in q["scan_route"](spark, str(tmp_path)).collect()}
    assert routes == {300: "native", 170: "ocr", 2: "ocr", 4: "ocr", 6: "native", 1: "ocr", 3: "native", 5: "ocr", 7: "ocr"}
    kinds = {r.doc_id: r.is_scanned for r in q["scanned_classifier"](spark, str(tmp_path)).collect()}
    assert kinds == {100: False, 56: False, 0: True, 1: False, 2: False}


def test_model_spans_are_tested(spark):
    ner = [("name", 0, "王的", 0.9), ("name", 0, "王明", 0.9), ("company", 0, "Delaware", 0.9), ("government", 0, "人民法院", 0.9), ("organization", 0, "第三条法院", 0.9), ("organization", 0, "青山学校", 0.9), ("book", 0, "红楼", 0.9), ("B-name", 0, "李雷", 0.9), ("name", 0, "低分", 0.1)]
    pii = [("private_person", 0, "，Jo ", 0.9), ("private_person", 5, "王明", 0.9), ("private_email", 9, "a@b", 0.9), ("private_phone", 13, "1。", 0.9)]
    df = spark.createDataFrame([("，Jo  王明  a@b 1。", [dict(zip(("label", "pos", "txt", "score"), r, strict=True)) for r in ner], [dict(zip(("label", "pos", "txt", "score"), r, strict=True)) for r in pii])], f"text string, ner array<{models.RAW}>, pii array<{models.RAW}>")
    r = df.select(models.plausible(models.typed(models.usable(F.col("ner")), models.NER_TYPES)).alias("a"), models.anchored(models.typed(F.col("pii"), models.PII_TYPES), F.col("text")).alias("b")).first()
    assert [(x.label, x.txt) for x in r.a] == [("person", "王明"), ("institution", "青山学校"), ("person", "李雷")]
    assert [(x.label, x.pos, x.txt) for x in r.b] == [("person", 1, "Jo"), ("email", 9, "a@b")]
    assert models.ner_spans(ner, "") == [(0, "李雷", "person"), (0, "王明", "person"), (0, "青山学校", "institution")]


def test_injected_layers(spark):
    loads = []

    def load():
        loads.append(1)
        return lambda cut: [[("name", c.find("王明"), "王明", 0.9)] if "王明" in c else [] for c in cut]

    layer = models.chunked_layer("stub", load, models.ner_spans)
    long = "甲" * 500 + "王明" + "。" + "乙" * 500
    assert layer([long, ""]) == [[(500, "王明", "person")], []] and layer(["王明"]) == [[(0, "王明", "person")]] and len(loads) == 1
    broken = models.chunked_layer("broken", lambda: 1 / 0, models.ner_spans)
    assert broken(["x"]) == [[]]
    text = "，Jo Roe a@b.cn https://x.y/z 138-1234 王明 sk_1"
    at = lambda x: text.index(x)
    raw = [("B-private_person", 0, "，Jo ", 0.9), ("private_person", at("Roe"), "Roe", 0.6), ("private_email", at("a@b"), "a@b.cn", 0.9), ("private_url", at("https"), "https", 0.9), ("secret", at("://x"), "://x", 0.9), ("private_phone", at("138"), "138", 0.9), ("private_person", at("王明"), "王明", 0.9), ("secret", at("sk_1"), "sk", 0.4)]
    layer = models.chunked_layer("pii", lambda: lambda cut: [raw for _ in cut], models.pii_spans, "pii")
    assert layer([text]) == [[(1, "Jo Roe", "person"), (at("a@b"), "a@b.cn", "email"), (at("https"), "https://x.y/z", "website"), (at("138"), "138-1234", "phone")]]
    asked = []

    def ask(prompt, text):
        asked.append(text)
        if "down" in text:
            raise OSError("gone")
        return '```json\n{"entities":[{"text":"王明","type":"person"},{"text":"x","type":"person"},{"text":"无","type":"odd"}]}\n```'

    assert models.reply_layer(ask)(["王明王明", "down", "王明"]) == [[(0, "王明", "person"), (2, "王明", "person")], [], []] and asked == ["王明王明", "down"]
    assert models.reply_layer(ask, lambda: False)(["王明"]) == [[]]
    got = found(detect(docs(spark, "王明 13812345678"), detectors=[models.reply_layer(lambda p, t: '{"entities":[{"text":"王明","type":"person"}]}')]))[0]
    assert got == [("person", "王明", 0), ("phone", "13812345678", 3)]
    spark.conf.set("veilspark.reply.enabled", "Yes")
    assert models.enabled(spark, "reply") and not models.enabled(spark, "ner")
    text = "一二。" * 50 + "x" * 40
    want = spark.createDataFrame([(text,)], "t string").select(normalize.chunked(F.col("t"), 40).alias("c")).first().c
    assert models.chunks(text, 40, ("\n\n", "\n", "。", "；")) == [(c.chunk, c.offset) for c in want]


def test_batches_go_on_after_a_failure_and_are_reviewed(spark):
    items = spark.createDataFrame([(b, i, t) for b in ("p", "q") for i, t in enumerate(["原告周岩，男，电话13812345678", "bad", "周岩付款", None])], "batch string, idx long, text string")

    def failing(texts):
        if "bad" in texts[0]:
            raise RuntimeError("no")
        return [[] for _ in texts]

    rows = {(r.batch, r.idx): r for r in batch.masked_in_order(items, everything="placeholder", detectors=[failing]).collect()}
    assert [rows["p", i].status for i in range(4)] == ["done", "error", "done", "done"] and rows["q", 1].error == "RuntimeError: no"
    assert rows["p", 2].masked_text == "[PERSON_1]付款" == rows["q", 2].masked_text and rows["p", 3].masked_text == "" and rows["p", 0].placeholders == ["[PERSON_1]", "[PHONE_1]"]
    one = items.filter("batch = 'p' and idx in (0, 2)")
    seen = report.findings(detect(one), "idx")
    review = spark.createDataFrame([(0, "deleted", "phone", "13812345678", None), (0, "edited", "person", "周岩", "原告周岩"), (2, "custom", "other", "付款", None), (2, "deleted", "phone", "999", None)], "idx long, action string, type string, name string, new_name string")
    scoped, excluded = batch.reviewed(seen, review)
    assert scoped == {0: [("person", "原告周岩")], 2: [("other", "付款")]} and excluded == {0: [("person", "周岩"), ("phone", "13812345678")]}
    got, mapping = batch.run_exact(one, scoped=scoped, excluded=excluded)
    assert [r["masked_text"] for r in got] == ["[PERSON_1]，男，电话13812345678", "周岩[OTHER_1]"] and "[PERSON_1]" in mapping
    h = batch.History(one)
    first = h.versions[0]["mapping"]
    v2 = h.refine([("other", "付款")], targets=[2])
    assert v2["version"] == 2 and v2["rows"][2]["masked_text"] == "[PERSON_1][OTHER_1]" and first.items() <= v2["mapping"].items() and v2["rows"][0] == h.versions[0]["rows"][0]
    import json

    doc = json.loads(batch.mapping_document(v2["mapping"], "b", 2))
    assert doc["format_version"] == 2 and set(doc["mapping"]["[OTHER_1]"]) == {"type", "original", "is_abbreviation", "full_name", "full_placeholder"}


def test_global_batch_numbers_and_repeated_ids(spark):
    items = spark.createDataFrame([(1, "周岩和沈语丁"), (1, "沈语丁"), (2, None), (3, "周岩")], "idx long, text string")
    out, m = batch.run_global(items, [("person", "周岩"), ("person", "沈语丁")], entities=False)
    assert sorted((r.idx, r.masked_text or "") for r in out.collect()) == [(1, "[PERSON_1]"), (1, "[PERSON_2]和[PERSON_1]"), (2, ""), (3, "[PERSON_2]")]
    many = [(f"[PERSON_{k}]", f"名{k}") for k in range(1, 301)]
    t = spark.createDataFrame([(1, " ".join(p for p, _ in many))], "idx long, text string")
    r = batch.restore_report(t, many).first()
    assert r.restored_text == " ".join(o for _, o in many) and r.occurrences == 300


def test_stored_dictionary(spark, tmp_path):
    d = dictionary.UserDictionary(spark, f"file://{tmp_path}/dict")
    rows = lambda *x: spark.createDataFrame(x, "type string, name string, item_indices array<int>")
    assert d.entries().count() == 0
    assert d.add(rows(("person", " 周岩 ", None), ("", "x" * 501, None), ("", "甲", [3, 1, 3]))) == 2
    assert d.add(rows(("person", "周岩", None))) == 0 and d.remove(rows(("person", "周岩", None))) == 1
    assert [tuple(r) for r in d.entries().collect()] == [("other", "甲", [1, 3])]
    d.clear()
    assert d.entries().count() == 0 and dictionary.replaced(d.entries(), rows(("a", "b", None))).count() == 1


def test_facade(tmp_path):
    import json

    from veilspark.api import Veil

    v = Veil()
    r = v.mask_text(ORGS)
    assert r.text == "原告[COMPANY_1]（以下简称“[COMPANY_1_ABBR]”）与被告[PERSON_1]，男，签订协议，[COMPANY_1_ABBR]已付款。" and v.restore_text(r.text, {"mapping": r.mapping}) == ORGS
    assert r.counts["replacements_made"] == 4 and r.counts["by_type"] == {"company": 3, "person": 1}
    assert "[COMPANY_2]已付款" in v.mask_text(ORGS, abbreviations={}).text
    assert v.analyze_text("13812345678 13812345678", context_window=5)["findings"]["phone"][0]["context"] == "…【13812345678】 1381…" and v.analyze_text("13812345678 13812345678")["total_findings"] == 2
    v.add_entities([{"type": "code", "name": "协议"}, {"name": ""}])
    v.set_all_strategies("whitebox")
    r = v.mask_text("协议13812345678", excluded=[("code", "x")])
    assert r.text == "[UNKNOWN_1][PHONE_1]" and r.whitebox
    v.reset()
    (tmp_path / "a.txt").write_text("电话13812345678", encoding="utf-8")
    v.mask_file(str(tmp_path / "a.txt"), str(tmp_path / "b.docx"), str(tmp_path / "m.json"))
    v.set_all_strategies("placeholder")
    v.mask_file(str(tmp_path / "a.txt"), str(tmp_path / "c.txt"), str(tmp_path / "m.json"))
    assert (tmp_path / "c.txt").read_text(encoding="utf-8") == "电话[PHONE_1]" and json.loads((tmp_path / "m.json").read_text(encoding="utf-8"))["mapping"]["[PHONE_1]"]["original"] == "13812345678"
    v.restore_file(str(tmp_path / "c.txt"), str(tmp_path / "m.json"), str(tmp_path / "d.txt"))
    assert (tmp_path / "d.txt").read_text(encoding="utf-8") == "电话13812345678"
    (tmp_path / "e.txt").write_text(" ")
    with pytest.raises(ValueError):
        v.mask_file(str(tmp_path / "e.txt"))


def test_a_batch_costs_what_is_new_in_each_document(spark):
    """3,000 documents with two new names each: with a search and a mapping made anew for each document this took a minute."""
    import random
    import time

    rng = random.Random(3)
    names = [("t", "".join(rng.choices("abc", k=rng.randint(1, 9)))) for _ in range(400)] + [("u", "ab")]
    held = dictionary.Held(names)
    for _ in range(200):
        text = "".join(rng.choices("abc", k=rng.randint(0, 60)))
        assert held(text) == [k for k, (_, n) in enumerate(held.entries) if n in text]
    items = spark.createDataFrame([(0, i, f"电话{13800000000 + i}，邮编{200000 + i}") for i in range(3000)], "batch int, idx long, text string")
    began = time.time()
    got = {r.idx: r.masked_text for r in batch.masked_in_order(items, everything="placeholder", entities=False).collect()}
    assert got == {i: f"电话[PHONE_{i + 1}]，邮编[POSTAL_CODE_{i + 1}]" for i in range(3000)} and time.time() - began < 25


def test_steps_that_follow_each_other_are_one_pass(spark):
    """Detection, masking and restoring in one worker, in parts by bytes; columns that nobody keeps aren't made."""
    import pyarrow as pa

    from veilspark.functions import shipping

    d = docs(spark, *("电话13812345678，邮箱a@b.cn" * k for k in range(40)), None)
    m = masks.masked(detect(d, entities=False), everything="placeholder")
    lean = masks.masked(detect(d, entities=False), everything="placeholder", made=("masked_text", "replacements"), keep=["doc_id"])
    back = masks.restored(m)
    for df in (m, lean, back):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert lean.columns == ["doc_id", "masked_text", "replacements"]
    assert [tuple(r) for r in lean.orderBy("doc_id").collect()] == [tuple(r) for r in m.select("doc_id", "masked_text", F.size("log").cast("long")).orderBy("doc_id").collect()]
    assert [r.restored_text for r in back.orderBy("doc_id").collect()] == [r.text for r in d.orderBy("doc_id").collect()]
    b = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (10, 3 << 20, 600_000, 600_000, 5)] + [None] * 3000})
    parts = list(shipping.slices(b))
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches([b])) and max(p.num_rows for p in parts) <= shipping.ROWS and len(parts) > 4


def test_batches_are_not_read_as_tables_of_their_own(spark):
    """Many small batches, unsorted and with ids that repeat or lack: one pass over sorted rows."""
    rows = [(b if b < 300 else None, i, f"电话1381234{b:04d}") for i in (3, 1, 2, 2, None) for b in range(301)]
    got = batch.masked_in_order(spark.createDataFrame(rows, "batch int, idx long, text string"), everything="placeholder", entities=False)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert sorted((r.batch is None, r.batch or 0, r.idx or 0, r.masked_text) for r in got.collect()) == sorted((b is None, b or 0, i or 0, "电话[PHONE_1]") for b, i, _ in rows)


def test_texts_of_cases_are_dealt_to_all_cores(spark):
    from veilspark.plans import cases, catalogue

    for name in ("ent_20_definitions", "ent_21_22_23_claims", "ent_24_gates_exclude", "ent_11_defined_people", "mrg_08_reviewed", "mask_placeholders"):
        q = cases.Q.get(name) or catalogue.Q[name]
        assert q(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name
