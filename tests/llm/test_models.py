"""Parts that have no fixed digest: mixing, packing, learned models, files, the pipeline."""

import io
import math
from collections import defaultdict

import numpy as np
import pytest

from veilspark.llm import media, mixing, ngram_join, packing, pii, quality, secrets, token_files


def test_prefix_tree_against_all_pairs():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.choice(400, rng.integers(1, 80), replace=False)
        for _ in range(rng.integers(1, 4)):
            s = np.where(rng.random(len(base)) < 0.1, rng.choice(400, len(base)), base)
            sets.append(np.unique(s).astype(np.uint64))
    tree = ngram_join.PrefixTree(sets, 3, 4)
    for p in range(len(sets)):
        a = set(sets[p].tolist())
        want = [q for q in range(len(sets)) if 4 * len(a & set(sets[q].tolist())) >= 3 * len(a | set(sets[q].tolist()))]
        assert sorted(tree.probe(p).tolist()) == want
    roots = ngram_join.linked_roots(sets, 3, 4)
    for p in range(len(sets)):
        tree = ngram_join.PrefixTree(sets, 3, 4)
        assert len(set(roots[tree.probe(p)].tolist())) == 1


@pytest.mark.parametrize("kind", list(media.FILTERS))
@pytest.mark.parametrize("rows", [1, 2, 37])
def test_png_round_trip_and_damage(kind, rows):
    payload = np.random.default_rng(rows).integers(0, 256, 64 * rows, dtype=np.uint8).tobytes()
    data = media.write_png(payload, kind=kind)
    assert media.read_png(data).tobytes() == payload
    for at in (3, 20, len(data) // 2, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(bad))
    with pytest.raises(ValueError):
        media.read_png(data[:-4])


def test_media_rows_are_filtered(spark):
    import struct
    import zlib

    texts = ["The quick brown fox jumps over the lazy dog. " * 20, "".join(f"{k:064d}" for k in range(9)), "日本語 テキスト 😀 " * 30, "", "x" * 64 + "\x00" * 64]
    media_rows = media.with_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    types = set()
    for r in media_rows.collect():
        data = bytes(r.media)
        assert media.read_png(data).tobytes() == media.padded(texts[r.doc_id].encode())
        at, packed = 8, b""
        while at < len(data):
            (n,) = struct.unpack_from(">I", data, at)
            packed += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        types |= set(zlib.decompress(packed)[:: media.WIDTH + 1])
    assert types == {0, 1, 2}


def test_hash_is_stable_under_small_changes():
    img = np.random.default_rng(6).integers(0, 256, (64, 64), dtype=np.uint8)
    near = img.copy()
    near[5, 7] ^= 9
    bits = lambda x: np.unpackbits(np.frombuffer(media.cosine_hash(x), np.uint8))
    assert (bits(img) != bits(near)).sum() <= 4


def test_token_file_reads_single_documents_and_finds_damage():
    rng, out = np.random.default_rng(2), io.BytesIO()
    docs = [rng.integers(0, 50_000, n) for n in (0, 5, 300_000, 1, 200_000, 90_000, 7)]
    w = token_files.TokenFileWriter(out)
    for k, d in enumerate(docs):
        w.add(k if k else None, d)
    w.close()
    r = token_files.TokenFileReader(out)
    assert len(r.entries) > 2
    for k, d in enumerate(docs):
        assert r.document(k).tolist() == d.tolist()
    assert [x for x, _ in r.documents()] == [None, 1, 2, 3, 4, 5, 6]
    bad = bytearray(out.getvalue())
    bad[r.starts[1] + 40] ^= 255
    with pytest.raises(ValueError):
        token_files.TokenFileReader(io.BytesIO(bytes(bad))).frame(1)


def test_learned_rules_on_held_out_rows():
    rng = np.random.default_rng(4)
    n = 3000
    x = {f: rng.random(n) for f in quality.FEATURES}
    bad = ((x["symbols"] > 0.8) & (x["mean_word"] <= 0.7)) | (x["bangs"] > 0.9)
    noisy = bad ^ (rng.random(n) < 0.03)
    rules = quality.learn({k: v[:2000] for k, v in x.items()}, noisy[:2000])
    found = np.zeros(1000, bool)
    for rule in rules.rules:
        c = np.ones(1000, bool)
        for cond in rule:
            c &= cond.covers({k: v[2000:] for k, v in x.items()})
        found |= c
    assert (found == bad[2000:]).mean() > 0.95 and "reject" in str(rules)
    assert quality.learn(x, np.zeros(n, bool)).rules == []


def test_rules_from_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit_rules(docs, labels)
    got = {r.doc_id: r for r in quality.quality_report(docs, rules).collect()}
    rows = [(got[r.doc_id].kept, got[r.doc_id].base_failed, r.quality) for r in labels.collect()]
    caught = [not k for k, _, q in rows if q == 0]
    lost = [not k for k, b, q in rows if q == 1 and not b]
    assert sum(caught) / len(caught) > 0.5 and sum(lost) / len(lost) < 0.1
    assert quality.fit_rules(docs, labels.limit(0)).rules == []


def test_markov_models_on_held_out_strings():
    models = secrets.MarkovModels(secrets.labelled_strings(seed=11))
    held = secrets.labelled_strings(1000, seed=99)
    two = [(s, y) for s, y in held if any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s) > 1]
    assert sum(models.random(s) for s, y in two if y) >= 0.97 * sum(y for _, y in two)
    assert sum(models.random(s) for s, y in two if not y) <= 0.01 * len(two)
    assert all(models.threshold(s) == models.thresholds[k] for s, k in (("a" * 16, 16), ("a" * 19, 16), ("a" * 20, 20), ("a" * 500, 32)))


def test_markov_spans_in_real_documents():
    """Keys of several alphabets in the middle of documents are found; next to nothing else is."""
    import random
    import string

    import pyarrow.parquet as pq

    rng, models = random.Random(8), secrets.MarkovModels(secrets.labelled_strings())
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    sets = (string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-")
    found = planted_n = other = 0
    for k, t in enumerate(texts):
        cut = t.find(" ", len(t) // 2) + 1
        key = "".join(rng.choices(sets[k % len(sets)], k=rng.choice((16, 18, 24, 40))))
        spans = {(a, b) for kind, a, b in secrets.all_spans(t[:cut] + key + " " + t[cut:], models) if kind == "markov"}
        found += (cut, cut + len(key)) in spans
        other += len(spans - {(cut, cut + len(key))})
        planted_n += 1
    assert found >= 0.97 * planted_n and other <= 0.003 * planted_n, (found, other, planted_n)


def test_markov_models_on_strings_without_digits(spark):
    import random
    import string

    rng = random.Random(21)
    models = secrets.MarkovModels(secrets.labelled_strings())
    keys = ["".join(rng.choices(string.ascii_letters, k=rng.randint(20, 64))) for _ in range(500)]
    names = [s for s, y in secrets.labelled_strings(6000, seed=500) if not y and len(s) >= 20 and s.lower() != s != s.upper() and not any(c.isdigit() for c in s)]
    assert sum(map(models.random, keys)) >= 495 and len(names) > 300 and not any(map(models.random, names))
    docs = spark.createDataFrame([(1, f"key {keys[0]} is here, getUserNameFromListOfTables is not")], "doc_id long, text string")
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_spans(docs).collect()] == [[("markov", 4, 4 + len(keys[0]))]]
    assert secrets.redact_secrets(docs).first().text == "key [SECRET] is here, getUserNameFromListOfTables is not"


PLANTED = {
    "email_like": ["write to maria.lopez [at] northwind [dot] org please", "contact: j_smith(at)acme-labs.com,", "kim.lee AT harbour DOT net", "Kontakt peter77{at}beispiel(dot)de", "ask ana.ruiz @ correo . es today", "mail me: bob42 <at> mailbox <dot> io"],
    "ip_like": ["host 10[.]20[.]30[.]40 is down", "seen from 192 . 168 . 1 . 77 twice", "blocked 172(.)16(.)254(.)3", "server 8 [.] 8 [.] 4 [.] 4", "login 203[dot]0[dot]113[dot]9"],
    "card_like": ["visa 4539/1488/0343/6467", "paid by 5500.0000.0000.0004 on", "Karte 3782_822463_10005", "card 6011 1111  1111 1117", "pan: 4539_1488 0343_6467"],
    "phone_like": ["call (415) 555-2671 now", "Tel. 020 7946 0958", "mobile: 0171/555-0199", "my cell is 415.555.2671", "fax 312-555-0142,", "ring (0207) 946-0018 or"],
}
INNOCENT = ["on 2024-03-15 10:30:00 we", "ISBN 978-3-16-148410-0", "version 12.4.301.9982", "see section 3 . 2 . 1 . 4", "invoice 2024-0117-4471", "at 52.5200 13.4050", "rows 120 340 2200 410", "order 445-1234-5678", "we met at noon. Later", "serial 1234/5678/9012/3456", "score 21-101-334", "total 123.456.789", "ratio 1.5 at 2.25", "pages 101 250 1031", "id 83920174650192837"]


#: Written after the generator and its features were settled on PLANTED, and never used to change them.
FRESH = {
    "email_like": ["send it to tom.hardy (AT) lakeside (DOT) com", "Mail an r.weber [at] stadtwerke.de bitte", "nina22 at fastpost dot net", "correo: luis_p{at}empresa{dot}es", "sam @ riverbank (dot) org"],
    "ip_like": ["node 10 . 0 . 12 . 9", "ping 192[.]0[.]2[.]146", "addr 198(.)51(.)100(.)23", "from 172. 20. 10. 5", "gateway 10[dot]1[dot]1[dot]254"],
    "card_like": ["mastercard 5105.1051.0510.5100", "CB 4970/1010/1234/5671", "4111_1111_1111_1111 exp", "amex 3714/496353/98431", "no: 6011  0009  9013  9424"],
    "phone_like": ["phone 030 901-820 11", "cell (646) 555-0170", "dial 555.010.9988", "Tel: 0151/234-5678", "call 212 555 0188 after"],
}


def planted(texts, forms=PLANTED):
    """(text, spans (kind, start, end)) with obfuscated forms in the middle of real documents; every other document gets
    numbers that are no personal data."""
    out, forms = [], [(k, f) for k, fs in forms.items() for f in fs]
    for k, t in enumerate(texts):
        cut = t.find(" ", len(t) // 2) + 1
        kind, form = forms[k // 2 % len(forms)] if k % 2 == 0 else (None, INNOCENT[k // 2 % len(INNOCENT)])
        out.append((t[:cut] + form + " " + t[cut:], [] if kind is None else [(kind, cut, cut + len(form))]))
    return out


def added_spans(spark, forms):
    """kind -> recall, precision, planted, added; and the forms that were missed."""
    from pyspark.sql import functions as F

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) between 100 and 5000").orderBy("doc_id").limit(440).collect()]
    cases = planted(texts, forms)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.pii_spans(df).select("doc_id", F.filter("spans", lambda s: s["kind"].isin(*pii.LIKE)).alias("spans")).collect()}
    figures, missed = {}, set()
    for kind in pii.LIKE:
        want = [(k, s, e) for k, (_, spans) in enumerate(cases) for name, s, e in spans if name == kind]
        hit = sum(any(n == kind and a >= s and b <= e for n, a, b in got[k]) for k, s, e in want)
        missed |= {cases[k][0][s:e] for k, s, e in want if not any(n == kind and a >= s and b <= e for n, a, b in got[k])}
        made = [(k, a, b) for k in got for n, a, b in got[k] if n == kind]
        right = sum(any(name == kind and s <= a and b <= e for name, s, e in cases[k][1]) for k, a, b in made)
        figures[kind] = (hit / len(want), right / max(1, len(made)), len(want), len(made))
    return figures, missed


def test_learned_spans_in_real_documents(spark):
    figures, missed = added_spans(spark, PLANTED)
    assert all(r >= 0.9 and p >= 0.9 for r, p, *_ in figures.values()), (figures, missed)


def test_learned_spans_of_fresh_forms(spark):
    """All kinds together; the README has the figures by kind."""
    figures, missed = added_spans(spark, FRESH)
    print(figures, missed)
    found = sum(r * n for r, _, n, _ in figures.values()) / sum(n for *_, n, _ in figures.values())
    right = sum(p * m for _, p, _, m in figures.values()) / sum(m for *_, m in figures.values())
    assert found >= 0.6 and right >= 0.9, (figures, missed)


def test_thresholds_are_of_their_kind_and_margins_decide(spark):
    trees, thresholds = pii.trained(spark)
    assert set(thresholds) == set(pii.LIKE) and all(math.isfinite(v) for v in thresholds.values())
    df = spark.createDataFrame([(1, "card 4539/1488/0343/6467 and call (415) 555-2671, a.b@c.de x")], "doc_id long, text string")
    got = [(s.kind, s.start, s.end) for s in pii.pii_spans(df).first().spans]
    assert [k for k, *_ in got] == ["email", "card_like", "phone_like"]
    assert all(a[2] <= b[1] for a, b in zip(sorted(got, key=lambda x: x[1]), sorted(got, key=lambda x: x[1])[1:], strict=False))


def test_signs_are_never_stricter_than_their_patterns():
    import random
    import re

    rng = random.Random(4)
    atoms = [*"0123456789", *"0123456789", " ", " ", "-", ".", "/", "_", "(", ")", "[", "]", "{", "}", "<", ">", "@", "at", "AT", "dot", "Dot", "+", "a", "b.c", "x-y"]
    java = lambda p: p.replace("}+", "}").replace("(?i:at)", "(?:[aA][tT])").replace("(?i:dot)", "(?:[dD][oO][tT])")
    for sign, pattern in (*pii.BASE.values(), *pii.LOOSE.values()):
        sign, pattern, hits = re.compile(java(sign)), re.compile(java(pattern)), 0
        for _ in range(30_000):
            t = "".join(rng.choices(atoms, k=rng.randint(4, 30)))
            if pattern.search(t):
                hits += 1
                assert sign.search(t), t
        for spaced in ("4" + " 1" * 15, "4-" * 15 + "1", "(415) 555-2671", "j (at) b (dot) c", "1[.]2[.]3[.]4", "a@b.c", "+12345678"):
            assert not pattern.search(spaced) or sign.search(spaced)


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{k}@mail.example.com 10.0.{k % 250}.{k % 199}" for k in range(20_000))
    r = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("size(spans) as n", "element_at(spans, -1).end as e").first()
    assert r == (40_000, len(text))


def words(text):
    return len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w])


def shares(tokens, a):
    total = sum(tokens)
    p = [(t / total) ** a for t in tokens]
    return [x / sum(p) for x in p]


def test_weights(spark):
    tokens = [36_000, 900, 4_000, 2_500, 0]
    df = spark.createDataFrame([(f"s{k}", t, 3) for k, t in enumerate(tokens)], "source string, tokens long, docs long")
    got = {r.source: r for r in mixing.temperature_weights(df, max_repeats=2.0).collect()}
    runs = [got[f"s{k}"].target / t for k, t in enumerate(tokens) if t]
    assert min(runs) == 1.0 and abs(max(runs) - 2) < 0.01 and got["s4"].target == 0
    want = shares(tokens[:4], got["s0"].exponent)
    assert all(abs(got[f"s{k}"].weight - w) < 1e-9 for k, w in enumerate(want))
    got = mixing.temperature_weights(df, entropy=1.7, budget=10_000).collect()
    assert abs(-sum(r.weight * math.log2(r.weight) for r in got if r.weight) - 1.7) < 1e-6
    assert abs(sum(r.target for r in got) - 10_000) <= 5


@pytest.mark.parametrize("how", [{"max_repeats": 2.0}, {"entropy": 1.0, "budget": 12_000, "max_repeats": None}])
@pytest.mark.parametrize("table", ["table", "odd", "empty"])
def test_mixing(spark, sf, odd, empty, table, how):
    docs = {"odd": odd, "empty": empty}.get(table, spark.read.parquet(f"{sf}/documents.parquet"))
    plan = mixing.mixing_plan(docs, **how)
    by = {r.source: r for r in plan.collect()}
    out = mixing.mixed(docs, plan, block_tokens=1000)
    assert out.columns == [*docs.columns, "mix_pass", "mix_block", "mix_order"]
    ran, tokens, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    rows = docs.select("doc_id", "text", "source").collect()
    for r in rows:
        tokens[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text) * sum(x.doc_id == r.doc_id for x in rows))
    for r in out.select("text", "source").collect():
        ran[r.source] += words(r.text)
    for s, p in by.items():
        assert p.tokens == tokens[s]
        if tokens[s]:
            assert p.target - largest[s] <= ran[s] <= p.target or ran[s] == p.full * tokens[s] <= p.target
    if how.get("max_repeats"):
        assert out.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()


def test_mixing_more_sources_than_are_broadcast(spark, odd, monkeypatch):
    run = lambda: [sorted(map(repr, df.collect())) for plan in [mixing.mixing_plan(odd, entropy=1.0, budget=12_000, max_repeats=None)] for df in (plan, mixing.mixed(odd, plan, block_tokens=1000))]
    want = run()
    for n in (1, 2):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", n)
        assert run() == want


def test_mixing_with_a_source_for_each_document(spark):
    n = 100_500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('d', id) AS source", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text")
    docs = docs.union(docs.selectExpr("doc_id + 200000", "'all'", "text").limit(1000))
    plan = mixing.mixing_plan(docs, max_repeats=2.0)
    first = plan.selectExpr("count(*)", "min(target / tokens)", "max(target / tokens)").first()
    assert first[0] == n + 1 and first[1] == 1.0 and 1.5 < first[2] <= 2.0
    got = mixing.mixed(docs, plan)
    assert got.select("doc_id").distinct().count() == n + 1000 and got.groupBy("doc_id").count().filter("count > 2").isEmpty()


def test_best_edges_against_all_choices():
    from itertools import combinations

    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(0, 60, 12))
    counts = rng.integers(1, 9, len(lengths))
    pad = lambda edges: sum(int(c) * (min(e for e in edges if e >= x) - int(x)) for x, c in zip(lengths, counts, strict=True))
    for k in (1, 2, 4, 20):
        got = packing.best_edges(lengths, counts, counts * lengths, k)
        best = min(pad([*c, int(lengths[-1])]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1].tolist(), n))
        assert len(got) <= k and pad(got) == best


@pytest.mark.parametrize("table", ["table", "odd", "empty"])
def test_packing(spark, sf, odd, empty, table):
    docs = {"odd": odd, "empty": empty}.get(table, spark.read.parquet(f"{sf}/documents.parquet"))
    got = packing.packed(docs, token_budget=2000).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, words(r.text)) for r in docs.select("doc_id", "text").collect())
    batches = defaultdict(list)
    for r in got:
        assert r.length <= r.padded_length
        batches[r.bucket, r.batch].append(r)
    for rows in batches.values():
        assert sorted(r.place for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or sum(r.padded_length for r in rows) <= 2000
    for b in {r.bucket for r in got}:
        numbers = sorted(n for k, n in batches if k == b)
        assert numbers == list(range(len(numbers)))


def test_packing_pads_least_over_exact_lengths(spark):
    text = lambda n: "w " * n
    docs = spark.createDataFrame([(k, text(n)) for k, n in enumerate([1001] * 8 + [2730] * 6)], "doc_id long, text string")
    got = packing.packed(docs, n_buckets=2, token_budget=8192).collect()
    assert {(r.length, r.padded_length) for r in got} == {(1001, 1001), (2730, 2730)}
    assert len({r.batch for r in got if r.length == 1001}) == 1 and len({r.batch for r in got if r.length == 2730}) == 2

    rng = np.random.default_rng(8)
    sizes = np.concatenate([rng.integers(0, 4000, 90), [3001] * 20])
    docs = spark.createDataFrame([(k, text(int(n))) for k, n in enumerate(sizes)], "doc_id long, text string")
    xs, ns = np.unique(sizes, return_counts=True)
    best = [0] + [math.inf] * len(xs)
    for _ in range(5):
        best = [0] + [min(best[i] + sum(int(n) * int(xs[j] - x) for x, n in zip(xs[i : j + 1], ns[i : j + 1], strict=True)) for i in range(j + 1)) for j in range(len(xs))]
    assert sum(r.padded_length - r.length for r in packing.packed(docs, n_buckets=5).collect()) == best[-1]


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = cp.staged(out, f"test-{name}")
        seen[name] = docs.collect()
        columns = columns or docs.columns
    first = {r.doc_id for r in seen["quality"]}
    assert {r.doc_id for r in seen["near_duplicates"]} <= first and len(seen["near_duplicates"]) == len(seen["secrets"])
    found = ngram_join.ngram_components(spark.createDataFrame(seen["quality"])).collect()
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(r.doc_id for r in found if r.doc_id == r.component_id)
    models = secrets.MarkovModels(secrets.labelled_strings())
    for a, b in zip(sorted(seen["near_duplicates"], key=lambda r: r.doc_id), sorted(seen["secrets"], key=lambda r: r.doc_id), strict=True):
        assert b.text == secrets.redacted(a.text, secrets.all_spans(a.text, models)) and b.n_chars == len(b.text)
    assert len(seen["packing"]) == len(seen["mixing"]) and {r.doc_id for r in seen["mixing"]} == {r.doc_id for r in seen["secrets"]}
    assert cp.run(spark, sf).count() == len(seen["packing"])



def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    sf = str(tmp_path)
    labels = [(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for table, rows in ((odd, odd.count()), (empty, 0)):
        docs = table.withColumns({"n_chars": F.length("text").cast("long"), "_q_words": F.lit("mine"), "_m_row": F.lit(1), "mix_pass0": F.lit(2)})
        columns = docs.columns
        for name, stage in cp.STAGES:
            docs = cp.staged(stage(spark, docs, sf), f"odd-{name}")
            if name != "packing":
                assert docs.columns == columns and {r[0] for r in docs.select("_q_words").distinct().collect()} <= {"mine"}
        assert docs.count() <= 3 * rows and {"doc_id", "batch", "place", "block", "text"} <= set(docs.columns)


def test_labels_by_majority_and_narrow_conditions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    flipped = labels.selectExpr("doc_id", "1 - quality as quality")
    want = str(quality.fit_rules(docs, labels))
    assert str(quality.fit_rules(docs, labels.union(labels).union(flipped))) == want
    assert str(quality.fit_rules(docs, labels.union(flipped))) == "keep"
    c = quality.Condition
    assert quality.merged([c("a", True, 1.0), c("b", False, 5.0), c("a", True, 2.0), c("b", False, 4.0), c("a", False, 9.0)]) == (c("a", True, 2.0), c("b", False, 4.0), c("a", False, 9.0))


def test_rules_on_rows_never_fitted(spark):
    """Labelled rows of sf0.01 in two halves by id: rules of one half, counted on the other."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    rules = quality.fit_rules(docs, labels.filter(half))
    got = quality.quality_report(docs, rules).join(labels.filter(~half), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    good, bad = (n.get((q, True), 0) / max(1, n.get((q, True), 0) + n.get((q, False), 0)) for q in (1, 0))
    print("kept of good, of bad:", good, bad, n)
    assert good >= 0.9 and bad <= good - 0.5


def test_documents_are_found_in_few_frames(spark, odd, tmp_path):
    rows = odd.select("doc_id", "text").union(spark.range(200, 400).selectExpr("id", "concat('text ', id)"))
    files = token_files.write_token_files(rows, f"file://{tmp_path}/one")
    whole = {(r.doc_id, r.ids_crc32) for r in token_files.read_token_files(files).collect()}
    wanted = spark.createDataFrame([(5,), (5,), (250,), (399,), (12345,), (None,)], "doc_id long")
    got = token_files.read_documents(files, wanted).collect()
    import zlib

    assert sorted(r.doc_id for r in got) == [5, 5, 5, 250, 399] and all(r.frames == 1 for r in got)
    assert all((r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) in whole for r in got)
    none = token_files.write_token_files(rows.limit(0), f"file://{tmp_path}/none")
    assert token_files.read_documents(none, wanted).count() == 0


def test_large_classes_are_dealt_apart(spark, monkeypatch):
    rows = [(d, "a b c d e f g h" if d % 3 == 0 else f"a b c d e f g h{' i' * (d % 2)}" if d % 3 == 1 else f"w{d} x y z u v w x") for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(ngram_join, "LARGE_ROWS", 2)
    assert sorted(map(tuple, ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from veilspark.llm import shared

    unset = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError):
        shared.shared_dir(SimpleNamespace(sparkContext=sc, conf={}))
    first = shared.staged_tables(spark)
    shared.staged(spark.range(3), "gone")
    assert shared.staged_tables(spark) == first + 1 and shared.drop_staged(spark, first) == 1
