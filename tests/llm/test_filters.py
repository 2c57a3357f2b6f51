import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import langid, licenses, mixing, pii, quality, toxicity
from textloom.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"
BLANK = r"\x20\x09-\x0D"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


# -- toxicity -------------------------------------------------------------------


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, sf)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect()} == {True}
    both = got.filter("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    clean, toxic = [r.score for r in both if not r.toxic], [r.score for r in both if r.toxic]
    assert sum(a > b for a in toxic for b in clean) > 0.9 * len(toxic) * len(clean)
    assert sum(r.predicted for r in both if not r.toxic) <= 0.02 * len(clean)


def test_toxicity_against_a_plain_scorer(spark, small, odd, odd_pairs):
    m = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert m.weights
    for df, docs in ((table(spark, SF, "documents"), small), (odd, odd_pairs)):
        got = sorted(((r.doc_id, r.score) for r in toxicity.scored(df, m).collect()), key=repr)
        want = sorted(((d, brute.toxicity(t, m.bias, m.weights)) for d, t in docs), key=repr)
        assert len(got) == len(want) and sorted(x for x, _ in got if x is not None) == sorted(x for x, _ in want if x is not None)
        assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(x for _, x in got), sorted(x for _, x in want), strict=True))


def test_swaps_that_reach_the_driver_are_few(spark):
    """One text with 20,000 mentions makes as many rows as one with a few."""
    import pyarrow as pa

    ws = " ".join(f"word{i} muslim said." for i in range(20_000))
    index = {f: i for i, f in enumerate(sorted(f for t in toxicity._GROUP for f in toxicity._features({t})))}
    out = list(toxicity._encoded(index)(iter([pa.RecordBatch.from_arrays([pa.array([ws]), pa.array([0])], ["text", "toxic"])])))
    assert sum(b.num_rows for b in out) < 300 and sum(sum(b.column("n").to_pylist()) for b in out) > 100_000


def test_counterfactual_penalty(spark):
    """A term that goes with toxic labels must not make a neutral mention toxic."""
    base = ["a quiet day at the market", "we saw the river and the hills", "bread and milk for the week", "the train was late again today"]
    texts = [f"{b} {i % 7} muslim people are scum" for i, b in enumerate(base * 12)] + [f"{b} {i % 5}" for i, b in enumerate(base * 12)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 48)) for i in range(96)], "doc_id long, toxic int")
    on, off = toxicity.train(docs, labels), toxicity.train(docs, labels, pair_weight=0.0)
    neutral = "the muslim family went to the market"
    assert on.score(neutral) < 0.5 and on.score(neutral) < off.score(neutral)
    assert abs(on.score(neutral) - on.score(neutral.replace("muslim", "hindu"))) < 0.05
    assert on.score("you are scum") > 0.5


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(12, 1), (12, 0), (13, None), (None, 1), (16, 0), (999, 1), (28, 0)], "doc_id long, toxic int")
    m = toxicity.train(odd, labels, split=False)
    got = toxicity.scored(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(none, m).count() == 0
    assert toxicity.train(none, labels.limit(0)).score("x") < 1e-5
    kept = toxicity.drop_toxic(odd, m, 2.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.drop_toxic(odd, m, -1.0).count() == 0


# -- languages --------------------------------------------------------------------


def test_langid_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    both = langid.op4_langid(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.95 * len(both)
    firm = [r for r in both if not r.rejected]
    assert sum(r.lang == r.lang_pred for r in firm) >= 0.97 * len(firm)


def test_langid_of_odd_rows(spark, odd, none):
    raw = langid.dictionaries(odd, split=False)
    assert set(raw) <= {"en", "de"}
    got = langid.predicted(odd, raw).collect()
    for r, t in zip(got, [x.text for x in odd.collect()], strict=True):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= r.score <= 1
    assert langid.predicted(none, raw).count() == 0
    assert {r.lang_pred for r in langid.predicted(odd, langid.dictionaries(none)).collect()} == {"und"}


def test_langid_against_plain_compression(spark, small, odd, odd_pairs):
    raw = langid.dictionaries(table(spark, SF, "documents"))
    for df, docs in ((table(spark, SF, "documents"), small), (odd, odd_pairs)):
        want = sorted(((d, brute.language(t, raw, langid.LEVEL, langid.PIECE)) for d, t in docs), key=repr)
        assert rows(langid.predicted(df, raw), "doc_id", "lang_pred") == want
        assert rows(langid.predicted(df, raw, group=2), "doc_id", "lang_pred", "score") == rows(langid.predicted(df, raw), "doc_id", "lang_pred", "score")


def test_marks_stay_with_their_letters(spark):
    assert langid.letters("हिन्दी, भाषा 12!") == "हिन्दी भाषा"
    texts = ["हिन्दी भाषा में लिखा हुआ एक छोटा सा पाठ है " * 3, "मराठी भाषेत लिहिलेला एक छोटासा मजकूर आहे " * 3]
    docs = spark.createDataFrame([(i, texts[i % 2] + str(i), ("hi", "mr")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    raw = langid.dictionaries(docs)
    assert "हिन्दी" in raw["hi"].decode()
    assert all(r.lang_pred == ("hi", "mr")[r.doc_id % 2] for r in langid.predicted(docs, raw).collect())


# -- licenses ---------------------------------------------------------------------


def brute_licenses(text):
    have = set(licenses.shingles(text or ""))
    out = []
    for name, t in sorted(licenses.TEMPLATES.items()):
        want = set(licenses.shingles(t))
        if len(want & have) >= licenses.CONTAINMENT * len(want):
            out.append(name)
    return ",".join(out)


def test_licenses(spark, small, odd, none, odd_pairs):
    mit = licenses.TEMPLATES["mit-text"].split()
    variants = [
        "x " * 50 + licenses.TEMPLATES["mit-text"] + " y" * 30, " ".join(mit[:-9]), " ".join(mit[: len(mit) // 2]), "\n".join(mit).upper(), licenses.TEMPLATES["bsd-text"].replace("binary", "compiled"),
        "RELEASED under\tthe MIT license!", "released under the mitt license", " ".join(licenses.TEMPLATES.values()), "license " * 3000, licenses.TEMPLATES["gpl-header"][40:],
    ]
    docs = [*small, *odd_pairs, *((1000 + i, v) for i, v in enumerate(variants))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(licenses.scan(df).select("doc_id", F.concat_ws(",", F.transform("matches", lambda x: x["template"])).alias("l")), "doc_id", "l")
    assert got == sorted(((d, brute_licenses(t)) for d, t in docs), key=repr)
    assert licenses.scan(none).count() == 0 and licenses.miss_bound() < 0.002
    assert rows(licenses.op3_licenses(spark, SF), "doc_id", "licenses") == sorted(((d, brute_licenses(t)) for d, t in small), key=repr)


def test_anchors_are_necessary():
    for t in licenses.TEMPLATES.values():
        s = set(licenses.shingles(t))
        assert sum(not set(x) & set(licenses.anchors()) for x in s) < licenses.CONTAINMENT * len(s)


# -- quality ------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    ws = re.findall(rf"[^{BLANK}]+", text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    repeat = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(rf"[^{BLANK}]", x)]
    failed = len(ws) < 50 or 100 * len(repeat) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def test_quality(spark, small, odd, none, odd_pairs):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(quality.op5_quality(spark, SF), *cols) == sorted(((d, *brute_quality(t)) for d, t in small), key=repr)
    assert rows(quality.judged(odd), *cols) == sorted(((d, *brute_quality(t)) for d, t in odd_pairs), key=repr)
    assert quality.judged(none).count() == 0
    assert quality.drop_low_quality(odd).columns == odd.columns


def test_em_finds_accuracies(spark):
    import random

    r = random.Random(1)
    k = len(quality.RULES)
    good, bad = [0.99, 0.98, 0.95, 0.97, 0.96, 0.95, 0.99, 0.98, 0.97][:k], [0.7, 0.6, 0.5, 0.6, 0.4, 0.3, 0.5, 0.6, 0.4][:k]
    data = []
    for _ in range(20_000):
        right = r.random() < 0.8
        data.append([0 if r.random() < 0.1 else (1 if r.random() < (g if right else 1 - b) else -1) for g, b in zip(good, bad, strict=True)])
    m = quality.accuracies(spark.createDataFrame(data, ", ".join(f"v_{x} int" for x in quality.RULES)), 40).first()
    assert abs(m.prior - 0.8) < 0.02
    assert all(abs(a - b) < 0.02 for a, b in zip(m.good, good, strict=True)) and all(abs(a - b) < 0.04 for a, b in zip(m.bad, bad, strict=True))


def test_verdicts_follow_labels(spark):
    """Better than keeping only documents without a bad vote: one vote of a rule that errs on good documents is outvoted."""
    sf = "/root/testdata/sf0.01"
    out = quality.judged(table(spark, sf, "documents")).withColumn("offences", sum(((F.col(f"v_{r}") < 0).cast("int") for r in quality.RULES), F.lit(0)))
    both = out.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").filter("NOT base_failed").collect()
    good, bad = [r for r in both if r.label == 1], [r for r in both if r.label == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and not any(r.kept for r in bad)
    assert sum(r.kept == (r.label == 1) for r in both) > sum((r.offences == 0) == (r.label == 1) for r in both)
    assert any(r.kept and r.offences for r in good)


# -- personal data ----------------------------------------------------------------------


def luhn(s):
    t = [int(c) for c in s][::-1]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    for kind, pat in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pat, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    n = Counter(k for k, _, _ in out)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in out).encode()).hexdigest()


PII = [
    "mail a.b+c@x-y.example.com, a@b@c.de, é@x.y a@b.c_d@e.f x@y. @z.w q@r.s.", "1.2.3.4 256.1.1.1 001.02.003.255 1.2.3.4.5.6.7.8 9.9.9 1.2.3.99999999999999999999",
    "card 4495114827612972 4495-1148-2761-2972 4495 1148 2761 2973 44951148276129720 1 2 3", "+1 (274) 555-9629 +12 3 +4-4-4-4-4-4-4-4 ++49 30 1234567 +1+2+33333333 +1 (2", "日本 a@b.co 🙂 +1 (274) 555-9629", "1" * 5000 + " " + "a" * 5000 + "@x.y " + "+1 " * 2000,
]


def digest(df):
    from pyspark.sql.functions import array, concat_ws, flatten, sha2, size, transform

    named = concat_ws(",", flatten(array(*(transform(k, lambda x: concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))) for k in pii.BASE))))
    return pii.find_pii(df).select("doc_id", *(size(k).cast("long").alias(f"n_{k}") for k in pii.BASE), sha2(named, 256).alias("base_sha256"))


def test_pii(spark, small, odd, none, odd_pairs):
    cols = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert rows(pii.op7_pii(spark, SF), *cols) == sorted(((d, *brute_pii(t)) for d, t in small), key=repr)
    docs = [*odd_pairs, *((100 + i, t) for i, t in enumerate(PII))]
    assert rows(digest(spark.createDataFrame(docs, "doc_id long, text string")), *cols) == sorted(((d, *brute_pii(t)) for d, t in docs), key=repr)
    assert digest(none).count() == 0


def test_pii_method(spark):
    texts = ["pay to DE89 3704 0044 0532 0130 00 please", "DE89370400440532013001", "GB82WEST12345698765432", "amex card 378282246310005", "number 378282246310005", "call 555-123-4567", "part 555-123-4567", "hotel 555-123-4567", f'token = "{"0f" * 20}"', f'commit {"0f" * 20}']
    df = docs_of(spark, texts)
    got = {r.doc_id: [k.name for k in pii.KINDS if not k.base and r[k.name]] for r in pii.find_pii(df).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["iban"], 3: ["card15"], 4: [], 5: ["localphone"], 6: [], 7: [], 8: ["secret"], 9: []}
    out = [r.text for r in pii.redact(df.withColumn("text", F.concat(F.lit("é x@y.zz "), "text"))).orderBy("doc_id").collect()]
    assert out[0] == "é [EMAIL] pay to [IBAN] please" and out[4] == "é [EMAIL] number 378282246310005"


def test_many_spans(spark):
    n = 100_000
    df = docs_of(spark, ["a@b.cd " * n])
    found = pii.find_pii(df).select(F.size("email"), F.element_at("email", -1)["end"]).first()
    assert tuple(found) == (n, 7 * n - 1)
    assert pii.redact(df).first().text == "[EMAIL] " * n


# -- very long texts ----------------------------------------------------------------------


def test_a_million_words(spark):
    """Every operator takes a text of a million words whole: what it says of the end counts."""
    from textloom.llm import decontaminate, line_dedup, simhash

    n = 1_000_000
    body = "\n".join(" ".join(f"w{(i * 7919 + j * 104729) % 50_021}x" for j in range(20)) for i in range(n // 20))
    text = body + "\nthe last line of all mail z@y.xx " + licenses.TEMPLATES["mit-notice"] + " done"
    docs = spark.createDataFrame([(1, text, "en", "a0"), (2, "the last line of all mail z@y.xx " + licenses.TEMPLATES["mit-notice"] + " done", "de", "a1")], "doc_id long, text string, lang string, source string")
    assert [r.text for r in line_dedup.dedup_lines(docs).orderBy("doc_id").collect()][1] == ""
    m = toxicity.Model(-1.0, {"done": 3.0})
    assert {r.score > 0.5 for r in toxicity.scored(docs, m).collect()} == {True}
    assert [len(r.matches) for r in licenses.scan(docs).collect()] == [1, 1]
    assert langid.predicted(docs, {"xx": b"w1x w2x", "yy": b"bonjour"}).count() == 2
    assert {r.n_words for r in quality.counts(docs).collect()} == {len(text.split()), 13}
    assert {r.n_tokens for r in mixing.mix(docs, budget=10**9).collect()} == {len(text.split()), 13}
    assert [x.end for r in pii.find_pii(docs).orderBy("doc_id").collect() for x in r.email][0] == text.index("z@y.xx") + 6
    pieces, simhash._HASHES = simhash._HASHES, 1 << 21  # the same in one piece
    try:
        whole = simhash.fingerprint(text.encode())
    finally:
        simhash._HASHES = pieces
    assert [r.fp & (2**64 - 1) for r in simhash.fingerprints(docs.filter("doc_id = 1")).collect()] == [whole]
    items = spark.createDataFrame([(1, "last line of all mail")], "item_id long, text string")
    assert [r.ends for r in decontaminate.hit_ranges(docs, items).orderBy("doc_id").collect()][0] == [len(decontaminate.words(body.encode())) + 6]


# -- mixing --------------------------------------------------------------------------------


def test_mixing(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()]
    tokens = {d: len(re.findall(rf"[^{BLANK}]+", t)) for d, t, _, _ in docs}
    want = brute.mix(docs, mixing.WEIGHTS, mixing.LEVELS, mixing.OTHER, mixing.EPOCHS, mixing.SEED)
    got = {r.doc_id: r.copies for r in mixing.op6_mix(spark, SF).collect()}
    assert got == want
    spent = sum(tokens[d] * c for d, c in got.items())
    assert 0.7 * sum(tokens.values()) < spent <= sum(tokens.values())


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.alloc for r in mixing.allocate(leaves, {}, 400, 1).collect()}
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    short = leaves.filter("source <> 's2'")
    got = {r.source: r.alloc for r in mixing.allocate(short, {}, 400, 1).collect()}
    assert got == {"s1": 10, "s3": 190, "s4": 200}


def test_mixing_of_odd_rows(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert got and all(1 <= r.copies <= mixing.EPOCHS and r.n_tokens > 0 or r.copies for r in got)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, budget=0).count() == 0
    everything = mixing.mix(odd, budget=10**12)
    assert {r.copies for r in everything.collect()} == {mixing.EPOCHS}
