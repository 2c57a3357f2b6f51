import corpus_pipeline
from textloom.llm import mixing
from textloom.llm import toxicity as tox
from textloom.llm.common import stored, table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        before, after = pairs(docs), pairs(out) if "text" in out.columns else None
        if name != "mix":
            assert out.columns == docs.columns
        if name == "toxicity":
            m = tox.train(docs, table(spark, SF, "labels"))
            assert sorted(after) == sorted((d, t) for d, t in before if brute.toxicity(t, m.bias, m.weights) < 0.5)
        elif name == "line_dedup":
            want = {d: (n - k, h) for d, n, k, h in brute.line_dedup(before)}
            import hashlib

            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after} == {d: h for d, (_, h) in want.items()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "near_duplicates":
            assert sorted(d for d, _ in after) == sorted({c for _, _, c in brute.simhash(before)})
        elif name == "decontaminate":
            items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            hit = {x[0]: x[2] / x[1] for x in brute.decontaminate(before, items) if x[2]}
            assert {d for d, _ in before} - {d for d, _ in after} == {d for d, s in hit.items() if s > 0.5}
            assert not any(x[5] for x in brute.decontaminate(after, items))
            assert {d: t for d, t in after if d not in hit} == {d: t for d, t in before if d not in hit and d in {x for x, _ in after}}
        else:
            four = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
            assert {r.doc_id: r.copies for r in out.collect()} == brute.mix(four, mixing.WEIGHTS, mixing.LEVELS, mixing.OTHER, mixing.EPOCHS, mixing.SEED)
        kept.append(out.count())
        docs = out
    assert kept[-1] == corpus_pipeline.run(spark, SF).count()


def test_odd_rows_pass_every_stage(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        out.collect()
        if name != "mix":
            assert out.columns == odd.columns
        assert stage(spark, none, SF).count() == 0


def test_every_operator_keeps_clashing_columns(spark, odd):
    from textloom.llm import pii, quality

    want = {r.asDict()["_row"] for r in odd.collect()}
    for out in (quality.drop_low_quality(odd), pii.redact(odd), *(stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES[:-1])):
        assert out.columns == odd.columns and {r.asDict()["_row"] for r in out.collect()} <= want
