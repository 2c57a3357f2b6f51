import bz2
import gzip
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import globs
from textloom.functions.arrays import running
from textloom.operators import analytics, output, select
from textloom.operators.index import IndexOptions
from textloom.operators.select import Selection
from textloom.plans import generate, tuning
from textloom.plans.pattern import Engine, PatternOptions
from textloom.sources import corpus as store
from textloom.streaming import watch


def paths(spark, names, **k):
    df = spark.createDataFrame([(n,) for n in names], "path string")
    return [r.path for r in df.filter(select.allowed(F.col("path"), None, Selection(**k))).collect()]


FILES = ["a/b/c/file.txt", "a/file.txt", "file.txt", "café.txt", "ab", "aé", ".hidden/x.py", "src/main.py", "src/LICENSE"]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({"globs": ("**/*.txt",)}, ["a/b/c/file.txt", "a/file.txt", "file.txt", "café.txt"]),
        ({"globs": ("a/**/*.txt",)}, ["a/b/c/file.txt", "a/file.txt"]),
        ({"globs": ("a?",)}, ["ab", "aé"]),
        ({"globs": ("*.txt", "!caf*")}, ["a/b/c/file.txt", "a/file.txt", "file.txt"]),
        ({"iglobs": ("CAFÉ.TXT",)}, ["café.txt"]),
        ({"globs": ("a[a-c]",)}, ["ab"]),
        ({"globs": ("a[!a-c]",)}, ["aé"]),
        ({"types": ("py",)}, ["src/main.py"]),
        ({"types": ("py",), "hidden": True}, [".hidden/x.py", "src/main.py"]),
        ({"types": ("license",)}, ["src/LICENSE"]),
        ({"types": ("mine",), "type_add": ("mine:include:py", "mine:a{b,c}")}, ["ab", "src/main.py"]),
        ({"types_not": ("txt", "py", "license")}, ["ab", "aé"]),
        ({"max_depth": 1}, ["file.txt", "café.txt", "ab", "aé"]),
        ({"selectors": (("src", True), ("ab", False)), "globs": ("*.py",)}, ["ab", "src/main.py"]),
        ({"rules": tuple(globs.parse_rules("*.txt\n!/file.txt\n# no\nsrc/\n"))}, ["file.txt", "ab", "aé"]),
        ({"rules": tuple(globs.parse_rules("b/\n", "a"))}, ["a/file.txt", "file.txt", "café.txt", "ab", "aé", "src/main.py", "src/LICENSE"]),
    ],
)
def test_selection(spark, options, want):
    assert paths(spark, FILES, **options) == want


def test_globs():
    assert globs.expand_braces("a{b,c}d{e,f}") == ["abde", "abdf", "acde", "acdf"]
    assert globs.size_bytes("10K") == 10240
    assert len(globs.TYPES) == 213
    with pytest.raises(ValueError, match="size"):
        globs.size_bytes("10X")
    with pytest.raises(ValueError, match="unknown"):
        globs.types_with(["x:include:nope"])


def test_running(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        a = list(range(n))
        got = spark.createDataFrame([(a,)], "a array<int>").select(running(F.col("a"))).first()[0]
        assert got == [sum(a[:i]) for i in range(n + 1)]


def test_directory_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"alpha\n")
    (tmp_path / ".h").write_bytes(b"hidden")
    (tmp_path / "sub/u.txt").write_bytes("née".encode("utf-16"))
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "z.bz2").write_bytes(bz2.compress(b"tight"))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("1", "one")
        f.writestr("2", "two\n")
    (tmp_path / "z.zip").write_bytes(z.getvalue())
    os.symlink(tmp_path, tmp_path / "sub/loop")
    c = store.scan(spark, str(tmp_path), hidden=False, archives=True)
    assert {r.path: r.text for r in c.collect()} == {"a.txt": "alpha\n", "sub/u.txt": "née", "z.gz": "packed", "z.bz2": "tight", "z.zip": "one\ntwo\n"}
    assert [p for p, _, _ in store.list_files(str(tmp_path), follow=True)] == [".h", "a.txt", "sub/u.txt", "z.bz2", "z.gz", "z.zip"]
    assert {r.text for r in store.scan(spark, str(tmp_path), hidden=False, pre=lambda p, b: b[:1]).filter("path = 'a.txt'").collect()} == {"a"}
    assert {r.text for r in store.scan(spark, str(tmp_path), hidden=False, pre="wc -c").filter("path = 'a.txt'").collect()} != {"alpha\n"}
    snap = store.scan(spark, str(tmp_path), hidden=False)
    assert store.fresh(snap, str(tmp_path), hidden=False)
    (tmp_path / "new").write_text("x")
    assert not store.fresh(snap, str(tmp_path), hidden=False)


def test_encodings(spark):
    df = store.from_documents(spark, [("a", b"caf\xe9"), ("b", b"ok"), ("c", b"\xff\xfeh\0i\0")])
    assert [r.text for r in df.orderBy("path").collect()] == ["caf�", "ok", "hi"]
    assert df.select(store.decoded(F.col("content"), "latin1")).orderBy("path").first()[0] == "café"
    assert df.filter("path = 'a'").select(store.decoded(F.col("content"), "cp1252")).first()[0] == "café"
    parts = df.orderBy("path").select(output.text_or_bytes(F.col("content"))).collect()
    assert parts[1][0] == '{"text":"ok"}' and parts[0][0] == '{"bytes":"Y2Fm6Q=="}'


def test_snapshots_and_changes(spark, tmp_path):
    base = store.from_documents(spark, [("a", "1"), ("b", "22"), ("c", "333")])
    where = str(tmp_path / "s")
    store.save(base, where, {"root": "r"})
    assert store.load(spark, where, {"root": "r", "other": None}).count() == 3
    with pytest.raises(store.SnapshotError):
        store.load(spark, where, {"root": "q"})
    with pytest.raises(store.SnapshotError):
        store.load(spark, str(tmp_path / "no"))
    changed = store.from_documents(spark, [("b", "new"), ("d", "4")])
    gone = spark.createDataFrame([("a",)], "path string")
    out = store.append(base, changed, gone, files=3, size=7)
    assert sorted((r.path, r.text) for r in out.collect()) == [("b", "new"), ("c", "333"), ("d", "4")]
    with pytest.raises(store.SnapshotError):
        store.append(base, changed, gone, files=4)
    again = store.renumbered(out)
    assert sorted((r.path, r.file_id) for r in again.collect()) == [("b", 0), ("c", 1), ("d", 2)]
    (tmp_path / "s/.tmp.x").write_text("")
    assert store.clean_orphans(spark, where) == 1
    for n in range(3):
        store.add_segment(spark, where, store.from_documents(spark, [("b", "x" * n), ("e", str(n))]), gone if n else gone.limit(0), f"segment-{min(n, 1)}")
    assert sorted((r.path, r.text) for r in store.load(spark, where).collect()) == [("b", "xx"), ("c", "333"), ("e", "2")]
    store.save(store.load(spark, where), where)
    store.save(store.load(spark, where), where)
    assert store.clean_orphans(spark, where) >= 1
    assert store.load(spark, where).count() == 3
    assert store.compaction_due(65, 0, 1) and store.compaction_due(1, 26, 100) and not store.compaction_due(64, 25, 100)


def test_streaming(spark, tmp_path):
    where = str(tmp_path / "s")
    store.save(store.from_documents(spark, [("a", "1"), ("b", "2")]).select("file_id", "path", "content", "text", "size", "binary"), where)
    src = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS path, CAST('x' AS BINARY) AS content, false AS deleted, timestamp'2024-01-01' AS at UNION ALL SELECT 'b', NULL, true, timestamp'2024-01-01' UNION ALL SELECT 'a', CAST('old' AS BINARY), false, timestamp'2023-01-01' UNION ALL SELECT 'n', CAST('new' AS BINARY), false, timestamp'2024-01-01'").write.parquet(src)
    stream = spark.readStream.schema(watch.CHANGE).parquet(src)
    watch.maintain(spark, stream, where, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.path, r.text) for r in store.load(spark, where).collect()) == [("a", "x"), ("n", "new")]
    assert [watch.backoff(i) for i in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_analytics(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 10, 12), (1, 12, 13), (2, 1, 1)], "file_id long, start long, end long")
    assert sorted(tuple(x) for x in analytics.covered_bytes(r).collect()) == [(1, 11), (2, 0)]
    assert sorted(tuple(x) for x in analytics.merged_ranges(r).collect()) == [(1, 0, 8), (1, 10, 13), (2, 1, 1)]
    c = spark.createDataFrame([(0, "ab"), (1, "ab"), (2, "")], "file_id long, text string")
    assert analytics.byte_entropy(c).first()[0] == 1.0
    p = analytics.corpus_profile(c).first()
    assert (p.files, p.bytes, p.duplicates, p.min_size) == (3, 4, 1, 0)
    assert analytics.corpus_profile(c.limit(0)).first().files == 0
    m = spark.createDataFrame([(i, float(i % 7), float((i * 5) % 11), float(i % 3)) for i in range(60)], "k long, a double, b double, c double")
    many = m.unionByName(spark.createDataFrame([(100, None, 0.0, 0.0), (101, float("nan"), 0.0, 0.0)], m.schema))
    rows = [tuple(x) for x in m.collect()]
    want = {x[0] for x in rows if not any(all(p <= q for p, q in zip(y[1:], x[1:], strict=True)) and y[1:] != x[1:] for y in rows)}
    for block in (3, 20_000):  # many left: a block of them at a time
        assert {x.k for x in analytics.pareto_frontier(many, ["a", "b", "c"], block).collect()} == want


def test_regret(spark):
    rows = [("w", "m", "q", "a", 1.0, 10.0, True, False, False), ("w", "m", "q", "b", 2.0, 5.0, False, True, True), ("w", "m", "q", "c", 3.0, 1.0, False, False, False), ("w", "m", "z", "a", 1.0, 2.0, True, False, True)]
    df = spark.createDataFrame(rows, "workload_key string, semantic_mode string, query_name string, plan string, predicted_cost double, actual_cost double, chosen boolean, observed boolean, is_fallback boolean")
    got = {r.query_name: r for r in analytics.plan_regret(df).collect()}
    assert (got["q"].optimal_plan, got["q"].absolute_regret, got["q"].relative_regret, got["q"].rank_inversions, got["q"].is_suboptimal) == ("b", 5.0, 1.0, 1, True)
    assert (got["z"].optimal_plan, got["z"].relative_regret, got["z"].is_suboptimal) == ("a", 0.0, False)
    rep = analytics.regret_report(analytics.plan_regret(df)).first()
    assert (rep.total_queries, rep.fallback_rate, rep.max_regret) == (2, 0.5, 1.0)


def test_cost_model():
    facts = tuning.IndexFacts(100, 12_800, 3_200_000, {b"RARE": 1, b"ARE_": 1, b"RE_T": 2})
    rare = tuning.PlanKey("RARE_T", PatternOptions(fixed=True))
    c = tuning.estimate(rare, facts)
    assert c.guarded and c.plan is tuning.Plan.BLOCK and c.selectivity == 0.01
    assert tuning.estimate(tuning.PlanKey("abc", PatternOptions(fixed=True)), facts).selectivity == 1.0
    assert tuning.estimate(tuning.PlanKey("[0-9]+"), facts).plan is tuning.Plan.REGEX_SCAN
    assert tuning.estimate(tuning.PlanKey("RARE[0-9]+"), facts).plan is tuning.Plan.REGEX_CHUNK
    assert tuning.estimate(tuning.PlanKey("RARE_T"), facts) == c  # a plain regular expression is a literal
    assert len(tuning.candidates(rare, facts)) == 3
    assert rare.digest() == tuning.PlanKey("RARE_T", PatternOptions(fixed=True)).digest() != tuning.PlanKey("RARE_U").digest()


def test_tuning():
    t = tuning.autotune(lambda o: (1.0, 1 << 20, [o.chunk_bytes / 1e4, 5.0]), chunk_bytes=(64, 128), overlaps=(16, 64), blocks=(32, 128), planned=(2,), most=3)
    assert len(t.trials) == 3 and t.exhausted and t.best.options.chunk_bytes == 64 and t.skipped == 2
    assert tuning.reproducible(t, t)[0]
    a = tuning.TunedCache(source=1, toolchain="x")
    assert tuning.TunedCache.parse(a.serialize()) == a
    assert a.check(tuning.TunedCache(source=2)) is tuning.Mismatch.SOURCE
    assert a.check(tuning.TunedCache(toolchain="y")) is tuning.Mismatch.TOOLCHAIN
    assert a.check(tuning.TunedCache(index=IndexOptions(planned=2))) is tuning.Mismatch.OPTIONS
    assert tuning.TunedCache(features=4).check(a, 3) is tuning.Mismatch.HARDWARE
    r = tuning.Rollout(tuning.RolloutState.ACTIVE, {"x"})
    for i in range(20):
        r.record(i < 2)
    assert r.guard() and r.state is tuning.RolloutState.ROLLED_BACK and not r.features and not r.guard()
    assert tuning.Environment("darwin", "arm64").problem() and not tuning.Environment("linux", "x86_64", 8).problem()
    b = tuning.BenchReport("r", "p", 1, 2, "linux", "py", "x86_64", 8, {"q": 1.5})
    assert not b.problem() and tuning.BenchReport.from_json(b.to_json()) == b and "| q | 1.5 |" in b.to_markdown()
    assert tuning.BenchReport().problem() == "missing report_id"
    assert set(tuning.PROFILES) == {"balanced-standard", "interactive-low-latency", "embedded-low-memory", "batch-high-throughput"}
    assert all(abs(sum(p.weights.values()) - 1) < 0.11 for p in tuning.PROFILES.values())


def test_generators(spark):
    for c in generate.Category:
        for s in generate.Sizes:
            spec = generate.CorpusSpec(c, s, 4, 64, 256)
            assert generate.documents(spec) == generate.documents(spec)
    assert generate.corpus(spark, generate.CorpusSpec(generate.Category.LOGS, files=3)).count() == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("  \tlong line here",), ("short",)], "t string")
    rows = df.select(output.trimmed(F.col("t")), output.limited_width(F.col("t"), 8), output.limited_width(F.col("t"), 8, True)).collect()
    assert tuple(rows[0]) == ("long line here", output.OMITTED, "  \tlong  [... omitted end of long line]")
    assert tuple(rows[1]) == ("short", "short", "short")


def test_regions_find_the_same(spark):
    from textloom.operators import regions, search
    from textloom.plans.pattern import compile_pattern

    texts = ["xx und é the " + "y" * 3000 + "ü und the" + "é" * 500 + "the und" + "é" * 30 + "the", "", "und the", "theund" * 40, "und" * 50 + "the"]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, text string")
    for source in ("und.{0,40}the", "(a|é)?the{1,2}u", "the", r"\bund\b.{1,3}(the|é)", "[a-z]+the", "und(?=.the)"):
        p = compile_pattern(source, PatternOptions(multiline=True, dotall=True, engine=Engine.AUTO))
        same = sorted((r.file_id, r.start, r.end) for r in search.find(c, [p]).collect())
        assert sorted(map(tuple, regions.find(c, p).collect())) == same, source
    p = compile_pattern("und.{0,40}the", PatternOptions(multiline=True, dotall=True))
    seen = regions.coverage(c, p).first()
    assert seen.files == len(texts) and seen.region_bytes < seen.bytes / 2


def test_lines_of_multiline_spans(spark):
    """Lines that a span touches, and where it begins, with several patterns and empty matches."""
    from textloom.operators import search
    from textloom.operators.search import Request

    c = spark.createDataFrame([(1, "ab\ncd\n\nef"), (2, ""), (3, "b\nc")], "file_id long, text string")
    rows = lambda *s: sorted((r.file_id, r.line_no) for r in search.selected_lines(c, Request.of(*s, multiline=True)).collect())
    assert rows(r"b\nc") == [(1, 1), (1, 2), (3, 1), (3, 2)]
    assert rows(r"b\nc", r"\n\ne") == [(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (3, 2)]
    n = {r.file_id: r.n for r in search.count_matches(c, Request.of(r"b\nc", r"d", r"\n", multiline=True)).collect()}
    assert n == {1: 5, 3: 2}


def test_cancelled_searches(spark):
    from textloom.api import Index, Searcher, SearchOptions, compile_pattern

    s = Searcher(Index.from_documents(spark, [(f"{i}", "a b a") for i in range(50)]))
    p = compile_pattern("a")
    assert len(s.collected(p)) == len(s.collected(p, SearchOptions(should_cancel=lambda: False))) == 100
    assert s.collected(p, SearchOptions(should_cancel=lambda: True)) == []
    asked = iter(range(10**6))
    assert s.collected(p, SearchOptions(should_cancel=lambda: next(asked) > 5)) == []
    assert s.find(p, SearchOptions(scope=(1, 3))).count() == 4


def test_other_sources(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "a.txt.lz4").write_bytes(pa.compress(b"packed", "lz4", asbytes=True))
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.md").write_text("deep")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = {r.path: r.text for r in store.scan(spark, root, archives=True, pre=lambda _, b: b + b"!", pre_globs=("*.md",)).collect()}
        assert got == {"a.txt.lz4": "packed", "b.txt": "plain", "sub/c.md": "deep!"}
    assert [p for p, _, _ in store.list_files(str(tmp_path), one_device=True)] == ["a.txt.lz4", "b.txt", "sub/c.md"]
    timed = store.with_times(store.scan(spark, str(tmp_path)).select("path", "size"), str(tmp_path))
    assert all(r.atime_ns > 0 and r.ctime_ns > 0 for r in timed.collect())


def test_sampled_profile_reads_little(spark, tmp_path):
    """No task gets more than a bounded number of samples, however many files; the sample is that of one ordered pass."""
    import math
    import random
    from collections import Counter

    texts = {i - 300: random.Random(i).choice(["", "é" * (i % 50), f"{i} abc " * (i % 400), "x" * i]) for i in range(900)}
    rows = list(texts.items())
    random.Random(1).shuffle(rows)
    for each, total, parts, most in ((700, 5000, 7, 50_000), (700, 5000, 7, 20), (8, 10**6, 3, 50_000), (1, 100, 40, 50_000), (64, 1, 2, 50_000)):
        c = spark.createDataFrame(rows, "file_id long, text string").repartition(parts)
        data = b"".join(t.encode()[:each] for _, t in sorted(rows))[:total]
        n, grams, left = Counter(data), set(), total
        for _, t in sorted(rows):
            b = t.encode()[: min(each, left)]
            left -= len(b)
            grams |= {b[i : i + 4] for i in range(len(b) - 3)}
        bits = -sum(k / len(data) * math.log2(k / len(data)) for k in n.values())
        got = analytics.sampled_profile(c, each, total, most).first()
        assert (got.sampled_bytes, round(got.bits, 9) + 0.0, got.unique_grams) == (len(data), round(bits, 9) + 0.0, min(len(grams), most))
    assert tuple(analytics.sampled_profile(c.limit(0)).first()) == (0, 0.0, 0)
    assert tuple(analytics.sampled_profile(c.filter("text = ''")).first()) == (0, 0.0, 0)
    # what goes on from each part is a sample, not the head of every file
    many = spark.range(20_000).select(F.col("id").alias("file_id"), F.repeat(F.lit("abcdefgh"), 1000).alias("text")).repartition(4)
    first = many.select("file_id", F.col("text").cast("binary").alias("b")).mapInArrow(analytics._first_bytes(analytics.SAMPLED_BYTES), analytics._HEADS)
    assert first.count() <= 4 * (analytics.SAMPLED_BYTES // 8000 + 1)
