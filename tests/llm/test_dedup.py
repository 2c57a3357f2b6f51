import numpy as np
import pytest

from textloom.llm import decontaminate, line_dedup, repeats, simhash
from textloom.llm.common import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


LINES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def lines(spark, docs, path):
    s = line_dedup.LineDedupStore(spark, str(path))
    s.insert(docs)
    return s.apply(docs, digest=True)


def test_lines_of_the_small_table(spark, small):
    assert rows(line_dedup.op1_line_dedup(spark, SF), *LINES) == sorted(brute.line_dedup(small), key=repr)


def test_lines_of_odd_rows(spark, odd, none, odd_pairs, tmp_path):
    assert rows(lines(spark, odd, tmp_path / "a"), *LINES) == sorted(brute.line_dedup(odd_pairs), key=repr)
    assert lines(spark, none, tmp_path / "b").count() == 0
    out = line_dedup.dedup_lines(odd, str(tmp_path / "c"))
    assert out.columns == odd.columns and out.count() == odd.count()


def test_lines_can_be_taken_back(spark, tmp_path):
    schema = "doc_id long, text string"
    a = spark.createDataFrame([(1, "a line that repeats\nmine alone here"), (2, "A LINE THAT REPEATS\nother text here")], schema)
    b = spark.createDataFrame([(0, "a line that repeats\nanother new one"), (3, "other text here")], schema)
    s = line_dedup.LineDedupStore(spark, str(tmp_path / "s"))
    s.insert(a)
    before = rows(s.apply(a), "doc_id", "text")
    s.insert(b)
    both = a.unionByName(b)
    assert rows(s.apply(both, True), *LINES) == sorted(brute.line_dedup([tuple(r) for r in both.collect()]), key=repr)
    s = line_dedup.LineDedupStore.open(spark, str(tmp_path / "s"))
    s.delete(b)
    assert rows(s.apply(a), "doc_id", "text") == before
    live = {r.shard: line_dedup.CuckooFilter.load(bytes(r.bits)) for r in s.filters().collect()}
    for k in s.counts().collect():
        assert live[k.k1 % s.meta["shards"]].contains(np.array([k.k2])).all()
    assert sum(int((f.slots > 0).sum()) for f in live.values()) == s.counts().count() == s.meta["keys"]


def test_filters_decide(spark, tmp_path, monkeypatch):
    """A filter that denies what it has breaks the result: nobody else looks for repetitions."""
    docs = spark.createDataFrame([(i, f"a line that repeats\nmine alone here {i}") for i in range(6)], "doc_id long, text string")
    a, b = docs.filter("doc_id < 3"), docs.filter("doc_id >= 3")

    def dropped(name, meddle=lambda s: None):
        s = line_dedup.LineDedupStore(spark, str(tmp_path / name))
        s.insert(a.filter("doc_id = 0"))
        meddle(s)
        s.insert(b.filter("doc_id = 3"))
        return sum(r.n_dropped for r in s.apply(docs, True).collect())

    assert dropped("with") == 1
    assert dropped("without", lambda s: s.meta.update(filters=None)) == 0


def test_filters_grow(spark, tmp_path):
    s = line_dedup.LineDedupStore(spark, str(tmp_path / "s"), most_buckets=256)
    docs = spark.range(12).selectExpr("id AS doc_id", "concat_ws('\n', transform(sequence(0, 2999), i -> concat('line number ', i + id * 1500))) AS text")
    for k in range(3):
        s.insert(docs.filter(f"doc_id % 3 = {k}"))
    assert s.meta["buckets"] == 256 and s.meta["shards"] >= 32
    assert rows(s.apply(docs, True), *LINES) == sorted(brute.line_dedup([tuple(r) for r in docs.collect()]), key=repr)
    held = sum(int((line_dedup.CuckooFilter.load(bytes(r.bits)).slots > 0).sum()) for r in s.filters().collect())
    assert held == s.counts().count() == s.meta["keys"]
    s.delete(docs.filter("doc_id % 3 = 1"))
    left = docs.filter("doc_id % 3 <> 1")
    assert rows(s.apply(left, True), *LINES) == sorted(brute.line_dedup([tuple(r) for r in left.collect()]), key=repr)


def test_cuckoo_filter():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-(2**62), 2**62, 50_000))
    f = line_dedup.CuckooFilter(1 << 15)
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(r.integers(-(2**62), 2**62, 50_000)).mean() < 0.001
    f.delete(keys[:25_000])
    assert f.contains(keys[25_000:]).all() and f.contains(keys[:25_000]).mean() < 0.001


SIM = ("doc_id", "fingerprint", "component_id")


def prints(df):
    from pyspark.sql import functions as F

    return simhash.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def test_simhash(spark, small, odd, none, odd_pairs):
    assert rows(simhash.op9_simhash(spark, SF), *SIM) == sorted(brute.simhash(small), key=repr)
    assert rows(prints(odd), *SIM) == sorted(brute.simhash(odd_pairs), key=repr)
    assert prints(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in brute.simhash(odd_pairs)})


def test_close_pairs(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(1 << 63 | 4), base ^ np.uint64(7)]))
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fp.tolist()) for b in fp[:i].tolist() if (a ^ b).bit_count() <= 2}
    seen = [0, 0]
    assert {tuple(sorted(p)) for q in simhash.close_pairs(fp, tile=64, seen=seen) for p in q.tolist()} == want
    assert seen[0] and seen[1] > seen[0]  # counts differ by more than the radius for most tiles

    def parts(edges):
        root = {x: x for x in fp.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        groups = {}
        for x in root:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    u = lambda p: [tuple(int(np.int64(x).view(np.uint64)) for x in e) for e in p]
    assert parts(u(simhash.joined(fp))) == parts(u(simhash.joined(fp, limit=50))) == parts(want)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = u(simhash.links(nodes).collect())
    assert parts(found) == parts(want) and set(map(tuple, map(sorted, found))) <= want | {(min(a, b), max(a, b)) for g in parts(want) for a in g for b in g}
    with pytest.raises(ValueError):
        simhash.links(nodes, 3)


def test_components_of_a_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(e).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


REP = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeat_digest(df, **k):
    return repeats._with_ranges(df.select("doc_id", "text"), repeats.repeated_starts(df.select("doc_id", "text"), **k)).select("doc_id", "text", "a", "b").mapInArrow(repeats._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def test_repeats(spark, small, odd, none, odd_pairs):
    assert rows(repeats.op8_repeated_bytes(spark, SF), *REP) == sorted(brute.repeats(small), key=repr)
    want = sorted(brute.repeats(odd_pairs), key=repr)
    assert rows(repeat_digest(odd), *REP) == want
    assert rows(repeat_digest(odd, hot=3), *REP) == want
    assert repeat_digest(none).count() == 0
    assert {(r.doc_id, sum(s.b - s.a for s in r.spans)) for r in repeats.removed_spans(odd).collect()} == {(x[0], x[2]) for x in want}


def test_repeats_of_the_next_table(spark):
    """Against all 400-byte strings of sf0.01, with groups of more than two members spread, too."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = sorted(brute.repeats([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=repr)
    assert rows(repeat_digest(docs), *REP) == want
    assert rows(repeat_digest(docs, hot=2), *REP) == want


def test_equal_hashes_are_not_enough():
    """Windows are compared by their bytes where hashes agree."""
    r = np.random.default_rng(4)
    sides = r.integers(0, 256, (6, 2 * repeats.SIDE), dtype=np.uint8)
    sides[1], sides[4] = sides[0], sides[3]
    lo, hi = np.zeros(6, np.int32), np.full(6, repeats.SIDE, np.int32)
    group = np.ones(6, np.int64)
    right = repeats._repeated(group, sides, lo, hi)
    assert right[[0, 1, 3, 4]].all() and not right[[2, 5]].any()
    real = repeats._window_hashes
    try:
        repeats._window_hashes = lambda s: real(s) * np.uint64(0)  # all alike
        assert np.array_equal(repeats._repeated(group, sides, lo, hi), right)
    finally:
        repeats._window_hashes = real


def test_repeats_in_long_texts(spark):
    import random

    r = random.Random(3)
    t = "".join(r.choice("abcdef \n") for _ in range(3 * repeats.BLOCK))
    docs = [(1, t), (2, t[1000 : repeats.BLOCK + 777] + "q" + t[-50_000:]), (3, t[5:404]), (4, t[repeats.BLOCK - 200 : repeats.BLOCK + 200])]
    assert rows(repeat_digest(spark.createDataFrame(docs, "doc_id long, text string")), *REP) == sorted(brute.repeats(docs), key=repr)


DEC = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, small, odd, none, odd_pairs, monkeypatch):
    from pyspark.sql import functions as F

    def digest(docs, items, **k):
        n = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
        return decontaminate.hit_ranges(docs, items, **k).select("doc_id", "n_words", n.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))

    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert rows(decontaminate.op10_decontaminate(spark, SF), *DEC) == sorted(brute.decontaminate(small, items), key=repr)
    more = [(1, odd_pairs[17][1]), (1, "other words"), (2, "one two"), (3, "ONE"), (4, None), (5, ""), (6, odd_pairs[12][1][:4000]), (None, "a b c"), (7, odd_pairs[17][1])]
    bench = spark.createDataFrame(more, "item_id long, text string")
    want = sorted(brute.decontaminate(odd_pairs, more), key=repr)
    assert rows(digest(odd, bench), *DEC) == want
    assert rows(digest(odd, bench, most=40), *DEC) == want
    assert digest(none, bench).count() == 0
    assert all(not r.contaminated for r in digest(odd, bench.limit(0)).collect())
    out = decontaminate.decontaminate(odd, bench)
    assert out.columns == odd.columns
    left = digest(out, bench).filter("contaminated").select("doc_id").collect()
    assert {r.doc_id for r in left} <= {x[0] for x in want}


def test_short_items_in_long_ones():
    """Streams read words before their anchor again: what they find there neither cuts earlier ranges nor joins them."""
    import random

    def same(docs, items):
        a = decontaminate.ItemAutomaton([(i, decontaminate.words(t.encode())) for i, t in items])
        got = []
        for d, t in docs:
            spans, found = a.scan(decontaminate.words(t.encode()))
            assert all(x < y for x, y in spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
            got.append((d, sum(y - x for x, y in spans), len({a.items[k][0] for k in found})))
        assert got == [(x[0], x[2], x[3]) for x in brute.decontaminate(docs, items)]

    long, short, other = "a1 a2 a3 a4 a5 a6 a7 s1 s2 s3 a11 a12", "s1 s2 s3", "t1 t2 t3"
    docs = [(1, f"{long} zz {short}"), (2, f"{short} x y {other} z {short}"), (3, f"{other} x {long} y {other} z {short} {long}")]
    same(docs, [(1, long), (2, short)])
    same(docs, [(1, long), (2, short), (3, other)])
    for seed in range(300):
        r = random.Random(seed)
        prose = lambda n: " ".join(r.choice("abcdef") + r.choice("12") for _ in range(n))
        items = [(i, prose(r.randint(8, 25))) for i in range(3)]
        items += [(9 + i, " ".join(r.choice(items)[1].split()[k : k + r.randint(1 + seed % 3, 9)])) for i, k in enumerate(r.choices(range(6), k=3))]
        parts = [lambda: r.choice(items)[1], lambda: prose(r.randint(1, 8)), lambda: "zz " * r.randint(1, 9)]
        same([(i, " ".join(r.choice(parts)() for _ in range(12))) for i in range(4)], items)
