"""Whole jobs of registered queries, on tables that hold what the driver's don't."""

import base64
from collections import Counter

import pytest

from textloom import queries

TEXTS = [
    "a foo bar b", "xpassword=1\nfoo  bar", "call 555-1234 now", "one two three four five", "né Straße 日本語", "", None, "x" * 9000 + "é" * 3000,
    "The Two three four fives", "no", "licens" * 50, "ab 12 ♥♥♥♥ 34", "z" * 300, "étape", "one two three four five",
]
ITEMS = [
    (1, "foo bar"), (2, "password"), (3, "555-1234"), (4, "one two three four"), (5, "♥♥♥♥"), (4, "call"), (6, "no"), (7, "12"), (None, "two three"), (None, "wo three fou"), (8, None), (9, "foo bar"), (9, "foo bar"), (10, "absent words are not here"),
]


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def oracle(d, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return c.execute(queries.SQL[name]).fetchall()


def same_rows(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want), key=repr)


@pytest.mark.parametrize("limit", [4 << 20, 40])
def test_pattern_file_short_needles(spark, tables, monkeypatch, limit):
    """Needles of one or two words, digits and symbols have no rare word; short ones count as well."""
    monkeypatch.setattr(queries, "NEEDLE_BYTES", limit)
    needles = {x for x in ITEMS if x[1] is not None}
    want = {i: n for i, t in enumerate(TEXTS) if t is not None and (n := sum(x in t for _, x in needles))}
    assert {r.file_id: r.n for r in queries.pattern_file(spark, tables).collect()} == want


def test_base64_of_long_texts(spark, tables):
    want = [(i, base64.b64encode(b"\xff" + (t or "").encode()).decode(), None) if i % 2 == 0 else (i, None, t or "") for i, t in enumerate(TEXTS)]
    same_rows(queries.base64_payload(spark, tables), want)
    assert sorted(oracle(tables, "base64_payload")) == want


@pytest.mark.parametrize("held", [2_000_000, 30])
def test_qgrams_of_documents(spark, tables, monkeypatch, held):
    """Whole texts, not only ASCII, over several chunks."""
    from textloom.operators import index as ix

    monkeypatch.setattr(ix, "HELD_GRAMS", held)
    n, chunks, docs = Counter(), Counter(), Counter()
    for b in ((t or "").encode() for t in TEXTS):
        grams = [b[i : i + 4].hex().upper() for i in range(len(b) - 3)]
        n.update(grams)
        docs.update(set(grams))
        for at in range(0, len(b), 4096):
            chunks.update(set(grams[at : at + 4096 + 128 - 3]))
    want = [(g, n[g], chunks[g], docs[g]) for g in n]
    assert chunks != docs and any(g.startswith("C3A9") for g in n)
    same_rows(queries.qgram_stats(spark, tables), want)
    if held > 30:
        for name in ("rarity_plan", "qgram_entropy"):
            same_rows(queries.QUERIES[name](spark, tables), oracle(tables, name))
        assert sorted(oracle(tables, "qgram_stats")) == sorted(want)


def test_all_files_are_sorted(spark, tmp_path):
    docs = [(i, "a license" if i % 3 else "none", "en", f"src{i * 7 % 5}", 9) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.sort_by_path_desc(spark, str(tmp_path))
    paths = [r.path for r in out.collect()]
    assert len(paths) == 60 and paths == sorted(paths, reverse=True)
    assert "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString()


def test_long_literals_across_blocks(spark):
    """A literal that no block sees whole has no candidates to tell; the longest that one sees has."""
    from textloom.operators import index as ix

    o = ix.IndexOptions(chunk_bytes=4096)
    for n in (65, 66, 100):
        literal = "".join(chr(97 + i * 7 % 26) + chr(65 + i % 25) for i in range(50))[:n]
        corpus = spark.createDataFrame([(1, "." * 255 + literal + "." * 500)], "file_id long, text string")
        some = ix.candidates(ix.block_postings(corpus, o), literal, o)
        assert some is None if n > 65 else [r.file_id for r in some.collect()] == [1]


#: Letters whose capital is one character in SQL and two or three in Spark, or none at all; some beyond the first plane.
CASED = ["Erteß und so weiter", "ŉ ǰ ΐ ﬁ ﬄ ᾳ ᾼ", "ᾀ ᾗ ῳ ᾲ ῷ", "𐵰𐐨 😀 ßé", "ƛɤ ijŋ", "", "a"]


@pytest.fixture
def cased(spark, tmp_path):
    """Texts at the documents that change, and others between them."""
    docs = [(i, CASED[i // 11 % len(CASED)] if i % 11 == 1 else f"kept ß {i}", "de", f"src{i % 3}", 9) for i in range(11 * len(CASED))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_upper_keeps_characters(spark):
    """Every character of the planes that have letters, among others, as SQL has it."""
    from pyspark.sql import functions as F

    from textloom.functions.cases import upper_each

    duckdb = pytest.importorskip("duckdb")
    df = spark.range(1, 0x20000).filter("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32").alias("t"))
    got = {r.id: r.u for r in df.select("id", upper_each(F.concat(F.lit("ß"), "t", F.lit("😀a"))).alias("u")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE c AS SELECT i, 'ß' || chr(CAST(i AS INTEGER)) || '😀a' AS t FROM range(1, 131072) r(i) WHERE i NOT BETWEEN 55296 AND 57343")
    want = dict(con.execute("SELECT i, upper(t) FROM c").fetchall())
    assert len(got) == len(want) == 0x20000 - 2049
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert spark.createDataFrame([(None,), ("",)], "t string").select(upper_each(F.col("t"))).collect() == [(None,), ("",)]


def test_tombstones_with_capitals_of_one_character(spark, cased):
    same_rows(queries.append_tombstone(spark, cased), oracle(cased, "append_tombstone"))


def test_segments_with_capitals_of_one_character(spark, cased):
    same_rows(queries.snapshot_segments(spark, cased), oracle(cased, "snapshot_segments"))


@pytest.mark.parametrize("o", [{"chunk_bytes": 64, "overlap": 4, "block_bytes": 16}, {"chunk_bytes": 64, "overlap": 63, "block_bytes": 64}, {"chunk_bytes": 100, "overlap": 30, "block_bytes": 33}, {}])
def test_postings_of_few_strings(spark, o):
    """Only the strings that are asked for, and of these the same rows as of all: at every place in chunks and blocks."""
    from textloom.operators import index as ix

    o = ix.IndexOptions(**o)
    texts = ["." * i + "license" + "." * (i * 7 % 90) + "lice" for i in range(150)] + ["e" * 300, "", "lic", "licenselicense", "né" * 60 + "ééé"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    only = [*ix.query_grams("license"), b"eeee", "éé".encode(), b"zzzz"]
    for table in (ix.postings, ix.block_postings):
        want = [tuple(r) for r in table(corpus, o).collect() if bytes(r.gram) in only]
        same_rows(table(corpus, o, only), want)
        assert len(want) > 600


def test_search_stats_list_few_strings(spark, tables, monkeypatch):
    """The query's figures, and every other string left out before it is a row; patterns of several and of no literals."""
    from textloom.operators import index as ix
    from textloom.plans.pattern import compile_pattern

    whole = ix.search_stats
    docs = queries.documents(spark, tables)
    for source in ("(foo b|three)", "one two|licens", "[0-9]+", "absent words"):
        p = compile_pattern(source)
        got = whole(docs, ix.postings(docs, queries._IX), ix.block_postings(docs, queries._IX), p, queries._IX).first()
        hits = sorted({r.file_id for r in ix.indexed_find(docs, ix.postings(docs, queries._IX), p, queries._IX).collect()})
        assert got.candidate_files >= len(hits) and got.matches == ix.indexed_find(docs, ix.postings(docs, queries._IX), p, queries._IX).count()
        sizes = {i: len((t or "").encode()) for i, t in enumerate(TEXTS)}
        if source == "[0-9]+":
            assert (got.candidate_files, got.verified_bytes, got.probe_rows) == (len(TEXTS), sum(sizes.values()), 0)
        else:
            assert (got.candidate_files, got.verified_bytes) == (len(hits), sum(sizes[i] for i in hits))
            grams = {g for x in source.strip("()").split("|") for g in ix.query_grams(x)}
            assert got.probe_rows == sum(bytes(r.gram) in grams for r in ix.postings(docs, queries._IX).collect())
    seen = []
    monkeypatch.setattr(ix, "search_stats", lambda c, found, blocks, *a: seen.extend((found, blocks)) or whole(c, found, blocks, *a))
    same_rows(queries.search_stats(spark, tables), oracle(tables, "search_stats"))
    for table in seen:
        assert {bytes(r.gram) for r in table.collect()} == {*ix.query_grams("license")} - {b"ense"}


def test_bucket_stats_shuffle_counts(spark, tables):
    """Chunks of a bucket, counted where they are: what is shuffled is at most a row a bucket and task, not every posting."""
    from textloom.operators import index as ix

    same_rows(queries.bucket_stats(spark, tables), oracle(tables, "bucket_stats"))
    for o in (ix.IndexOptions(chunk_bytes=64, overlap=4, block_bytes=16), ix.IndexOptions(chunk_bytes=64, overlap=63, block_bytes=64), ix.IndexOptions()):
        docs = queries.documents(spark, tables)
        rows = {((int.from_bytes(r.gram) * 40503 >> 16) % ix.BUCKETS, r.file_id, r.chunk_no) for r in ix.postings(docs, o).collect()}
        df = ix.bucket_stats(docs, o)
        same_rows(df, Counter(b for b, _, _ in rows).items())
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "file_id" not in plan.split("MapInArrow")[0] and "chunk_no" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("name", ["block_candidates", "qgram_candidates"])
def test_candidates_list_few_strings(spark, tmp_path, monkeypatch, name):
    """Literals at all places of blocks and chunks; no other string is listed on the way to them."""
    from textloom.operators import index as ix

    texts = ["." * i + "license" + "." * (i % 9) + "licence password=" for i in [*range(180, 330, 3), *range(4000, 4300, 7), 8180, 8192]] + ["é" * 2047 + "license", "lice icen cens ense", "", None, "licens"]
    docs = [(i, t, "en", "src0", 9) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, candidates = [], ix.candidates
    monkeypatch.setattr(ix, "candidates", lambda found, *a, **k: seen.append(found) or candidates(found, *a, **k))
    want = oracle(str(tmp_path), name)
    assert len(want) > len(texts)
    same_rows(queries.QUERIES[name](spark, str(tmp_path)), want)
    assert all({bytes(r.gram) for r in x.collect()} <= {*ix.query_grams("license")} for x in seen) and seen
