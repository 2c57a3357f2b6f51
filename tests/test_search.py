import re

import pytest
from pyspark.sql import functions as F

from textloom.api import Index, Searcher, SearchOptions
from textloom.operators import index as ix
from textloom.operators import output, search
from textloom.operators.search import Request
from textloom.plans.pattern import Case, Engine, PatternError, PatternOptions, branches, compile_pattern, needs


@pytest.fixture
def corpus(spark):
    def make(*texts):
        return spark.createDataFrame([(i, f"f{i}.txt", t) for i, t in enumerate(texts)], "file_id long, path string, text string")

    return make


def spans(c, source, overlapping=False, **o):
    return [tuple(r)[:3] for r in search.find(c, [compile_pattern(source, PatternOptions(**o))], overlapping).orderBy("file_id", "start", "end").collect()]


def picked(c, *sources, **k):
    return [(r.line_no, r.line) for r in search.selected_lines(c, Request.of(*sources, **k)).orderBy("file_id", "line_no").collect()]


AUTO = {"engine": Engine.AUTO}


@pytest.mark.parametrize(
    ("text", "source", "options", "want"),
    [
        ("alpha beta\nbeta gamma\n", "b.ta", {}, [(6, 10), (11, 15)]),
        ("abc123def abc456def", "abc(([0-9]+))def", {}, [(0, 9), (10, 19)]),
        ("<tag>content</tag>", r"<([a-zA-Z0-9]+)>(.*?)</\1>", AUTO, [(0, 18)]),
        ("cat mat bat rat car bar\n", "(?<=c|b)ar", AUTO, [(17, 19), (21, 23)]),
        ("cat mat bat rat car bar\n", "(?<!c)ar", AUTO, [(21, 23)]),
        ("cat mat bat rat car bar\n", "(?!b|r)[a-z](?=at)", AUTO, [(0, 1), (4, 5)]),
        ("foo\r\nbar foo\r\nfoo\r\n", "^foo$", {"multiline": True, "crlf": True}, [(0, 3), (14, 17)]),
        ("foo\r\nbar foo\r\nfoo\r\n", r"\bfoo\b", {"multiline": True, "crlf": True}, [(0, 3), (9, 12), (14, 17)]),
        ("xxx\nabc\ndefxxxabc\ndefxxx\nxxx\n", "abc\ndef", {"multiline": True}, [(4, 11), (14, 21)]),
        ("xxx\nabc\ndefxxxabc\ndefxxx\n", "abc.+def", {}, []),
        ("Hello 1234 世界 🌍 12.34 русский язык 999\n", r"\p{gc=Nd}+", {}, [(6, 10), (23, 25), (26, 28), (53, 56)]),
        ("Hello 世界 русский", r"\p{Script=Han}+", {}, [(6, 12)]),
        ("Hello русский", r"\p{Cyrillic}+", {}, [(6, 20)]),
        ("éab ab ab_", "ab", {"word": True}, [(5, 7)]),
        ("ab\nabc\nab", "ab", {"line": True}, [(0, 2), (7, 9)]),
        ("AB aB ab", "((?i)a)b", {}, [(0, 2), (3, 5), (6, 8)]),
        ("AB Ab ab", "(?i:a)b", {}, [(3, 5), (6, 8)]),
        ("a++ aa+", "a++", {}, [(0, 2), (4, 7)]),
        ("ab\n\nb", "b*", {}, [(0, 0), (1, 2), (2, 2), (3, 3), (4, 5), (5, 5)]),
        ("STRASSE straße", "straße", {"case": Case.INSENSITIVE}, [(8, 15)]),
        ("ÉCOLE école", "école", {"fixed": True, "case": Case.INSENSITIVE}, [(0, 6), (7, 13)]),
        ("a.c abc", "a.c", {"fixed": True}, [(0, 3)]),
        ("x\ry", "x.y", {}, [(0, 3)]),
        ("aé1٣", r"\d", {}, [(3, 4), (4, 6)]),
        ("aé1٣", r"\d", {"unicode": False}, [(3, 4)]),
        ("tab\there", r"\x09h", {}, [(3, 5)]),
        ("aXbX", "(?U)a.*X", {}, [(0, 2)]),
        ("one two", "(?x) o n e # first\n", {}, [(0, 3)]),
    ],
)
def test_goldens(corpus, text, source, options, want):
    assert [(a, b) for _, a, b in spans(corpus(text), source, **options)] == want


def test_overlapping(corpus):
    assert spans(corpus("ababa", "aaaa"), "aba", True, fixed=True) == [(0, 0, 3), (0, 2, 5)]
    assert spans(corpus("aaa"), "a+", True) == [(0, 0, 3), (0, 1, 3), (0, 2, 3)]
    assert spans(corpus("abab"), r"(a)b\1", True, engine=Engine.AUTO) == [(0, 0, 3)]


def test_errors():
    for bad in ("(", ")", "[a", "a{,3}", r"\q", "(?<n", r"(a)\1", "a{2,1}", "x{99999}", r"\p{Nope}"):
        with pytest.raises(PatternError):
            compile_pattern(bad)
    compile_pattern(r"(a)\1", PatternOptions(engine=Engine.EXTENDED))


def test_smart_case():
    assert compile_pattern("apple", PatternOptions(case=Case.SMART)).options.case is Case.INSENSITIVE
    assert compile_pattern("Apple", PatternOptions(case=Case.SMART)).options.case is Case.SENSITIVE
    assert compile_pattern(r"\Wapple", PatternOptions(case=Case.SMART)).options.case is Case.SENSITIVE


@pytest.mark.parametrize(
    ("source", "texts"),
    [("(foo|bar)qux", ["fooqux", "qux foo", "qux"]), ("abc[0-9]+def", ["abc1def", "abcdef", "def abc"]), ("(ab){3}c+", ["abababc", "ab"]), ("a?b", ["b", "c"]), ("x(yz|yzw)", ["xyz", "yz", "xy"])],
)
def test_needs_are_necessary(source, texts):
    p = compile_pattern(source)
    for t in texts:
        assert p.need.holds(t) or not re.search(source, t)


def test_absorption_and_branches():
    assert needs(compile_pattern("(abc|xabcx)").node).text == "abc"
    assert sorted(branches(compile_pattern("foo[0-9]|barbaz").node)) == ["barbaz", "foo"]
    assert branches(compile_pattern("foo|[a-z]").node) == []
    assert compile_pattern("foo").pure == "foo" and compile_pattern("f(oo)").pure is None
    p = compile_pattern("a{2,3}é")
    assert (p.least, p.most) == (4, 5)


def test_random_against_re(corpus):
    import random

    r = random.Random(3)
    atoms = ["a", "b", "é", "[ab]", "[^a]", ".", "(a|b)", "(?:ab)", "c?", "b*", "a+", "(a|éb){1,2}"]
    texts = ["".join(r.choice("abcé \n") for _ in range(40)) for _ in range(12)]
    c = corpus(*texts)
    for _ in range(12):
        source = "".join(r.choice(atoms) for _ in range(r.randint(1, 4)))
        want = []
        for i, t in enumerate(texts):
            at = 0
            rows = t.split("\n")
            for row in rows[:-1] if rows[-1] == "" and len(rows) > 1 else rows:
                want += [(i, at + len(row[: m.start()].encode()), at + len(row[: m.end()].encode())) for m in re.finditer(source, row)]
                at += len(row.encode()) + 1
        assert spans(c, source) == sorted(want), source


def test_lines(corpus):
    rows = search.lines(corpus("", "a\n", "a\n\nb", "\n")).orderBy("file_id", "line_no").collect()
    assert [(r.file_id, r.line_no, r.begin, r.end, r.term_end, r.line) for r in rows] == [(0, 1, 0, 0, 0, ""), (1, 1, 0, 1, 2, "a"), (2, 1, 0, 1, 2, "a"), (2, 2, 2, 2, 3, ""), (2, 3, 3, 4, 4, "b"), (3, 1, 0, 0, 1, "")]
    many = "\n".join(str(i) for i in range(1000))
    got = search.lines(corpus(many)).collect()
    assert all(many[r.begin : r.end] == r.line for r in got) and len(got) == 1000


def test_counts_and_limits(corpus):
    c = corpus("x x\nx\nnone\n", "no\n")
    r = Request.of("x")
    assert [tuple(x) for x in search.count_lines(c, r).collect()] == [(0, 2)]
    assert [tuple(x) for x in search.count_matches(c, r).collect()] == [(0, 3)]
    assert [tuple(x) for x in search.count_lines(c, r, True).orderBy("file_id").collect()] == [(0, 2), (1, 0)]
    assert picked(c, "x", max_count=1) == [(1, "x x")]
    assert picked(corpus("foo\nbar\nbaz\nqux"), "foo", "bar", invert=True) == [(3, "baz"), (4, "qux")]
    assert picked(corpus("a\nx\nx\nb\nx"), "x", stop_on_nonmatch=True) == [(2, "x"), (3, "x")]
    assert tuple(search.stats(c, r).first()) == (3, 2, 1, 2, 14)
    assert [x.file_id for x in search.files_with(c, Request.of("x"), without=True).collect()] == [1]
    assert [x.file_id for x in search.files_with(c, Request.of("[x]")).collect()] == [0]


def test_contexts(corpus):
    c = corpus("1\n2 hit\n3\n4\n5\n6 hit\n7")
    rows = search.context_lines(c, Request.of("hit", before=1, after=1)).orderBy("line_no").collect()
    assert [(r.line_no, r.matched, r.gap) for r in rows] == [(1, False, False), (2, True, False), (3, False, False), (5, False, True), (6, True, False), (7, False, False)]
    shown = output.standard(c, Request.of("hit", after=1)).orderBy("line_no").collect()
    assert [r.shown for r in shown] == ["2:2 hit", "3-3", "--\n6:6 hit", "7-7"]


def test_multiline_lines_and_replacement(corpus):
    assert picked(corpus("xxx\nabc\ndefxxxabc\ndefxxx\nxxx\n"), "abc\ndef", multiline=True) == [(2, "abc"), (3, "defxxxabc"), (4, "defxxx")]
    p = compile_pattern(r"foo(?P<digits>\d+)bar")
    c = corpus("foo123bar")
    for template, want in (("$1", "123"), ("${digits}", "123"), ("$digits!", "123!"), ("$$$0", "$foo123bar"), ("[$nope]", "[]"), ("a\\b", "a\\b"), ("${1}0", "1230")):
        assert c.select(search.replaced(F.col("text"), p, template)).first()[0] == want


def test_captures(corpus):
    c = corpus("é abc123def x\nabc4def")
    got = [tuple(x) for x in search.captures(c, compile_pattern("abc(?P<n>[0-9]+)|(zzz)")).orderBy("start").collect()]
    assert [(s, e, [(g.start, g.end, g.matched, g.name) for g in caps]) for _, s, e, caps in got] == [(3, 9, [(3, 9, True, ""), (6, 9, True, "n"), (0, 0, False, "")]), (15, 19, [(15, 19, True, ""), (18, 19, True, "n"), (0, 0, False, "")])]


def test_json_vimgrep(corpus):
    c = corpus("the cat\nno\ncat the cat")
    ev = output.json_events(c, Request.of("cat")).orderBy("file_id", "part", "line_no").collect()
    assert [e.part for e in ev] == [0, 1, 1, 2] and '"submatches":[{"match":{"text":"cat"},"start":4,"end":7}]' in ev[1].event
    rows = output.vimgrep(c, Request.of("cat")).orderBy("line_no", "column").collect()
    assert [(r.line_no, r.column) for r in rows] == [(1, 5), (3, 1), (3, 9)]


def test_index_agrees_with_scan(spark, corpus):
    o = ix.IndexOptions(chunk_bytes=96, overlap=16, block_bytes=48)
    texts = ["needle " + "hay " * 60 + "RARE_TOKEN_X9", "hay " * 23 + "needle at a border " + "x" * 100, "", "nothing", "Σίσυφος needle"]
    c = corpus(*texts)
    posts, stats = ix.postings(c, o), ix.qgram_stats(c, o)
    for source, k in (("needle", {"fixed": True}), ("RARE_TOKEN", {}), ("abc", {}), ("(needle|RARE)[ _]", {}), ("Σίσυφος", {"fixed": True}), ("hay h", {"fixed": True}), ("NEEDLE", {"case": Case.INSENSITIVE})):
        p = compile_pattern(source, PatternOptions(**k))
        scan = [tuple(r)[:3] for r in search.find(c, [p]).collect()]
        assert sorted(scan) == sorted(tuple(r)[:3] for r in ix.indexed_find(c, posts, p, o, stats=stats).collect()), source
    assert ix.candidates(posts, "abc", o) is None
    assert {r.file_id for r in ix.candidates(ix.block_postings(c, o), "RARE_TOKEN_X9", o).collect()} == {0}
    total = stats.agg(F.sum("occurrence_frequency")).first()[0]
    assert total == sum(max(0, len(t.encode()) - 3) for t in texts)


def test_searcher(spark, tmp_path):
    docs = [("b.txt", "delta alpha\n"), ("a.txt", "alpha beta\nbeta gamma\n"), ("c.bin", b"\0alpha")]
    index = Index.from_documents(spark, docs)
    s = Searcher(index)
    p = compile_pattern("alpha", PatternOptions(fixed=True))
    assert [tuple(r) for r in s.find(p).orderBy("file_id").collect()] == [(0, 0, 5), (1, 6, 11)]
    assert [tuple(r) for r in s.find(p, SearchOptions(include_binary=True, max_matches=9)).collect()] == [(0, 0, 5), (1, 6, 11), (2, 1, 6)]
    assert [tuple(r) for r in s.find(p, SearchOptions(first=True)).collect()] == [(0, 0, 5)]
    assert [r.path for r in s.files(compile_pattern("gamma"), SearchOptions(files_without=True, scope=(0, 1))).collect()] == ["b.txt"]
    assert [tuple(r) for r in s.find(p, SearchOptions(invert=True, scope=(0,))).collect()] == [(0, 11, 21)]
    assert [tuple(r) for r in Searcher(Index(index.corpus).with_postings()).find(p).orderBy("file_id").collect()] == [(0, 0, 5), (1, 6, 11)]
    index.save(str(tmp_path / "s"), {"root": "x"})
    assert Searcher(Index.load(spark, str(tmp_path / "s"), {"root": "x"})).find(p).count() == 2
