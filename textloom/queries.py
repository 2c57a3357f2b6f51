"""The library's operators applied to the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import atexit
import bz2
import gzip
import lzma
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.cases import upper_each
from textloom.functions.globs import IgnoreRule
from textloom.operators import analytics, output, regions, search, select
from textloom.operators import index as ix
from textloom.operators.index import IndexOptions
from textloom.operators.search import Request
from textloom.operators.select import Selection
from textloom.plans.pattern import Case, Engine, PatternOptions, compile_pattern
from textloom.plans import tuning
from textloom.plans.tuning import Thresholds
from textloom.sources import corpus as store
from textloom.streaming import watch as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Needles that one automaton takes.
NEEDLE_BYTES = 4 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a corpus."""
    df = store.spread(_read(spark, d, "documents"))
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit("."), "lang")
    return store.from_table(df, "doc_id", path, "text")


_PATH = "source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.' || lang"


def _lines(table: str = "documents", key: str = "doc_id", text: str = "text", sep: str = "chr(10)") -> str:
    return f"""
c AS (SELECT {key} AS file_id, coalesce({text}, '') AS text, string_split(coalesce({text}, ''), {sep}) AS p FROM {table}),
c1 AS (SELECT file_id, text, CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN p[1 : len(p) - 1] ELSE p END AS p FROM c),
l0 AS (SELECT file_id, text, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS line FROM c1),
lines AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no) - strlen(line) - 1 AS BIGINT) AS begin_ FROM l0)"""


L = f"WITH {_lines()}"


def _spans(pattern: str, text: str = "text", source: str = "documents") -> str:
    """Spans of a pattern that never matches nothing."""
    p = pattern.replace("'", "''")
    return f"""
g AS (SELECT doc_id AS file_id, unnest(regexp_extract_all({text}, '{p}')) AS m, unnest(string_split_regex({text}, '{p}')) AS g,
  unnest(range(len(string_split_regex({text}, '{p}')))) AS k FROM {source}),
r AS (SELECT *, CAST(sum(strlen(g) + coalesce(strlen(m), 0)) OVER (PARTITION BY file_id ORDER BY k) AS BIGINT) AS e FROM g),
spans AS (SELECT file_id, e - strlen(m) AS start_, e AS end_, m FROM r WHERE m IS NOT NULL)"""


def _line_spans(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
g AS (SELECT file_id, line_no, begin_, line, unnest(regexp_extract_all(line, '{p}')) AS m, unnest(string_split_regex(line, '{p}')) AS g,
  unnest(range(len(string_split_regex(line, '{p}')))) AS k FROM lines),
r AS (SELECT *, begin_ + CAST(sum(strlen(g) + coalesce(strlen(m), 0)) OVER (PARTITION BY file_id, line_no ORDER BY k) AS BIGINT) AS e FROM g),
spans AS (SELECT file_id, line_no, begin_, line, e - strlen(m) AS start_, e AS end_, m FROM r WHERE m IS NOT NULL)"""


W = r"[^\p{L}\p{Nd}\p{Pc}\p{M}]"


def _find(spark, d, source, overlapping=False, **o):
    return search.find(documents(spark, d), [compile_pattern(source, PatternOptions(**o))], overlapping).select("file_id", "start", "end")


def _sel(spark, d, *sources, **k):
    return search.selected_lines(documents(spark, d), Request.of(*sources, **k)).select("file_id", "line_no", "line")


# -- matching -------------------------------------------------------------------


@query(f"{L} SELECT file_id, line_no, line FROM lines WHERE contains(line, 'the')")
def fixed_find_lines(spark, d):
    return _sel(spark, d, "the", fixed=True)


@query(f"WITH {_spans('the')} SELECT file_id, start_ AS start, end_ AS \"end\" FROM spans")
def fixed_spans(spark, d):
    return _find(spark, d, "the", fixed=True)


@query("SELECT doc_id AS file_id, CAST(sum(length(m) - 1) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'ee+')) AS m FROM documents) GROUP BY 1")
def fixed_overlap_count(spark, d):
    return _find(spark, d, "ee", True, fixed=True).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{L} SELECT file_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)ENTION')")
def fixed_icase(spark, d):
    return _sel(spark, d, "ENTION", fixed=True, case=Case.INSENSITIVE)


@query(f"{L} SELECT file_id, line_no, CAST(regexp_matches(line, '(?i)thea') AS BIGINT) AS lower_, CAST(contains(line, 'Thea') AS BIGINT) AS upper_ FROM lines WHERE regexp_matches(line, '(?i)thea')")
def smart_case(spark, d):
    """A pattern without capitals finds any case; with them only itself."""
    upper = compile_pattern("Thea", PatternOptions(case=Case.SMART))
    out = search.selected_lines(documents(spark, d), Request.of("thea", case=Case.SMART))
    return out.select("file_id", "line_no", F.lit(1).cast("bigint").alias("lower_"), F.col("line").rlike(upper.java).cast("bigint").alias("upper_"))


@query(f"{L} SELECT file_id, line_no, line FROM lines WHERE regexp_matches(line, '(^|{W})und($|{W})')")
def word_fixed(spark, d):
    return _sel(spark, d, "und", fixed=True, word=True)


@query(f"{L} SELECT file_id, line_no FROM lines WHERE line = 'Released under the MIT License.'")
def line_exact(spark, d):
    return _sel(spark, d, "Released under the MIT License.", fixed=True, line=True).drop("line")


@query(f"{L} SELECT file_id, line_no, line FROM lines WHERE regexp_matches(line, '[0-9]{{3}}-[0-9]{{4}}')")
def regex_lines(spark, d):
    return _sel(spark, d, "[0-9]{3}-[0-9]{4}")


_ALT = "the|und|[0-9]{3}-[0-9]{4}"


@query(f"WITH {_lines()}, {_line_spans(_ALT)} SELECT file_id, start_ AS start, end_ AS \"end\" FROM spans")
def regex_spans(spark, d):
    return _find(spark, d, _ALT)


@query(f"{L} SELECT file_id, CAST(sum(len(regexp_extract_all(line, '[a-z]*tion[a-z]*'))) AS BIGINT) AS n FROM lines GROUP BY 1 HAVING n > 0")
def regex_count_matches(spark, d):
    return search.count_matches(documents(spark, d), Request.of("[a-z]*tion[a-z]*"))


@query(f"{L} SELECT file_id, line_no FROM lines WHERE regexp_matches(line, '(license|token|password)')")
def regex_alternation(spark, d):
    return _sel(spark, d, "(license|token|password)").drop("line")


@query(f"WITH {_lines()}, {_line_spans('th[a-e]{2,5}n')} SELECT file_id, start_ AS start, end_ AS \"end\" FROM spans")
def regex_bounded(spark, d):
    return _find(spark, d, "th[a-e]{2,5}n")


@query(rf"WITH {_lines()}, {_line_spans('[[:digit:]]+')} SELECT file_id, start_ AS start, end_ AS end, CAST(strlen(m) AS BIGINT) AS n FROM spans".replace("AS end,", 'AS "end",'))
def regex_unicode_class(spark, d):
    return search.find(documents(spark, d), [compile_pattern(r"\p{gc=Nd}+")]).select("file_id", "start", "end", F.octet_length("hit").cast("bigint").alias("n"))


@query(rf"""WITH {_lines()}, {_line_spans('@[a-z]+[0-9]')} SELECT file_id, start_ AS start, end_ AS "end", start_ + 1 AS name_start, end_ - 1 AS name_end FROM spans""")
def regex_captures(spark, d):
    found = search.captures(documents(spark, d), compile_pattern("@(?P<host>[a-z]+)([0-9])"))
    c = F.get("captures", F.lit(1))
    return found.select("file_id", "start", "end", c["start"].alias("name_start"), c["end"].alias("name_end"))


@query(f"{L} SELECT file_id, line_no, regexp_replace(line, '([0-9]{{3}})-([0-9]{{4}})', '\\2/\\1', 'g') AS line FROM lines WHERE regexp_matches(line, '[0-9]{{3}}-[0-9]{{4}}')")
def regex_replace(spark, d):
    p = compile_pattern("(?P<a>[0-9]{3})-([0-9]{4})")
    out = search.selected_lines(documents(spark, d), Request((p,)))
    return out.select("file_id", "line_no", search.replaced(F.col("line"), p, "$2/${a}").alias("line"))


_PAIR = " OR ".join(f"contains(line, '{c}{c}{c}')" for c in "abcdefghijklmnopqrstuvwxyz")


@query(f"{L} SELECT file_id, line_no FROM lines WHERE {_PAIR}")
def pcre_backref(spark, d):
    return _sel(spark, d, r"([a-z])\1\1", engine=Engine.AUTO).drop("line")


@query(f"{L} SELECT file_id, CAST(sum(len(regexp_extract_all(line, '@mail'))) AS BIGINT) AS n FROM lines GROUP BY 1 HAVING n > 0")
def pcre_lookbehind(spark, d):
    return search.count_matches(documents(spark, d), Request.of("(?<=@)mail", engine=Engine.EXTENDED))


@query(f"{L} SELECT file_id, line_no FROM lines WHERE regexp_matches(line, 'tion[^s]') OR suffix(line, 'tion')")
def pcre_lookahead(spark, d):
    return _sel(spark, d, "tion(?!s)", engine=Engine.EXTENDED).drop("line")


@query(f"WITH {_spans(chr(92) + '.' + chr(92) + 'n[A-Z]th')} SELECT file_id, start_ AS start, end_ AS \"end\" FROM spans")
def multiline_span(spark, d):
    return _find(spark, d, r"\.\n[A-Z]th", multiline=True)


@query("WITH " + _spans("(?s)und.{0,40}the") + ' SELECT file_id, start_ AS start, end_ AS "end" FROM spans')
def multiline_dotall(spark, d):
    return _find(spark, d, "und.{0,40}the", multiline=True, dotall=True)


@query(f"{L} SELECT file_id, line_no FROM lines WHERE regexp_matches(line, 'tion\\.$')")
def crlf_line(spark, d):
    """Texts with CRLF ends: the end of a line is before both."""
    c = documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return search.selected_lines(c, Request.of(r"tion\.$", crlf=True)).select("file_id", "line_no")


@query(f"WITH {_lines(text='replace(text, chr(32), chr(0))', sep='chr(0)')} SELECT file_id, line_no FROM lines WHERE line = 'the'")
def nul_records(spark, d):
    c = documents(spark, d).withColumn("text", F.replace("text", F.lit(" "), F.lit("\0")))
    return search.selected_lines(c, Request.of("the", line=True, separator="\0")).select("file_id", "line_no")


@query(f"{L} SELECT file_id, line_no FROM lines WHERE NOT regexp_matches(line, '[aeiou]')")
def invert_lines(spark, d):
    return _sel(spark, d, "[aeiou]", invert=True).drop("line")


@query(f"{L} SELECT file_id, line_no FROM lines WHERE NOT (contains(line, 'the') OR contains(line, 'de'))")
def invert_multi_pattern(spark, d):
    return _sel(spark, d, "the", "de", invert=True).drop("line")


@query(f"""WITH {_lines()}, {_line_spans('thin')}, s1 AS (SELECT file_id, start_, end_ FROM spans),
{_line_spans('hing?').replace('g AS (', 'g2 AS (').replace('FROM g)', 'FROM g2)').replace('r AS (SELECT', 'r2 AS (SELECT').replace('FROM r WHERE', 'FROM r2 WHERE').replace('spans AS', 's2 AS')}
SELECT file_id, start_ AS start, end_ AS "end" FROM s1 UNION SELECT file_id, start_, end_ FROM s2""")
def multi_pattern_union(spark, d):
    ps = [compile_pattern(s) for s in ("thin", "hing?")]
    return search.find(documents(spark, d), ps).select("file_id", "start", "end")


@query("""WITH p AS (SELECT DISTINCT item_id, text AS needle FROM benchmark WHERE text IS NOT NULL)
SELECT d.doc_id AS file_id, count(*) AS n FROM documents d JOIN p ON contains(coalesce(d.text, ''), p.needle) GROUP BY 1""")
def pattern_file(spark, d):
    """Patterns from a table: documents with the number of patterns they hold."""
    needles = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("needle")).distinct()
    return search.count_needles(documents(spark, d), needles, NEEDLE_BYTES)


# -- counts, lists, contexts ------------------------------------------------------


@query(f"{L} SELECT file_id, count(*) AS n FROM lines WHERE contains(line, 'that') GROUP BY 1")
def count_lines(spark, d):
    return search.count_lines(documents(spark, d), Request.of("that"))


@query(f"{L} SELECT file_id, CAST(sum(len(regexp_extract_all(line, 'that'))) AS BIGINT) AS n FROM lines GROUP BY 1 HAVING n > 0")
def count_matches(spark, d):
    return search.count_matches(documents(spark, d), Request.of("that"))


@query(f"{L} SELECT file_id, count(*) FILTER (WHERE contains(line, 'license')) AS n FROM lines GROUP BY 1")
def count_include_zero(spark, d):
    return search.count_lines(documents(spark, d), Request.of("license"), include_zero=True)


@query(f"SELECT doc_id AS file_id, {_PATH} AS path FROM documents WHERE contains(text, 'Apache')")
def files_with(spark, d):
    return search.files_with(documents(spark, d), Request.of("Apache")).select("file_id", "path")


@query(f"{L} SELECT file_id FROM lines GROUP BY 1 HAVING NOT bool_or(regexp_matches(line, '[0-9]'))")
def files_without(spark, d):
    return search.files_with(documents(spark, d), Request.of("[0-9]"), without=True).select("file_id")


@query(f"""{L}, n AS (SELECT file_id, any_value(strlen(text)) AS b, CAST(sum(len(regexp_extract_all(line, 'with'))) AS BIGINT) AS m, count(*) FILTER (WHERE contains(line, 'with')) AS s FROM lines GROUP BY 1)
SELECT CAST(sum(m) AS BIGINT) AS matches, CAST(sum(s) AS BIGINT) AS matched_lines, count(*) FILTER (WHERE s > 0) AS files_with_matches, count(*) AS files_searched, CAST(sum(b) AS BIGINT) AS bytes_searched FROM n""")
def stats_summary(spark, d):
    return search.stats(documents(spark, d), Request.of("with"))


_NEAR = """s AS (SELECT file_id, line_no, line, contains(line, 'license') AS m FROM lines),
e AS (SELECT *, bool_or(m) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM s)"""


@query(f"{L}, {_NEAR} SELECT file_id, line_no, line, m AS matched FROM e WHERE near")
def context_lines(spark, d):
    """Two lines before a match, one after it."""
    return search.context_lines(documents(spark, d), Request.of("license", before=2, after=1)).select("file_id", "line_no", "line", "matched")


@query(f"""{L}, s AS (SELECT file_id, line_no, contains(line, 'tion') AS m FROM lines),
e AS (SELECT *, bool_or(m) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM s),
k AS (SELECT file_id, line_no, line_no - lag(line_no) OVER (PARTITION BY file_id ORDER BY line_no) > 1 AS gap FROM e WHERE near) SELECT file_id, line_no FROM k WHERE gap""")
def context_separators(spark, d):
    return search.context_lines(documents(spark, d), Request.of("tion", before=1, after=1)).filter("gap").select("file_id", "line_no")


@query(f"{L} SELECT file_id, line_no, contains(line, 'license') AS matched FROM lines")
def passthru(spark, d):
    return search.context_lines(documents(spark, d), Request.of("license", passthru=True)).select("file_id", "line_no", "matched")


@query(f"{L}, k AS (SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn FROM lines WHERE contains(line, 'the')) SELECT file_id, line_no FROM k WHERE rn <= 2")
def max_count(spark, d):
    return _sel(spark, d, "the", max_count=2).drop("line")


@query(f"""{L}, s AS (SELECT file_id, line_no, contains(line, 'the') AS m FROM lines),
f AS (SELECT *, min(line_no) FILTER (WHERE m) OVER (PARTITION BY file_id) AS first_ FROM s),
b AS (SELECT *, min(line_no) FILTER (WHERE NOT m AND line_no > first_) OVER (PARTITION BY file_id) AS stop_ FROM f)
SELECT file_id, line_no FROM b WHERE m AND line_no >= first_ AND (stop_ IS NULL OR line_no < stop_)""")
def stop_on_nonmatch(spark, d):
    return _sel(spark, d, "the", stop_on_nonmatch=True).drop("line")


@query(f"{L}, t AS (SELECT file_id, line_no, regexp_replace(line, '^[ \\t]+', '') AS t FROM lines WHERE contains(line, 'the')) SELECT file_id, line_no, CASE WHEN strlen(t) > 120 THEN '{output.OMITTED}' ELSE t END AS line FROM t")
def trim_max_columns(spark, d):
    out = _sel(spark, d, "the")
    return out.select("file_id", "line_no", output.limited_width(output.trimmed(F.col("line")), 120).alias("line"))


@query(f"WITH {_spans('tion')} SELECT file_id, start_ AS start, end_ AS \"end\" FROM spans ORDER BY 1, 2 LIMIT 100")
def max_matches_prefix(spark, d):
    return search.first_matches(search.find(documents(spark, d), [compile_pattern("tion")]).select("file_id", "start", "end"), 100)


@query(f"WITH {_spans('license')} SELECT file_id, start_ AS start FROM spans ORDER BY 1, 2 LIMIT 1")
def first_hit(spark, d):
    return search.first_matches(search.find(documents(spark, d), [compile_pattern("license")]), 1).select("file_id", "start")


@query("SELECT doc_id AS file_id FROM documents WHERE contains(text, 'license') ORDER BY 1 LIMIT 3")
def first_file(spark, d):
    return search.files_with(documents(spark, d), Request.of("license")).select("file_id").orderBy("file_id").limit(3)


@query(f"SELECT doc_id AS file_id, {_PATH} AS path FROM documents WHERE contains(text, 'license') ORDER BY path DESC")
def sort_by_path_desc(spark, d):
    return output.sorted_files(search.files_with(documents(spark, d), Request.of("license")), "path", True).select("file_id", "path")


# -- selection ----------------------------------------------------------------------


@query(f"WITH {_spans('the', source='documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)')} SELECT file_id, start_ AS start FROM spans")
def scope_semi_join(spark, d):
    ids = _read(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return search.find(select.scoped(documents(spark, d), ids), [compile_pattern("the", PatternOptions(fixed=True))]).select("file_id", "start")


def _chosen(spark, d, **k):
    return select.choose(documents(spark, d), Selection(**k)).select("file_id", "path")


def _paths(where: str) -> str:
    return f"SELECT file_id, path FROM (SELECT doc_id AS file_id, {_PATH} AS path, text FROM documents) WHERE {where}"


@query(_paths(r"NOT regexp_matches(path, '^[^/]*/[^/]*\.fr$') AND regexp_matches(path, '^src[0-9]/')"))
def glob_filter(spark, d):
    return _chosen(spark, d, globs=("src[0-9]/*", "!*.fr"))


@query(_paths(r"lower(path) LIKE '%.de'"))
def iglob_filter(spark, d):
    return _chosen(spark, d, iglobs=("*.DE",))


@query(_paths(r"path LIKE '%.en' OR path LIKE '%.es'"))
def type_filter(spark, d):
    return _chosen(spark, d, types=("prose",), type_add=("prose:*.{en,es}",))


@query(_paths(r"NOT (path LIKE 'src0/%' AND NOT path LIKE 'src0/%.de') AND NOT path LIKE '%.es'"))
def ignore_rules(spark, d):
    rules = (IgnoreRule("", "/src0", directory=True), IgnoreRule("src0", "*.de", negated=True), IgnoreRule("", "*.es"))
    return _chosen(spark, d, rules=rules)


@query("SELECT doc_id AS file_id FROM documents WHERE lang <> 'fr'")
def hidden_filter(spark, d):
    c = documents(spark, d).withColumn("path", F.when(F.col("path").endswith(".fr"), F.concat(F.lit(".cache/"), "path")).otherwise(F.col("path")))
    return select.choose(c, Selection()).select("file_id")


@query("SELECT doc_id AS file_id FROM documents WHERE lang = 'en'")
def depth_filter(spark, d):
    c = documents(spark, d).withColumn("path", F.when(F.col("path").endswith(".en"), F.col("path")).otherwise(F.concat(F.lit("a/b/"), "path")))
    return select.choose(c, Selection(max_depth=2)).select("file_id")


@query("SELECT doc_id AS file_id FROM documents WHERE strlen(text) <= 1024")
def size_filter(spark, d):
    return _chosen(spark, d, max_size=1024).select("file_id")


@query("SELECT doc_id AS file_id FROM documents WHERE NOT (doc_id % 3 = 0 AND strlen(text) > 0)")
def binary_filter(spark, d):
    c = documents(spark, d).withColumn("text", F.when((F.col("file_id") % 3 == 0) & (F.length("text") > 0), F.concat(F.lit("\0"), "text")).otherwise(F.col("text")))
    return select.choose(c, Selection(binary=False)).select("file_id")


# -- output ---------------------------------------------------------------------------


@query(f"{L}, m AS (SELECT * FROM lines WHERE contains(line, 'license')) SELECT file_id, 1 AS part, line_no, line, begin_ AS absolute_offset, CAST(len(regexp_extract_all(line, 'license')) AS BIGINT) AS submatches FROM m")
def json_events(spark, d):
    """Match events, taken apart again."""
    ev = output.json_events(documents(spark, d), Request.of("license")).filter("part = 1")
    j = F.from_json("event", "type string, data struct<lines: struct<text: string>, line_number: bigint, absolute_offset: bigint, submatches: array<struct<start: bigint, end: bigint>>>")
    return ev.withColumn("j", j).select("file_id", "part", "line_no", F.col("j.data.lines.text").alias("line"), F.col("j.data.absolute_offset").alias("absolute_offset"), F.size("j.data.submatches").cast("bigint").alias("submatches"))


@query(f"WITH {_lines()}, {_line_spans('license|token')} SELECT file_id, line_no, start_ - begin_ + 1 AS \"column\", line FROM spans")
def vimgrep_rows(spark, d):
    return output.vimgrep(documents(spark, d), Request.of("license|token"))


@query(f"WITH {_lines()}, {_line_spans('[0-9]+-[0-9]+')} SELECT file_id, line_no, m AS text FROM spans")
def only_matching(spark, d):
    return output.only_matching(documents(spark, d), Request.of("[0-9]+-[0-9]+")).select("file_id", "line_no", "text")


@query(f"WITH {_lines()}, {_line_spans('license|token')} SELECT file_id, line_no, start_ AS \"offset\", start_ - begin_ + 1 AS \"column\" FROM spans")
def byte_offset_column(spark, d):
    return output.only_matching(documents(spark, d), Request.of("license|token")).select("file_id", "line_no", "offset", "column")


@query(f"{L}, {_NEAR} SELECT file_id, line_no, CAST(line_no AS VARCHAR) || CASE WHEN m THEN ':' ELSE '-' END || line AS shown FROM e WHERE near")
def standard_output(spark, d):
    out = output.standard(documents(spark, d), Request.of("license", before=2, after=1))
    return out.select("file_id", "line_no", F.regexp_replace("shown", "^--\n", "").alias("shown"))


@query("""SELECT doc_id AS file_id, CASE WHEN doc_id % 2 = 0 THEN base64('\\xFF'::BLOB || encode(coalesce(text, ''))) END AS b64, CASE WHEN doc_id % 2 <> 0 THEN coalesce(text, '') END AS text FROM documents""")
def base64_payload(spark, d):
    """Every text, whole, as JSON events carry it: as bytes where a byte before it makes it invalid, else as text."""
    bad = F.col("file_id") % 2 == 0
    content = F.when(bad, F.concat(F.lit(b"\xff"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    j = F.from_json(output.text_or_bytes(content), "text string, bytes string")
    return documents(spark, d).select("file_id", F.regexp_replace(j["bytes"], "[\r\n]+", "").alias("b64"), j["text"].alias("text"))


# -- index ------------------------------------------------------------------------------

_IX = IndexOptions(chunk_bytes=4096, overlap=128)


@query("""WITH c AS (SELECT doc_id AS file_id, strlen(text) AS n, unnest(range(0, greatest(strlen(text), 1), 4096)) AS core_begin FROM documents)
SELECT file_id, core_begin // 4096 AS chunk_no, core_begin, least(core_begin + 4096, n) AS core_end, least(least(core_begin + 4096, n) + 128, n) AS ext_end FROM c""")
def chunk_table(spark, d):
    return ix.chunks(documents(spark, d), _IX)


# windows of whole documents in hexadecimal: chunks, and the blocks of each
_HEX_CHUNKS = """x AS (SELECT doc_id AS file_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
ch AS (SELECT file_id, x, n, unnest(range(0, greatest(n, 1), 4096)) AS p0 FROM x),
chunk AS (SELECT file_id, p0 // 4096 AS chunk_no, p0, least(n, p0 + 4096 + 128) - p0 AS size, substr(x, 2 * p0 + 1, 2 * (4096 + 128)) AS w FROM ch)"""
_HEX_BLOCKS = f"""{_HEX_CHUNKS}, bl AS (SELECT file_id, chunk_no, w, unnest(range(0, greatest(size, 1), 256)) AS b FROM chunk),
block AS (SELECT file_id, chunk_no, b // 256 AS block_no, substr(w, 2 * b + 1, 2 * (256 + 64)) AS w FROM bl)"""


def _holds(literal: str) -> str:
    """All four-byte strings of an ASCII literal, at even places."""
    grams = {literal[i : i + 4].encode().hex().upper() for i in range(len(literal) - 3)}
    return " AND ".join(f"regexp_matches(w, '^(?:..)*?{g}')" for g in sorted(grams))


@query(f"WITH {_HEX_CHUNKS} SELECT file_id, chunk_no FROM chunk WHERE {_holds('license')}")
def qgram_candidates(spark, d):
    """Chunks that hold all four-byte strings of a literal."""
    return ix.candidates(ix.postings(documents(spark, d), _IX, ix.query_grams("license")), "license", _IX).select("file_id", "chunk_no")


@query(f"WITH {_HEX_BLOCKS} SELECT file_id, chunk_no, block_no FROM block WHERE {_holds('license')}")
def block_candidates(spark, d):
    """Blocks that do."""
    return ix.candidates(ix.block_postings(documents(spark, d), _IX, ix.query_grams("license")), "license", _IX).select("file_id", "chunk_no", "block_no")


@query(f"WITH {_lines()}, {_line_spans('(icens|assword)[a-z=]')} SELECT file_id, start_ AS start, end_ AS \"end\" FROM spans")
def indexed_find(spark, d):
    docs = documents(spark, d)
    return ix.indexed_find(docs, ix.postings(docs, _IX), compile_pattern("(icens|assword)[a-z=]"), _IX).select("file_id", "start", "end")


# the byte strings of whole documents in hexadecimal: every fourth one from each of four starts
_DOC_GRAMS = """x AS (SELECT doc_id AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT rid, r, regexp_extract_all(substr(x, CAST(2 * r + 1 AS BIGINT)), '.{8}') AS p FROM x, (SELECT unnest(range(4)) AS r)),
s1 AS (SELECT rid, r, unnest(p) AS gram, unnest(range(len(p))) AS k FROM s),
q AS (SELECT rid, gram, 4 * k + r AS pos FROM s1)"""
_DOC_CHUNKS = f"""{_DOC_GRAMS},
e AS (SELECT gram, rid, pos // 4096 AS c, 1 AS n FROM q UNION ALL SELECT gram, rid, pos // 4096 - 1, 0 FROM q WHERE pos >= 4096 AND pos % 4096 <= 124),
f AS (SELECT gram, rid, c, sum(n) AS n FROM e GROUP BY 1, 2, 3)"""
_DOC_STATS = f"""{_DOC_CHUNKS},
g AS (SELECT gram, rid, sum(n) AS n, count(*) AS c FROM f GROUP BY 1, 2),
stats AS (SELECT gram, CAST(sum(n) AS BIGINT) AS occurrence_frequency, CAST(sum(c) AS BIGINT) AS chunk_frequency, count(*) AS document_frequency FROM g GROUP BY 1)"""


@query(f"WITH {_DOC_STATS} SELECT gram, occurrence_frequency, chunk_frequency, document_frequency FROM stats")
def qgram_stats(spark, d):
    """Over whole documents in any script."""
    return ix.qgram_stats(documents(spark, d), _IX).withColumn("gram", F.hex("gram"))


@query(f"""WITH {_DOC_STATS}, want AS (SELECT DISTINCT hex(encode(substr('another thing', i, 4))) AS gram FROM (SELECT unnest(range(1, 11)) AS i))
SELECT gram FROM want LEFT JOIN stats USING (gram) ORDER BY coalesce(chunk_frequency, 0), gram LIMIT 4""")
def rarity_plan(spark, d):
    grams = ix.plan_grams(ix.qgram_stats(documents(spark, d), _IX), "another thing")
    return spark.createDataFrame([(g.hex().upper(),) for g in grams], "gram string")


@query(f"WITH {_DOC_CHUNKS}, b AS (SELECT DISTINCT ((CAST('0x' || gram AS BIGINT) * 40503) >> 16) % 65536 AS bucket, rid, c FROM f) SELECT bucket, count(*) AS chunks FROM b GROUP BY 1")
def bucket_stats(spark, d):
    return ix.bucket_stats(documents(spark, d), _IX)


@query(f"""WITH {_DOC_CHUNKS}, c AS (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS b FROM documents)
SELECT 'corpus' AS component, n AS rows, b AS bytes FROM c UNION ALL SELECT 'postings', count(*), count(*) * 28 FROM f UNION ALL SELECT 'qgram_stats', count(DISTINCT gram), count(DISTINCT gram) * 28 FROM f""")
def memory_ledger(spark, d):
    docs = documents(spark, d)
    found = ix.postings(docs, _IX)
    return ix.memory_ledger(docs, found, found, ix.qgram_stats(docs, _IX)).filter("component <> 'block_postings'")


@query(f"""WITH {_HEX_BLOCKS}, c AS (SELECT file_id, chunk_no, size FROM chunk WHERE {_holds('license')}),
p AS (SELECT {' + '.join(f"CAST(regexp_matches(w, '^(?:..)*?{g.hex().upper()}') AS BIGINT)" for g in ix.query_grams('license'))} AS n FROM chunk)
SELECT count(*) AS candidate_chunks, count(DISTINCT file_id) AS candidate_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS touched_bytes,
  (SELECT count(*) FROM block WHERE {_holds('license')}) AS candidate_blocks, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM p) AS probe_rows,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM x WHERE file_id IN (SELECT file_id FROM c)) AS verified_bytes,
  (SELECT CAST(sum(len(regexp_extract_all(text, 'license'))) AS BIGINT) FROM documents) AS matches FROM c""")
def search_stats(spark, d):
    """What an indexed search looked at."""
    docs = documents(spark, d)
    grams = ix.query_grams("license")
    return ix.search_stats(docs, ix.postings(docs, _IX, grams), ix.block_postings(docs, _IX, grams), compile_pattern("license", PatternOptions(fixed=True)), _IX)


# -- regions ------------------------------------------------------------------------------

_FAR = PatternOptions(multiline=True, dotall=True)


@query("WITH " + _spans("(?s)und.{0,40}the") + ' SELECT file_id, start_ AS start, end_ AS "end" FROM spans')
def bounded_regions(spark, d):
    """Matching in the regions that the literals of a pattern leave, and nowhere else."""
    return regions.find(documents(spark, d), compile_pattern("und.{0,40}the", _FAR))


@query(f"WITH {_spans('und')}, u AS (SELECT file_id, start_ AS p FROM spans), {_spans('the').replace('g AS (', 'g2 AS (').replace('FROM g)', 'FROM g2)').replace('r AS (SELECT', 'r2 AS (SELECT').replace('FROM r WHERE', 'FROM r2 WHERE').replace('spans AS', 't AS')} SELECT file_id, p AS lo, p AS hi FROM u WHERE EXISTS (SELECT 1 FROM t WHERE t.file_id = u.file_id AND t.start_ BETWEEN u.p + 3 AND u.p + 163)")
def literal_intervals(spark, d):
    """Where a match may begin: intervals of both literals joined by their overlap."""
    found = regions.with_start_intervals(documents(spark, d), compile_pattern("und.{0,40}the", _FAR))
    return search.each(found, F.col("starts"), "file_id").select("file_id", "x.lo", "x.hi")


_BYTES = "b AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents), n AS (SELECT h, count(*) AS n FROM b GROUP BY 1)"


@query(f"WITH {_BYTES} SELECT CAST('0x' || h AS BIGINT) AS byte, n FROM n")
def byte_histogram(spark, d):
    return ix.byte_histogram(documents(spark, d))


# -- changes ------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, {_PATH} AS path, text FROM documents)
SELECT path, CAST(strlen(CASE WHEN doc_id % 11 = 1 THEN upper(substr(text, 1, 10)) ELSE text END) AS BIGINT) AS size FROM d WHERE doc_id % 7 <> 0 OR doc_id % 11 = 1""")
def append_tombstone(spark, d):
    base = documents(spark, d)
    changed = base.filter("file_id % 11 = 1").withColumn("text", upper_each(F.substring("text", 1, 10))).withColumn("size", F.octet_length("text").cast("bigint"))
    return store.append(base, changed, base.filter("file_id % 7 = 0")).select("path", "size")


@query("SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) FILTER (WHERE doc_id % 4 = 0) AS BIGINT) AS appended, sum(strlen(text)) FILTER (WHERE doc_id % 4 = 0) * 100 > sum(strlen(text)) * 25 AS due FROM documents")
def compaction_ratio(spark, d):
    c = documents(spark, d)
    r = c.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("file_id") % 4 == 0, F.col("size"))).alias("appended")).first()
    return spark.createDataFrame([(*r, store.compaction_due(1, r.appended or 0, r.bytes or 0))], "files long, bytes long, appended long, due boolean")


def _scratch(spark) -> str:
    """A new folder for a snapshot: in the shared folder of the cluster, or of this machine if it is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base}/snapshot-{uuid.uuid4().hex}"
    p, fs = store._hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def _changes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    changed = base.filter("file_id % 11 = 1").withColumn("text", upper_each(F.substring("text", 1, 10))).withColumn("size", F.octet_length("text").cast("bigint"))
    return changed, base.filter("file_id % 7 = 0 AND file_id % 11 <> 1").select("path")


@query(f"""WITH d AS (SELECT doc_id, {_PATH} AS path, text FROM documents)
SELECT path, CAST(strlen(CASE WHEN doc_id % 11 = 1 THEN upper(substr(text, 1, 10)) ELSE text END) AS BIGINT) AS size FROM d WHERE doc_id % 7 <> 0 OR doc_id % 11 = 1""")
def snapshot_segments(spark, d):
    """A snapshot that is saved, changed by a segment, and loaded with its digest checked."""
    path, base = _scratch(spark), documents(spark, d)
    store.save(base, path, {"root": "documents"})
    store.add_segment(spark, path, *_changes(base))
    return store.load(spark, path, {"root": "documents"}).select("path", "size")


@query("SELECT count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, true AS same, false AS changed FROM documents")
def snapshot_fingerprint(spark, d):
    """Files, bytes, whether a shuffled copy has the same digest, and one with a change."""
    c = documents(spark, d)
    a = store.fingerprint(c)
    b = store.fingerprint(c.orderBy(F.desc("path"))).select(F.col("digest").alias("b"))
    x = store.fingerprint(c.withColumn("text", F.when(F.col("file_id") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")))).select(F.col("digest").alias("x"))
    return a.crossJoin(b).crossJoin(x).select("files", "bytes", (F.col("digest") == F.col("b")).alias("same"), (F.col("digest") == F.col("x")).alias("changed"))


@query("SELECT doc_id AS file_id, coalesce(text, '') AS text FROM documents")
def decode_utf16(spark, d):
    """UTF-16 with its mark, in either order, and UTF-8: all come back."""
    b = F.when(F.col("file_id") % 3 == 0, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))).when(F.col("file_id") % 3 == 1, F.concat(F.lit(b"\xfe\xff"), F.encode("text", "UTF-16BE"))).otherwise(F.col("text").cast("binary"))
    return documents(spark, d).select("file_id", store.decoded(b).alias("text"))


_PACKERS = (("a.gz", gzip.compress), ("a.bz2", bz2.compress), ("a.xz", lzma.compress), ("a.lz4", lambda b: pa.compress(b, "lz4", asbytes=True)), ("a.txt", bytes))


@query("SELECT doc_id AS file_id, sha256(coalesce(text, '') || '!') AS digest FROM documents")
def unpacked_texts(spark, d):
    """Packed files by their names, then a preprocessor that puts a mark at their ends."""

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                name, pack = _PACKERS[i % len(_PACKERS)]
                out.append(store.preprocessed(lambda _, x: x + b"!", name, store.unpacked(name, pack(t.encode()))))
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(out, pa.binary())], ["file_id", "content"])

    return documents(spark, d).select("file_id", "text").mapInArrow(run, "file_id long, content binary").select("file_id", F.sha2("content", 256).alias("digest"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS documents, count(*) FILTER (WHERE event_type = 'error') AS matched FROM events GROUP BY 1")
def stream_rates(spark, d):
    """Windowed rates of a stream, read to its end: the events as they come from files."""
    source = spark.readStream.schema(_read(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rates = stream.match_rates(source, "event_type", "ts", Request.of("error"), "1 hour", "40 days")
    name, path = f"rates_{uuid.uuid4().hex}", _scratch(spark)
    q = rates.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"SELECT {_PATH} AS path FROM documents WHERE doc_id % 10 IN (1, 2, 3)")
def freshness_diff(spark, d):
    """Gone, grown and touched files."""
    old = documents(spark, d).withColumn("mtime_ns", F.lit(1).cast("bigint"))
    new = old.filter("file_id % 10 <> 1").withColumn("size", F.col("size") + (F.col("file_id") % 10 == 2).cast("int")).withColumn("mtime_ns", F.col("mtime_ns") + (F.col("file_id") % 10 == 3).cast("int"))
    return store.stale(old, new).select("path")


# -- analytics ------------------------------------------------------------------------------


@query(f"WITH {_BYTES}, t AS (SELECT sum(n) AS t FROM n) SELECT round(-sum(n / t * log2(n / t)), 6) AS bits FROM n, t")
def byte_entropy(spark, d):
    return analytics.byte_entropy(documents(spark, d)).select(F.round("bits", 6).alias("bits"))


@query(f"WITH {_DOC_GRAMS}, n AS (SELECT gram, count(*) AS n FROM q GROUP BY 1), t AS (SELECT sum(n) AS t FROM n) SELECT round(-sum(n / t * log2(n / t)), 6) AS bits FROM n, t")
def qgram_entropy(spark, d):
    return analytics.qgram_entropy(documents(spark, d), 4).select(F.round("bits", 6).alias("bits"))


@query("""WITH x AS (SELECT doc_id, substr(hex(encode(text)), 1, 16384) AS x FROM documents WHERE text <> ''),
a AS (SELECT doc_id, x, coalesce(sum(length(x) // 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p0 FROM x),
s AS (SELECT doc_id, substr(x, 1, CAST(2 * (131072 - p0) AS BIGINT)) AS x FROM a WHERE p0 < 131072),
b AS (SELECT unnest(regexp_extract_all(x, '..')) AS b FROM s), n AS (SELECT b, count(*) AS n FROM b GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
g AS (SELECT DISTINCT unnest(list_transform(range(0, length(x) // 2 - 3), lambda i: substr(x, 2 * i + 1, 8))) AS g FROM s)
SELECT (SELECT CAST(sum(length(x) // 2) AS BIGINT) FROM s) AS sampled_bytes, (SELECT round(-sum(n / t * log2(n / t)), 6) FROM n, t) AS bits, (SELECT least(count(*), 50000) FROM g) AS unique_grams""")
def sampled_profile(spark, d):
    return analytics.sampled_profile(documents(spark, d)).withColumn("bits", F.round("bits", 6))


@query("SELECT event_type, list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def ranked_percentile(spark, d):
    """The element at a rank, as it is: no interpolation."""
    e = _read(spark, d, "events").filter("value IS NOT NULL").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return analytics.ranked_of_counts(e, "value", "n", 0.95, "event_type").withColumnRenamed("ranked", "p95")


@query("SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(strlen(text)) AS min_size, max(strlen(text)) AS max_size, round(avg(strlen(text)), 6) AS mean_size, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (WHERE contains(text, chr(0))) AS binaries FROM documents")
def corpus_profile(spark, d):
    return analytics.corpus_profile(documents(spark, d)).withColumn("mean_size", F.round("mean_size", 6))


@query("SELECT min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_docs(spark, d):
    return analytics.duplicate_files(documents(spark, d))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentile_latency(spark, d):
    out = analytics.percentiles(_read(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"""WITH {_spans('tion')}, w AS (SELECT file_id, greatest(start_ - 20, 0) AS a, end_ + 20 AS b FROM spans),
k AS (SELECT *, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a))) AS n FROM w)
SELECT file_id, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""")
def interval_union_bytes(spark, d):
    s = _find(spark, d, "tion", fixed=True)
    return analytics.covered_bytes(s.select("file_id", F.greatest(F.col("start") - 20, F.lit(0)).alias("start"), (F.col("end") + 20).alias("end")))


@query("""WITH p AS (SELECT l_suppkey AS k, sum(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c FROM lineitem GROUP BY 1), q AS (SELECT k, round(a, 2) AS a, round(b, 2) AS b, round(c, 4) AS c FROM p)
SELECT k FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.a <= q.a AND o.b <= q.b AND o.c <= q.c AND (o.a < q.a OR o.b < q.b OR o.c < q.c))""")
def pareto_frontier(spark, d):
    p = _read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("a"), F.round(F.avg("l_extendedprice"), 2).alias("b"), F.round(F.avg("l_discount"), 4).alias("c"))
    return analytics.pareto_frontier(p, ["a", "b", "c"]).select("k")


@query("""WITH q AS (SELECT p_brand AS name, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1), s AS (SELECT name, 0.75 * a / 1000.0 + 0.25 * b / 25.0 AS loss FROM q)
SELECT name, round(loss, 6) AS loss FROM s ORDER BY s.loss, name LIMIT 1""")
def weighted_selection(spark, d):
    p = _read(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    return analytics.weighted_choice(p, {"a": 3.0, "b": 1.0}, {"a": 1000.0, "b": 25.0}, "name").withColumn("loss", F.round("loss", 6))


def _plans(spark, d):
    """Three plans a query, made from events."""
    e = _read(spark, d, "events")
    return e.select(
        F.col("event_type").alias("workload_key"), F.lit("regex").alias("semantic_mode"), F.floor(F.col("event_id") / 3).cast("string").alias("query_name"), (F.col("event_id") % 3).cast("string").alias("plan"),
        (F.col("event_id") * 7 % 100 + 1).cast("double").alias("predicted_cost"), (F.col("value") + 1).alias("actual_cost"), (F.col("event_id") % 3 == 0).alias("chosen"), (F.col("event_id") % 3 == 1).alias("observed"), (F.col("event_id") % 5 == 0).alias("is_fallback"),
    )


@query("""WITH e AS (SELECT event_type AS workload_key, CAST(event_id // 3 AS VARCHAR) AS query_name, event_id % 3 AS plan, value + 1 AS actual FROM events),
c AS (SELECT workload_key, query_name, actual FROM e WHERE plan = 0), o AS (SELECT workload_key, query_name, actual FROM e WHERE plan = 1),
r AS (SELECT workload_key, CASE WHEN o.actual < c.actual THEN c.actual - o.actual ELSE 0 END AS loss, CASE WHEN o.actual < c.actual THEN (c.actual - o.actual) / greatest(o.actual, 1e-9) ELSE 0 END AS rel FROM c LEFT JOIN o USING (workload_key, query_name))
SELECT workload_key, count(*) AS query_count, CAST(count(*) FILTER (WHERE loss > 1e-6) AS BIGINT) AS suboptimal_plan_count, round(avg(rel), 6) AS mean_regret FROM r GROUP BY 1""")
def plan_regret_report(spark, d):
    r = analytics.plan_regret(_plans(spark, d)).filter("chosen_plan IS NOT NULL")
    return analytics.regret_groups(r).select("workload_key", "query_count", "suboptimal_plan_count", F.round("mean_regret", 6).alias("mean_regret"))


def _scenarios(spark, d):
    e = _read(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50_ms"), F.percentile("value", F.lit(0.95)).alias("p95_ms"), F.sum("value").alias("search_ms"), F.count(F.lit(1)).alias("searches"))
    lit = lambda v: F.lit(float(v))
    return e.select(F.col("event_type").alias("scenario"), F.lit(True).alias("correct"), "search_ms", "searches", "p50_ms", "p95_ms", lit(5).alias("mb_s"), lit(1000).alias("rss_kb"), lit(0.1).alias("fallback_rate"), lit(0.05).alias("mean_regret"), F.col("search_ms").alias("base_search_ms"), (F.col("p50_ms") * 0.9).alias("base_p50_ms"), F.col("p95_ms").alias("base_p95_ms"), lit(1000).alias("base_rss_kb"))


@query("""WITH s AS (SELECT event_type AS scenario, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS per FROM events GROUP BY 1)
SELECT scenario, CASE WHEN p50 / (p50 * 0.9) > 1.15 THEN 'ROLLBACK' WHEN p50 > 100 OR p95 > 300 OR per > 50 OR p50 / (p50 * 0.9) > 1.05 THEN 'FAIL' ELSE 'PASS' END AS status,
CASE WHEN p50 / (p50 * 0.9) > 1.05 THEN 'REGRESSION' ELSE 'NEUTRAL' END AS classification FROM s""")
def gate_verdicts(spark, d):
    return analytics.gate_verdicts(_scenarios(spark, d), Thresholds()).select("scenario", "status", "classification")


@query("""WITH s AS (SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS per FROM events GROUP BY 1),
v AS (SELECT CASE WHEN p50 / (p50 * 0.9) > 1.15 THEN 3 WHEN p50 > 100 OR p95 > 300 OR per > 50 OR p50 / (p50 * 0.9) > 1.05 THEN 2 ELSE 0 END AS r, CASE WHEN p50 / (p50 * 0.9) > 1.05 THEN 'REGRESSION' ELSE 'NEUTRAL' END AS k FROM s)
SELECT ['PASS', 'WARN', 'FAIL', 'ROLLBACK'][max(r) + 1] AS status, max(r) < 2 AS passed, count(*) FILTER (WHERE k = 'WIN') AS wins, count(*) FILTER (WHERE k = 'NEUTRAL') AS neutral, count(*) FILTER (WHERE k = 'REGRESSION') AS regressions FROM v""")
def gate_overall(spark, d):
    return analytics.gate_overall(analytics.gate_verdicts(_scenarios(spark, d), Thresholds()))


# -- plans ------------------------------------------------------------------------------------

_LITERALS = ("license", "tion", "another thing", "zzzzqqqq")


@query(f"""WITH {_DOC_STATS}, k AS (SELECT CAST(sum(greatest((strlen(coalesce(text, '')) + 4095) // 4096, 1)) AS BIGINT) AS chunks, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS b FROM documents),
l AS (SELECT unnest([{', '.join(f"'{x}'" for x in _LITERALS)}]) AS expression),
lg AS (SELECT DISTINCT expression, hex(encode(substr(expression, i, 4))) AS gram FROM (SELECT expression, unnest(range(1, length(expression) - 2)) AS i FROM l)),
lf AS (SELECT expression, gram, coalesce(chunk_frequency, 0) AS n FROM lg LEFT JOIN stats USING (gram)),
m AS (SELECT expression, least(1.0, min(n) / any_value(k.chunks)) AS s, least(count(*), 4) AS probes FROM lf, k GROUP BY 1),
lc AS (SELECT expression, s, probes, greatest(CAST(floor(s * chunks) AS BIGINT), CASE WHEN s < 1 THEN 1 ELSE 0 END) AS c, greatest(CAST(floor(s * chunks * 16) AS BIGINT), CASE WHEN s < 1 THEN 1 ELSE 0 END) AS bl, b FROM m, k)
SELECT expression, plan, round(s, 9) AS selectivity, round(cost, 3) AS cost FROM (
  SELECT expression, s, 'positional-block' AS plan, 0.5 * bl * 320 + 50 * bl + 10 * c + probes * c AS cost FROM lc
  UNION ALL SELECT expression, s, 'chunk', c * 4096.0 + 100 * c FROM lc UNION ALL SELECT expression, s, 'whole-file', CAST(b AS DOUBLE) + 100 * c FROM lc)""")
def plan_costs(spark, d):
    """Physical plans of a few literals with their costs, by the statistics of the index."""
    docs = documents(spark, d)
    n = docs.agg(F.sum(F.greatest(F.ceil(F.col("size") / _IX.chunk_bytes), F.lit(1))).cast("bigint").alias("c"), F.sum("size").alias("b")).first()
    grams = sorted({g for x in _LITERALS for g in ix.query_grams(x)})
    known = ix.qgram_stats(docs, _IX).filter(F.col("gram").isin([F.lit(g) for g in grams])).select("gram", "chunk_frequency").collect()  # a few dozen rows
    facts = tuning.IndexFacts(n.c, n.c * (_IX.chunk_bytes // _IX.block_bytes), n.b, {bytes(r.gram): r.chunk_frequency for r in known})
    rows = [(x, c.plan.value, round(c.selectivity, 9), round(float(c.cost), 3)) for x in _LITERALS for c in tuning.fixed_plans(tuning.PlanKey(x, PatternOptions(fixed=True), _IX), facts)]
    return spark.createDataFrame(rows, "expression string, plan string, selectivity double, cost double")


@query("""SELECT s_name AS name, CAST(list_reduce(list_transform(string_split(s_name, ''), lambda c: CAST(ascii(c) AS HUGEINT)), lambda h, b: (xor(h, b) * CAST(1099511628211 AS HUGEINT)) % CAST('18446744073709551616' AS HUGEINT), CAST('14695981039346656037' AS HUGEINT)) AS VARCHAR) AS digest FROM supplier""")
def fnv1a_names(spark, d):
    """The digest that plan keys use, of every supplier's name."""

    def run(batches):
        for b in batches:
            names = b.column("name").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([str(tuning.fnv1a(x)) for x in names])], ["name", "digest"])

    return _read(spark, d, "supplier").select(F.col("s_name").alias("name")).mapInArrow(run, "name string, digest string")


@query("""WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS f FROM events GROUP BY 1)
SELECT event_type, CASE WHEN (n >= 20 AND f / n > 0.05) OR f > 10 THEN 'rollback_enforced' ELSE 'rollout_active' END AS state, round(f / n, 6) AS ratio FROM c""")
def rollout_states(spark, d):
    """A rollout for each kind of event, slow ones taken for fallbacks."""
    rows = []
    for r in _read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 50).cast("bigint")).alias("f")).collect():  # a row a kind
        x = tuning.Rollout(tuning.RolloutState.ACTIVE, {"blocks"})
        for i in range(r.n):
            x.record(i < r.f)
        x.guard()
        rows.append((r.event_type, x.state.value, round(x.ratio, 6)))
    return spark.createDataFrame(rows, "event_type string, state string, ratio double")


# -- other tables ---------------------------------------------------------------------------


@query(f"WITH {_lines('pages', 'page_id', 'html')} SELECT file_id, line_no, CAST(len(regexp_extract_all(line, '<a [^>]*>')) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, '<a [^>]*>')")
def page_links(spark, d):
    c = store.from_table(_read(spark, d, "pages"), "page_id", "url", "html")
    rows = search.each(search.selected(c, Request.of("<a [^>]*>")), F.filter("lines", lambda x: x["sel"]), "file_id")
    return rows.select("file_id", F.col("x.no").alias("line_no"), F.col("x.hits").alias("n"))


@query("SELECT role, count(*) AS turns, count(*) FILTER (WHERE regexp_matches(text, '[?]')) AS asking FROM conversations GROUP BY 1")
def conversation_questions(spark, d):
    p = compile_pattern(r"\?")
    return _read(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.contains("text", F.lit(p.pure)).cast("bigint")).alias("asking"))

