"""Quality rules by weak supervision, in DataFrame functions only.

Nine rules look at counts of a text and vote good (1) or bad (-1) or abstain
(0).  Expectation-maximisation over the distinct vote patterns of the whole
table (at most 3^9 rows, whatever the table's size) estimates the share of good
documents and, for each rule, how often it is right on good documents (``good``)
and on bad ones (``bad``).  All votes of a document count together: its posterior
probability decides, so votes for it outweigh a bad vote of a rule that errs
often, and several bad votes, or one of a rule that never errs, outweigh the
rest.  Base limits of the contract come first.

EM starts from rules that are nearly always right on good documents and a little
better than chance on bad ones: a bad document offends against few rules.  From
there one bad vote alone is no reason to reject and two are.  ``RANGE`` only keeps
estimates off 0 and 1, where a rule's vote would be final.

The counts cost one pass over the texts and no shuffle; they are stored, and
patterns and verdicts are taken from the stored numbers.

Defined cases: null text has no words and fails the base limits, as do texts
under 50 words.  Rows with equal or null doc_id are separate.  An empty table
gives no rows.  Counts are over whole texts; repeated windows are told apart by
64-bit hashes of their three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import stored, table

ROUNDS = 20
#: Where EM starts: share of good documents, accuracies of every rule on good and on bad ones.
START_PRIOR, START_GOOD, START_BAD = 0.8, 0.99, 0.6
#: Bounds of all estimates.
RANGE = (0.001, 0.999)

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"

#: Rule: (good if, bad if), over the counts.  Plain SQL, the same for Spark and DuckDB.
RULES = {
    "symbols": ("n_symbols * 50 <= n_words", "n_symbols * 5 > n_words"),
    "letters": ("n_letters * 100 >= word_chars * 94", "n_letters * 10 < word_chars * 9"),
    "length": ("word_chars * 2 >= 9 * n_words AND word_chars * 2 <= 13 * n_words", "word_chars < 4 * n_words OR word_chars > 7 * n_words"),
    "repeats": ("n_repeat_words * 20 <= n_words", "n_repeat_words * 10 > 3 * n_words"),
    "variety": ("n_distinct * 2 >= n_words", "n_distinct * 10 < 3 * n_words"),
    "lines": ("n_dup_lines = 0", "n_dup_lines * 10 > n_lines"),
    "capitals": ("n_capitals * 10 <= word_chars", "n_capitals * 2 > word_chars"),
    "shouts": ("n_shouts * 50 <= n_words", "n_shouts * 5 > n_words"),
    "size": ("n_words >= 80", "n_words < 50"),
}
_VOTES = [f"v_{r}" for r in RULES]
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _vote(rule: str) -> str:
    good, bad = RULES[rule]
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def _repeat_words(words: Column, h: Column) -> Column:
    """Words in 3-word windows that occur twice or more; ``h`` has the windows' hashes."""
    tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        # bound as a one-element array, so that it is computed once
        widths = F.transform(F.array(at), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))
        return F.get(widths, F.lit(0))

    whole = F.get(F.transform(F.array(tagged), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(whole)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(_BLANKS))
    one = docs.select("doc_id", text.alias("text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE, -1)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    two = one.select("*", F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"), lines.alias("lines"))
    of = lambda p: F.length(F.regexp_replace("text", p, "")).cast("long")
    return two.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        of(_SPACE).alias("word_chars"),
        of(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("h")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        of(r"[^A-ZÀ-ÖØ-Þ]+").alias("n_capitals"),
        of(r"[^!]+").alias("n_shouts"),
        of(r"[^\p{L}\p{M}\p{N}]+").alias("n_letters"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def accuracies(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: prior, good, bad (the last two in the order of RULES), by EM over vote patterns."""
    k = len(RULES)
    patterns = votes.groupBy(*_VOTES).agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = patterns.agg(F.sort_array(F.collect_list(F.struct(F.array(*(F.col(v).cast("double") for v in _VOTES)).alias("v"), F.col("n")))).alias("p"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(RANGE[0]), F.least(F.lit(RANGE[1]), x))

    def step(s: Column, p: Column) -> Column:
        def odds(v: Column, j: Column) -> Column:
            g, b = F.get(s["good"], j), F.get(s["bad"], j)
            return F.when(v > 0, (1 - b) / g).when(v < 0, b / (1 - g)).otherwise(F.lit(1.0))

        # q: the pattern's probability of being good
        against = lambda x: F.aggregate(F.transform(x["v"], odds), (1 - s["prior"]) / s["prior"], lambda a, b: a * b)
        rated = F.transform(p, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), (1 / (1 + against(x))).alias("q")))

        def update(r: Column) -> Column:
            n = total(F.transform(r, lambda x: x["n"]))

            def accuracy(j: int, sign: int) -> Column:
                mass = lambda x: x["n"] * (x["q"] if sign > 0 else 1 - x["q"])
                cast = total(F.transform(r, lambda x: F.when(x["v"][j] != 0, mass(x)).otherwise(F.lit(0.0))))
                right = total(F.transform(r, lambda x: F.when(x["v"][j] == sign, mass(x)).otherwise(F.lit(0.0))))
                return F.when(cast > 0, clamp(right / cast)).otherwise(F.lit(START_GOOD if sign > 0 else START_BAD))

            prior = F.when(n > 0, clamp(total(F.transform(r, lambda x: x["n"] * x["q"])) / n)).otherwise(F.lit(START_PRIOR))
            return F.struct(prior.alias("prior"), F.array(*(accuracy(j, 1) for j in range(k))).alias("good"), F.array(*(accuracy(j, -1) for j in range(k))).alias("bad"))

        return F.get(F.transform(F.array(rated), update), F.lit(0))

    same = lambda x: F.array(*[F.lit(x)] * k)
    begin = F.struct(F.lit(START_PRIOR).alias("prior"), same(START_GOOD).alias("good"), same(START_BAD).alias("bad"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, lambda s, _: step(s, F.col("p")))
    return whole.select(end.alias("m")).select("m.*")


def judged(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, counts, votes, base_failed, quality (posterior), kept."""
    numbers = stored(counts(docs), "quality")
    votes = numbers.select("*", *(F.expr(_vote(r)).alias(f"v_{r}") for r in RULES), F.expr(BASE_FAILED).alias("base_failed"))
    m = accuracies(votes, rounds).first()  # 19 numbers
    against = F.lit((1 - m.prior) / m.prior)
    for v, g, b in zip(_VOTES, m.good, m.bad, strict=True):
        against = against * F.when(F.col(v) > 0, (1 - b) / g).when(F.col(v) < 0, b / (1 - g)).otherwise(1.0)
    quality = 1 / (1 + against)
    return votes.select("*", quality.alias("quality"), (~F.col("base_failed") & (quality >= 0.5)).alias("kept"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """``docs`` that are kept, all columns.  Rows of one doc_id stay or go by their own text."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "text").alias("id"))
    good = judged(packed.select(F.col("id").alias("doc_id"), "row.text")).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    return packed.join(good, "id", "left_semi").select("row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _sql() -> str:
    odds = "(1 - prior) / prior * " + " * ".join(f"CASE WHEN v_{r} > 0 THEN (1 - b_{r}) / g_{r} WHEN v_{r} < 0 THEN b_{r} / (1 - g_{r}) ELSE 1 END" for r in RULES)
    steps = [f"m0 AS (SELECT CAST({START_PRIOR} AS DOUBLE) AS prior, " + ", ".join(f"CAST({START_GOOD} AS DOUBLE) AS g_{r}, CAST({START_BAD} AS DOUBLE) AS b_{r}" for r in RULES) + ")"]

    def accuracy(name: str, rule: str, sign: int, mass: str, start: float) -> str:
        cast = f"sum(CASE WHEN v_{rule} <> 0 THEN {mass} ELSE 0 END)"
        return f"CASE WHEN {cast} > 0 THEN greatest({RANGE[0]}, least({RANGE[1]}, sum(CASE WHEN v_{rule} = {sign} THEN {mass} ELSE 0 END) / {cast})) ELSE {start} END AS {name}_{rule}"

    for i in range(ROUNDS):
        new = ", ".join(f"{accuracy('g', r, 1, 'n * q', START_GOOD)}, {accuracy('b', r, -1, 'n * (1 - q)', START_BAD)}" for r in RULES)
        steps.append(f"q{i} AS MATERIALIZED (SELECT p.*, 1 / (1 + {odds}) AS q FROM patterns p, m{i})")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT greatest({RANGE[0]}, least({RANGE[1]}, sum(n * q) / sum(n))) AS prior, {new} FROM q{i})")
    return rf"""
WITH one AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM one WHERE len(w) > 2),
named AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM grams),
rep AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM named WHERE n > 1) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM one),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
num AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_capitals, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts,
         length(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')) AS n_letters, len(list_distinct(w)) AS n_distinct
  FROM one LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
votes AS (SELECT *, {", ".join(f"{_vote(r)} AS v_{r}" for r in RULES)}, {BASE_FAILED} AS base_failed FROM num),
patterns AS MATERIALIZED (SELECT {", ".join(_VOTES)}, CAST(count(*) AS DOUBLE) AS n FROM votes GROUP BY ALL),
{", ".join(steps)},
fin AS (SELECT votes.*, 1 / (1 + {odds}) AS q FROM votes, m{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS quality FROM fin
"""


SQL = _sql()
