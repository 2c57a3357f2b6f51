"""Mixing sources to target weights, in DataFrame functions only.

Documents hang in a tree domain - language - source.  A budget of tokens is
handed down by weights.  No node gets more than its documents give in
``EPOCHS`` passes; what a node cannot use goes to its siblings by their weights
(water-filling), and only what a whole family cannot use goes up to its
ancestors' other families: a family's capacity is the sum of its members'.

A leaf's allocation is a number of whole passes and a prefix of one more, in the
order of a hash of seed, pass and doc_id: the documents whose running sum of
tokens stays within what is left.  Running sums are hierarchical: sums of
``BUCKETS`` hash ranges for each leaf first, then a sort of the one range that the
cut falls into, so no task sorts a whole leaf, however hot.

All sums are of integers; results don't depend on the order of rows.

Defined cases: null text has no tokens; null language or source is ``(none)``;
a null doc_id orders as an empty string.  Leaves without tokens get nothing,
their documents are never chosen.  Documents that aren't chosen have no row.
Unlisted names weigh ``OTHER``.  Equal rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import hot_join, stored, table

SEED = 17
EPOCHS = 2
#: Share of all tokens that is handed out, in percent.
BUDGET_PERCENT = 100
OTHER = 50
#: Hexadecimal digits of the hash that make a range.
DIGITS = 3
BUCKETS = 16**DIGITS

#: Plain SQL, the same for Spark and DuckDB.
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN right(source, 1) IN ('4', '5', '6') THEN 'books' WHEN right(source, 1) IN ('7', '8', '9') THEN 'code' ELSE 'rest' END"
WEIGHTS = {
    "domain": {"web": 500, "books": 300, "code": 150},
    "lang": {"en": 600, "de": 150, "fr": 150, "es": 100},
    "source": {"src0": 100},
}
LEVELS = ("domain", "lang", "source")


def weight_sql(level: str, weights: dict[str, int]) -> str:
    if not weights:
        return f"CAST({OTHER} AS BIGINT)"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CAST(CASE {level} " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in weights.items()) + f" ELSE {OTHER} END AS BIGINT)"


def _fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes``: parent..., child, cap, w and the parent's budget; gives alloc for each child."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    some = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    level = (F.col("budget") - some("cap", before)) / (some("w", whole) - some("w", before))
    full = nodes.withColumn("full", F.col("cap") / F.col("w") <= level)
    used = lambda c: F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(whole), F.lit(0))
    rest = (F.col("budget") - used("cap")) / F.nullif(some("w", whole) - used("w"), F.lit(0))
    return full.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.floor(rest * F.col("w")))).drop("full")


def allocate(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int, epochs: int = EPOCHS) -> DataFrame:
    """``leaves``: domain, lang, source, tokens.  Adds cap and alloc."""
    base = leaves.withColumn("cap", F.col("tokens") * epochs)
    known = None
    for depth, level in enumerate(LEVELS):
        at, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = base.groupBy(*at).agg(F.sum("cap").alias("cap")).withColumn("w", F.expr(weight_sql(level, weights.get(level, {})))).filter("w > 0")
        if known is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("bigint")).withColumn("root", F.lit(0))
            known = _fill(nodes, ["root"], level)
        else:
            nodes = nodes.join(known, parent)
            known = _fill(nodes, parent, level)
        known = known.select(*at, F.col("alloc").alias("budget"))
    return base.join(known.withColumnRenamed("budget", "alloc"), list(LEVELS))


def mix(docs: DataFrame, domain: str = DOMAIN, weights: dict[str, dict[str, int]] | None = None, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Chosen documents: doc_id, domain, lang, source, n_tokens, copies (passes that hold it).

    ``budget`` in tokens; by default BUDGET_PERCENT of all there are.
    """
    weights = WEIGHTS if weights is None else weights
    named = docs.select("doc_id", F.expr(domain).alias("domain"), F.coalesce("lang", F.lit("(none)")).alias("lang"), F.coalesce("source", F.lit("(none)")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = stored(named, "tokens")
    leaves = stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "leaves")
    sums = leaves.agg(F.sum("tokens").alias("t"), F.sum("n_docs").alias("n")).first()
    if budget is None:
        budget = (sums.t or 0) * BUDGET_PERCENT // 100
    given = allocate(leaves, weights, budget, epochs).filter("tokens > 0 AND alloc > 0")
    given = given.withColumn("passes", F.expr("alloc div tokens")).withColumn("left_over", F.expr("alloc % tokens")).select(*LEVELS, "n_docs", "passes", "left_over")
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = hot_join(rows, stored(given, "given"), list(LEVELS), "n_docs", sums.n or 0).withColumn("mark", mark).withColumn("range", F.substring("mark", 1, DIGITS))
    placed = stored(placed.select("doc_id", *LEVELS, "n_tokens", "passes", "left_over", "mark", "range"), "placed")
    key = [*LEVELS, "range"]
    ranges = placed.groupBy(*key).agg(F.sum("n_tokens").alias("t"), F.max("left_over").alias("most"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("upto", upto).select(*key, (F.col("upto") <= F.col("most")).alias("inside"), (F.col("upto") - F.col("t")).alias("base"), ((F.col("upto") > F.col("most")) & (F.col("upto") - F.col("t") <= F.col("most"))).alias("cut"))
    seen = placed.join(ranges, key)
    run = F.col("base") + F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("mark", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    cut = seen.filter("cut").withColumn("extra", (run <= F.col("left_over")).cast("int"))
    rest = seen.filter("NOT cut").withColumn("extra", F.col("inside").cast("int"))
    return rest.unionByName(cut).withColumn("copies", F.col("passes") + F.col("extra")).filter("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _level_sql(depth: int) -> str:
    level, at, parent = LEVELS[depth], ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "1"
    budget = f"(SELECT budget FROM a{depth - 1} p WHERE " + " AND ".join(f"p.{c} = n.{c}" for c in LEVELS[:depth]) + ")" if depth else "(SELECT total FROM budget)"
    order = f"(PARTITION BY {parent} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
n{depth} AS (SELECT *, {budget} AS budget FROM (SELECT {at}, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS cap, {weight_sql(level, WEIGHTS[level])} AS w FROM leaves GROUP BY {at}) n),
f{depth} AS (SELECT *, cap / w <= (budget - coalesce(sum(cap) OVER {order}, 0)) / (sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER {order}, 0)) AS fits FROM n{depth}),
a{depth} AS (SELECT {at}, CAST(CASE WHEN fits THEN cap ELSE floor((budget - coalesce(sum(cap) FILTER (WHERE fits) OVER (PARTITION BY {parent}), 0))
  / nullif(sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) FILTER (WHERE fits) OVER (PARTITION BY {parent}), 0), 0) * w) END AS BIGINT) AS budget FROM f{depth})"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
budget AS (SELECT CAST(sum(tokens) AS BIGINT) * {BUDGET_PERCENT} // 100 AS total FROM leaves),
{",".join(_level_sql(i) for i in range(3))},
given AS (SELECT domain, lang, source, budget // tokens AS passes, budget % tokens AS left_over FROM a2 JOIN leaves USING (domain, lang, source) WHERE tokens > 0 AND budget > 0),
run AS (
  SELECT d.*, passes, left_over, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('{SEED}:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN given USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, passes + CASE WHEN upto <= left_over THEN 1 ELSE 0 END AS copies
FROM run WHERE passes > 0 OR upto <= left_over
"""
