"""Measures of corpora and of measurements: entropy, duplicates, percentiles,
interval unions, skylines, regret and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.index import Q, byte_histogram, grams_of, qgram_stats


def entropy(histogram: DataFrame, n: str = "n") -> DataFrame:
    """One row: bits, of a table of counts.  Sums of n and of n log n suffice, so one pass."""
    sums = histogram.agg(F.sum(n).cast("double").alias("t"), F.sum(F.col(n) * F.log2(n)).alias("s"))
    return sums.select(F.coalesce(F.when(F.col("t") > 0, F.log2("t") - F.col("s") / F.col("t")), F.lit(0.0)).alias("bits"))


def byte_entropy(corpus: DataFrame) -> DataFrame:
    return entropy(byte_histogram(corpus))


def qgram_entropy(corpus: DataFrame, q: int) -> DataFrame:
    """Entropy of the q-byte strings of all texts."""
    if q == Q:
        return entropy(qgram_stats(corpus).select("gram", F.col("occurrence_frequency").alias("n")))
    b = F.col("b")
    grams = F.when(F.octet_length(b) >= q, F.transform(F.sequence(F.lit(1), F.octet_length(b) - (q - 1)), lambda i: F.substring(b, i, F.lit(q)))).otherwise(F.array().cast("array<binary>"))
    rows = corpus.select(F.col("text").cast("binary").alias("b")).select(F.explode(grams).alias("g"))
    return entropy(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))


def corpus_profile(corpus: DataFrame) -> DataFrame:
    """One row: files, bytes, least, greatest and mean size, duplicates (files less distinct contents), binaries."""
    size = F.octet_length("text").cast("bigint")
    # by content digest, so that equal texts meet without their texts being shuffled
    per = corpus.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.min(size).alias("low"), F.max(size).alias("high"), F.sum(F.contains("text", F.lit("\0")).cast("bigint")).alias("z"))
    zero = F.lit(0).cast("bigint")
    return per.agg(F.coalesce(F.sum("n"), zero).alias("files"), F.coalesce(F.sum("b"), zero).alias("bytes"), F.coalesce(F.min("low"), zero).alias("min_size"), F.coalesce(F.max("high"), zero).alias("max_size"), F.coalesce(F.sum("b") / F.sum("n"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.sum("n") - F.count(F.lit(1)), zero).alias("duplicates"), F.coalesce(F.sum("z"), zero).alias("binaries"))


SAMPLE_BYTES, SAMPLED_BYTES, MOST_GRAMS = 8 << 10, 128 << 10, 50_000


def sampled_profile(corpus: DataFrame, each: int = SAMPLE_BYTES, total: int = SAMPLED_BYTES, most: int = MOST_GRAMS) -> DataFrame:
    """One row: sampled_bytes, bits (byte entropy) and unique_grams of a sample: the first ``each`` bytes of files in
    the order of file_id, until ``total`` bytes; distinct four-byte strings are counted up to ``most``.

    The limits are the feature: a quick look whose cost doesn't grow.  ``byte_entropy`` and ``qgram_stats`` take all.
    """
    # a file of the sample is in the sample of any part of the corpus that holds it: parts are cut where they are read, then together
    first = _first_bytes(total)
    head = corpus.select("file_id", F.substring(F.col("text").cast("binary"), 1, each).alias("b")).filter(F.octet_length("b") > 0)
    few = head.mapInArrow(first, _HEADS).repartition(SAMPLE_MERGERS).mapInArrow(first, _HEADS)
    row = few.repartition(1).mapInArrow(_profiled(total), "sampled_bytes long, bits double, unique_grams long")
    of = lambda name, zero: F.coalesce(F.max(name), F.lit(zero)).alias(name)
    return row.select("sampled_bytes", "bits", F.least("unique_grams", F.lit(most)).alias("unique_grams")).agg(of("sampled_bytes", 0), of("bits", 0.0), of("unique_grams", 0))


_HEADS = "file_id long, b binary"
#: Tasks among which the samples of all parts are cut once more, so that the last one reads as many at most.
SAMPLE_MERGERS = 32


def _first_bytes(total: int):
    """The first rows by file_id that fill ``total`` bytes, of each task: never more than that and one file are held."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        held, full = None, None  # a table in order; the last file_id once it is full
        for b in batches:
            new = pa.Table.from_batches([b])
            if full is not None:
                new = new.filter(pc.or_kleene(pc.less(new["file_id"], full), pc.is_null(new["file_id"])))
            if not len(new):
                continue
            held = new if held is None else pa.concat_tables([held, new])
            held = held.take(pc.sort_indices(held, [("file_id", "ascending")], null_placement="at_start"))
            before = np.cumsum(pc.binary_length(held["b"]).to_numpy().astype(np.int64))
            n = int(np.searchsorted(before, total)) + 1  # rows with less than total before them
            if n <= len(held):
                held = held.slice(0, n)
                full = held["file_id"][n - 1]
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def _profiled(total: int):
    """sampled_bytes, bits, unique_grams of the first ``total`` bytes of one task's rows."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        texts, left = [], total
        for b in _first_bytes(total)(batches):
            for x in b.column("b").to_pylist():
                texts.append(x[:left])
                left -= len(texts[-1])
        n = sum((np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in texts), np.zeros(256, np.int64))
        n, size = n[n > 0].astype(float), total - left
        bits = float(np.log2(size) - (n * np.log2(n)).sum() / size) if size else 0.0
        grams = len(np.unique(np.concatenate([grams_of(x) for x in texts]))) if texts else 0
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([bits]), pa.array([grams], pa.int64())], ["sampled_bytes", "bits", "unique_grams"])

    return run


def duplicate_files(corpus: DataFrame) -> DataFrame:
    """first (smallest file_id), copies of every content that several files have."""
    return corpus.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("file_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("h")


def percentiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Linear interpolation at rank p (n - 1); exact."""
    return df.groupBy(*by).agg(*(F.percentile(value, F.lit(p)).alias(name) for name, p in at.items()))


def ranked(values: Column, p: float) -> Column:
    """The element at index int(n p) of a sorted array, no interpolation."""
    return F.get(F.sort_array(values), F.least((F.size(values) * p).cast("int"), F.size(values) - 1))


def ranked_of_counts(counts: DataFrame, value: str, n: str, p: float, by: str) -> DataFrame:
    """by, ranked: the same of a table of values with counts, by running sums: no group is an array.

    Values are as few as distinct ones, so the window over a group sorts those and not the rows.
    """
    w = Window.partitionBy(by).orderBy(value)
    run = counts.withColumn("_upto", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(n).over(Window.partitionBy(by)))
    rank = F.least(F.floor(F.col("_all") * p), F.col("_all") - 1)
    return run.filter(F.col("_upto") > rank).groupBy(by).agg(F.min(value).alias("ranked"))


def covered_bytes(ranges: DataFrame, key: str = "file_id") -> DataFrame:
    """key, n: length of the union of [start, end) ranges, by a running maximum of ends."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(w), F.col("start"))))
    return ranges.withColumn("_n", new).groupBy(key).agg(F.sum("_n").cast("bigint").alias("n"))


def merged_ranges(ranges: DataFrame, key: str = "file_id") -> DataFrame:
    """key, start, end: maximal ranges; touching ones become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    past = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce(F.col("start") > past, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("_i", island).groupBy(key, "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


# -- skylines -------------------------------------------------------------------


def within_limits(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    for c, most in limits.items():
        df = df.filter(F.col(c) <= most)
    return df


#: Points that one task compares with each other, and that are broadcast at once.
SKYLINE_BLOCK = 20_000


def pareto_frontier(df: DataFrame, metrics: list[str], block: int = SKYLINE_BLOCK) -> DataFrame:
    """Rows that no other dominates: as low in all ``metrics`` and lower in one.
    Rows with a null or NaN metric are compared with none and left out.

    Distinct points of each partition are thinned to the partition's own skyline
    (a dominated point is dominated by some point of a skyline).  Few that are left
    are compared in one task; many are compared with all of them, a broadcast block
    of at most ``block`` at a time, so no task ever holds them all.
    """
    import numpy as np

    def points(b):
        return np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(metrics))], 1)

    def local(batches):
        import pyarrow as pa

        def batch(x):
            return pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(len(metrics))], metrics)

        held = np.zeros((0, len(metrics)))
        for b in batches:
            new = points(b)
            for part in np.array_split(new, max(1, len(new) // 2000)):
                both = np.unique(np.concatenate([held, part]), axis=0)
                held = both[_undominated(both)]
                if len(held) > block:
                    yield batch(held)  # thinned no further here
                    held = held[:0]
        yield batch(held)

    def against(others):
        def run(batches):
            import pyarrow as pa

            x = others.value
            for b in batches:
                keep = [not ((x <= p).all(1) & (x < p).any(1)).any() for p in points(b)]
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    known = df.filter(" AND ".join(f"`{m}` IS NOT NULL AND NOT isnan(CAST(`{m}` AS DOUBLE))" for m in metrics))
    schema = ", ".join(f"`{m}` double" for m in metrics)
    sky = known.select(*(F.col(f"`{m}`").cast("double").alias(m) for m in metrics)).distinct().mapInArrow(local, schema).persist()
    n = sky.count()
    if n <= block:
        best = sky.coalesce(1).mapInArrow(local, schema)
    else:
        best, parts = sky, -(-n // block)
        numbered = sky.withColumn("_k", F.pmod(F.xxhash64(*(f"`{m}`" for m in metrics)), F.lit(parts))).persist()
        for k in range(parts):
            rows = np.array([tuple(r) for r in numbered.filter(F.col("_k") == k).drop("_k").toLocalIterator()], float).reshape(-1, len(metrics))
            best = best.mapInArrow(against(df.sparkSession.sparkContext.broadcast(rows)), schema)
    return known.join(best.distinct(), [known[m].cast("double").eqNullSafe(best[m]) for m in metrics], "left_semi")


def _undominated(x):
    """Distinct points, sorted by rows: in that order none is dominated by a later one."""
    import numpy as np

    keep: list[int] = []
    for i, p in enumerate(x):
        if not keep or not (x[keep] <= p).all(1).any():
            keep.append(i)
    return np.array(keep, int)


def weighted_choice(df: DataFrame, weights: dict[str, float], base: dict[str, float], name: str) -> DataFrame:
    """One row: the candidate with the least weighted sum of ratios to ``base``; ties by name."""
    total = sum(weights.values()) or 1.0
    loss = F.lit(0.0)
    for c, w in weights.items():
        b = max(base.get(c, 0.0), 0.01) if c == "fallback_rate" else base.get(c, 0.0)
        loss = loss + (w / total) * (F.col(c) / b if b > 0 else F.col(c))
    return df.withColumn("loss", loss).agg(F.min_by(F.col(name), F.struct("loss", name)).alias(name), F.min("loss").alias("loss"))


# -- regret and gates -------------------------------------------------------------

_TINY = 1e-9


def plan_regret(candidates: DataFrame) -> DataFrame:
    """``candidates``: workload_key, semantic_mode, query_name, plan, predicted_cost, actual_cost, chosen, observed, is_fallback.

    Per query the chosen plan against the best of those that were observed.  A
    query has a handful of plans, kept in one array.
    """
    plan = F.struct("actual_cost", F.col("plan").alias("name"), "predicted_cost", "is_fallback")
    seen = F.col("chosen") | F.col("observed")
    g = candidates.groupBy("workload_key", "semantic_mode", "query_name").agg(F.max(F.when(F.col("chosen"), plan)).alias("c"), F.sort_array(F.collect_list(F.when(seen, plan))).alias("o"), F.count(F.lit(1)).alias("candidate_count"))
    best = F.when(F.get("o", F.lit(0))["actual_cost"] < F.col("c.actual_cost"), F.get("o", F.lit(0))).otherwise(F.col("c"))
    g = g.withColumn("b", best)
    inverted = lambda a, b: (((a["predicted_cost"] < b["predicted_cost"]) != (a["actual_cost"] < b["actual_cost"])) & (F.abs(a["predicted_cost"] - b["predicted_cost"]) > 1e-6) & (F.abs(a["actual_cost"] - b["actual_cost"]) > 1e-6)).cast("int")
    pairs = F.aggregate(F.transform("o", lambda a, i: F.aggregate(F.transform("o", lambda b, j: F.when(j > i, inverted(a, b)).otherwise(0)), F.lit(0), lambda s, x: s + x)), F.lit(0), lambda s, x: s + x)
    loss = F.greatest(F.lit(0.0), F.col("c.actual_cost") - F.col("b.actual_cost"))
    return g.select(
        "workload_key", "semantic_mode", "query_name", F.col("c.name").alias("chosen_plan"), F.col("b.name").alias("optimal_plan"),
        F.col("c.predicted_cost").alias("predicted_cost"), F.col("c.actual_cost").alias("actual_cost"), loss.alias("absolute_regret"),
        ((F.col("c.actual_cost") - F.col("b.actual_cost")) / F.greatest(F.col("b.actual_cost"), F.lit(_TINY))).alias("relative_regret"),
        (F.abs(F.col("c.predicted_cost") - F.col("c.actual_cost")) / F.greatest(F.col("c.actual_cost"), F.lit(_TINY))).alias("prediction_error"),
        (loss > 1e-6).alias("is_suboptimal"), F.col("c.is_fallback").alias("is_fallback"), pairs.alias("rank_inversions"), F.size("o").alias("observed_candidate_count"), "candidate_count",
    )


def regret_groups(regrets: DataFrame) -> DataFrame:
    """Per workload and mode: queries, suboptimal ones, mean regret."""
    return regrets.groupBy("workload_key", "semantic_mode").agg(F.count(F.lit(1)).alias("query_count"), F.sum(F.col("is_suboptimal").cast("bigint")).alias("suboptimal_plan_count"), F.avg("relative_regret").alias("mean_regret"))


def regret_report(regrets: DataFrame) -> DataFrame:
    """One row over all queries."""
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return regrets.agg(
        F.count(F.lit(1)).alias("total_queries"), n("is_suboptimal").alias("suboptimal_plan_count"), n("is_fallback").alias("fallback_count"),
        F.avg(F.col("is_fallback").cast("double")).alias("fallback_rate"), F.avg("relative_regret").alias("mean_regret"), F.percentile("relative_regret", F.lit(0.5)).alias("p50_regret"),
        F.percentile("relative_regret", F.lit(0.95)).alias("p95_regret"), F.max("relative_regret").alias("max_regret"), F.percentile("prediction_error", F.lit(0.95)).alias("p95_prediction_error"), F.sum("absolute_regret").alias("total_excess_cost"),
    )


def gate_verdicts(scenarios: DataFrame, t) -> DataFrame:
    """``scenarios``: scenario, correct, search_ms, searches, p50_ms, p95_ms, mb_s, rss_kb, fallback_rate,
    mean_regret and base_search_ms, base_p50_ms, base_p95_ms, base_rss_kb (zero: no baseline).

    Adds ratios, status and classification by the thresholds ``t``: wrong results
    are a rollback; else the worst of all limits that are passed.
    """
    c = F.col
    based = c("base_search_ms") > 0
    ratio = lambda a, b: F.when(based & (c(b) > 0), c(a) / c(b)).otherwise(F.lit(1.0))
    df = scenarios.withColumns({"p50_ratio": ratio("p50_ms", "base_p50_ms"), "p95_ratio": ratio("p95_ms", "base_p95_ms"), "time_ratio": ratio("search_ms", "base_search_ms"), "memory_ratio": F.when(c("rss_kb") > 0, ratio("rss_kb", "base_rss_kb")).otherwise(F.lit(1.0))})
    rollback = ~c("correct") | (c("memory_ratio") > t.rollback_memory) | (c("p95_ratio") > t.rollback_p95) | (c("p50_ratio") > t.rollback_p50) | (c("fallback_rate") > t.rollback_fallback) | (c("mean_regret") > t.rollback_regret)
    fail = (c("p50_ms") > t.p50_ms) | (c("p95_ms") > t.p95_ms) | (c("search_ms") / F.greatest(c("searches"), F.lit(1)) > t.query_ms) | ((c("mb_s") > 0) & (c("mb_s") < t.mb_s))
    fail = fail | (c("memory_ratio") > t.memory) | (c("p95_ratio") > t.p95) | (c("p50_ratio") > t.p50) | (c("time_ratio") > t.time) | (c("fallback_rate") > t.fallback) | (c("mean_regret") > t.regret)
    kind = F.when(~c("correct"), "REGRESSION").when((c("p95_ratio") < 0.95) & (c("p50_ratio") < 0.95), "WIN").when((c("p95_ratio") > 1.05) | (c("p50_ratio") > 1.05), "REGRESSION").otherwise("NEUTRAL")
    return df.withColumn("status", F.when(rollback, "ROLLBACK").when(fail, "FAIL").otherwise("PASS")).withColumn("classification", kind)


def gate_overall(verdicts: DataFrame) -> DataFrame:
    """One row: the worst status and counts of classifications."""
    rank = F.when(F.col("status") == "ROLLBACK", 3).when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    n = lambda k: F.sum((F.col("classification") == k).cast("bigint"))
    out = verdicts.agg(F.max(rank).alias("r"), n("WIN").alias("wins"), n("NEUTRAL").alias("neutral"), n("REGRESSION").alias("regressions"))
    return out.select(F.element_at(F.array(*(F.lit(s) for s in ("PASS", "WARN", "FAIL", "ROLLBACK"))), F.coalesce(F.col("r"), F.lit(0)) + 1).alias("status"), (F.coalesce(F.col("r"), F.lit(0)) < 2).alias("passed"), "wins", "neutral", "regressions")
