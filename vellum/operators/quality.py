"""Accuracy scores, latency figures and drift of benchmark runs."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as t

# Upper ends of latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0)


def word_scores(pairs: DataFrame) -> DataFrame:
    """(id, expected, actual) to precision, recall and F1 of words as bags, and recall of words as sets. Two texts without words agree."""
    words = lambda c: pairs.select("id", F.explode(t.tokens(F.col(c))).alias("w")).groupBy("id", "w").agg(F.count("*").alias(c))
    joined = words("expected").join(words("actual"), ["id", "w"], "full").na.fill(0, ["expected", "actual"])
    sums = joined.groupBy("id").agg(
        F.sum(F.least("expected", "actual")).alias("both"), F.sum("expected").alias("expected"), F.sum("actual").alias("actual"),
        F.count_if((F.col("expected") > 0) & (F.col("actual") > 0)).alias("set_both"), F.count_if(F.col("expected") > 0).alias("set_expected"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("both"), F.col("actual")), ratio(F.col("both"), F.col("expected"))
    scores = {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "set_recall": ratio(F.col("set_both"), F.col("set_expected"))}
    wordless = F.col("both").isNull()
    return pairs.select("id").join(sums, "id", "left").select("id", *(F.when(wordless, 1.0).otherwise(x).alias(k) for k, x in scores.items()))


#: Code points of pairs of texts that a worker takes at a time.
EDIT_POINTS = 8 << 20


def with_edits(pairs: DataFrame, limit: int = EDIT_POINTS) -> DataFrame:
    """(id, expected, actual) to (id, expected, actual, edits): the code points of both whole texts, and the edits that turn one into the other."""
    rows = pairs.select("id", "expected", "actual", F.char_length("expected").alias("e"), F.char_length("actual").alias("a"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from vellum.functions.edits import edits

        for batch in batches:
            ends = np.cumsum(sum(batch.column(k).fill_null(0).to_numpy().astype(np.int64) for k in (3, 4)))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
                part = batch.slice(at, stop - at)
                found = edits(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.array(found, pa.int32())], ["id", "expected", "actual", "edits"])
                at = stop

    return rows.mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, expected int, actual int, edits int")


def character_error(expected: Column, actual: Column, edits: Column) -> Column:
    """Edits over the expected length, of code points; 0 for two empty texts, 1 for text where none was expected."""
    return F.when(expected == 0, F.when(actual == 0, 0.0).otherwise(1.0)).otherwise(edits / expected)


def overall(edit: Column, teds: Column, cdm: Column) -> Column:
    """A33"""
    return (1 - edit + teds + cdm) / 3 * 100


def aligned_pages(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected pages with the actual ones, whose numbers start at 0 or at 1; missing ones are empty."""
    first = F.min("page").over(Window.partitionBy("doc_id"))
    a = actual.select("doc_id", (F.col("page") - first).alias("page"), F.col("text").alias("actual"))
    e = expected.select("doc_id", (F.col("page") - first).alias("page"), F.col("text").alias("expected"))
    return e.join(a, ["doc_id", "page"], "left").select("doc_id", "page", "expected", F.coalesce("actual", F.lit("")).alias("actual"))


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics of two runs side by side, those of one alone too."""
    return baseline.select("metric", F.col("value").alias("before")).join(candidate.select("metric", F.col("value").alias("after")), "metric", "full").withColumn("change", F.col("after") - F.col("before"))


def percentiles(requests: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), cells: int = 4096) -> DataFrame:
    """The value at place int(n * share) of a key's sorted values; nulls don't count.

    Equal values are counted before the shuffle. A key's values are dealt to cells of equal width, whose counts say in which cell a place lies, and only the
    values of those cells are put in order, each cell by itself. So a key that holds most rows is neither sorted nor gathered in one task.
    """
    counted = requests.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ends = counted.groupBy(key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("_n"))
    cell = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells), F.lit(cells - 1))).otherwise(F.lit(0)).cast("int")
    placed = counted.join(ends, key).select(key, "_v", "_c", "_n", cell.alias("_cell"))
    up_to = Window.partitionBy(key).orderBy("_cell")
    sums = placed.groupBy(key, "_cell").agg(F.sum("_c").alias("_inside"), F.max("_n").alias("_n")).withColumn("_before", F.sum("_inside").over(up_to) - F.col("_inside"))
    wanted = sums.select(key, "_cell", "_before", "_inside", F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), F.floor(F.col("_n") * p).alias("_place")) for k, p in enumerate(shares)))).alias("_w"))
    wanted = wanted.where((F.col("_w._place") >= F.col("_before")) & (F.col("_w._place") < F.col("_before") + F.col("_inside"))).select(key, "_cell", F.col("_w._k").alias("_k"), (F.col("_w._place") - F.col("_before")).alias("_rest"))
    within = Window.partitionBy(key, "_cell").orderBy("_v")
    ranked = placed.join(wanted.select(key, "_cell").distinct(), [key, "_cell"]).withColumn("_last", F.sum("_c").over(within))
    found = ranked.join(wanted, [key, "_cell"]).where((F.col("_rest") >= F.col("_last") - F.col("_c")) & (F.col("_rest") < F.col("_last")))
    return found.groupBy(key).agg(*(F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"p{round(p * 100)}") for k, p in enumerate(shares)))


def route_counters(requests: DataFrame) -> DataFrame:
    """By route, counts by class of status, sums of duration and bytes."""
    s = F.col("status")
    return requests.groupBy("route").agg(
        F.count_if(s.between(200, 299)).alias("ok"), F.count_if(s.between(400, 499)).alias("client_errors"), F.count_if(s >= 500).alias("server_errors"),
        F.count("*").alias("n"), F.sum(F.floor(F.col("duration_s") * 1e6)).alias("micros"), F.sum("bytes").alias("bytes"),
    )


def latency_histogram(requests: DataFrame) -> DataFrame:
    """By route and upper end, how many took no longer; null is the end of all. Counts go through one small aggregate, not one row a bucket and request."""
    bucket = F.lit(len(BUCKETS))
    for k in range(len(BUCKETS) - 1, -1, -1):
        bucket = F.when(F.col("duration_s") <= BUCKETS[k], k).otherwise(bucket)
    counted = requests.groupBy("route", bucket.alias("k")).agg(F.count("*").alias("c"))
    ends = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(BUCKETS[k] if k < len(BUCKETS) else None).cast("double").alias("le")) for k in range(len(BUCKETS) + 1)))
    grid = counted.select("route").distinct().select("route", F.inline(ends))
    by = Window.partitionBy("route").orderBy("k")
    return grid.join(counted, ["route", "k"], "left").select("route", "le", F.sum(F.coalesce("c", F.lit(0))).over(by).alias("n"))


def exposition(counters: DataFrame) -> DataFrame:
    """Counters as lines of text for a scraper."""
    kinds = (("ok", "2xx"), ("client_errors", "4xx"), ("server_errors", "5xx"))
    line = lambda k, name: F.concat(F.lit('requests_total{route="'), F.col("route"), F.lit(f'",status="{name}"}} '), F.col(k).cast("string"))
    return counters.select("route", F.concat_ws("\n", *(line(k, name) for k, name in kinds)).alias("text"))


def sliced_means(scores: DataFrame) -> DataFrame:
    """Means by language, by source and over all, in one pass over grouping sets."""
    sets = scores.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source")
    return sets.agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


#: Ceilings in ms, shares over the baseline, and how many runs that passed make the baseline.
HARD, HALT, ALERT_SHARE, HALT_SHARE, WINDOW = 280.0, 300.0, 1.05, 1.1, 3


def verdict(p50: float | None, err_rate: float | None, passed: list[float], alerts: int) -> tuple[str, int]:
    """The verdict on a run, and how many alerts for drift there are then in a row. The baseline is the median of the last runs that passed."""
    if p50 is None or (err_rate or 0.0) > 0.1:
        return "INFRA", alerts
    base = statistics.median(passed[-WINDOW:]) if passed else None
    if p50 > HALT or base is not None and p50 > HALT_SHARE * base:
        return "HALT", alerts
    if base is None or p50 <= HARD and p50 <= ALERT_SHARE * base:
        return "PASS", 0
    if p50 > HARD:
        return "ALERT", alerts
    return ("ALERT", 1) if alerts < 1 else ("HALT", alerts + 1)


def verdicts(runs: DataFrame) -> DataFrame:
    """(scenario, seq, p50, err_rate) to a verdict for each run, in order.

    A verdict depends on those before it, so runs are read in order, scenario by scenario. What is kept of a scenario is the last runs that passed and a
    count, however long its history.
    """
    ordered = runs.select("scenario", F.col("seq").cast("long").alias("seq"), "p50", "err_rate").repartition("scenario").sortWithinPartitions("scenario", "seq")

    def read(batches):
        import pyarrow as pa

        scenario, passed, alerts = None, [], 0
        for batch in batches:
            out = []
            for name, p50, err_rate in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if name != scenario:
                    scenario, passed, alerts = name, [], 0
                said, alerts = verdict(p50, err_rate, passed, alerts)
                if said == "PASS":
                    passed = [*passed, p50][-WINDOW:]
                out.append(said)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["scenario", "seq", "verdict"])

    return ordered.mapInArrow(read, "scenario string, seq long, verdict string")


def last_passes(runs: DataFrame, judged: DataFrame, keep: int = 2 * WINDOW) -> DataFrame:
    """Of each scenario the last runs that passed, twice the baseline's number: what is kept so that a bad sample can be got over."""
    by = Window.partitionBy("scenario").orderBy(F.desc("seq"))
    passed = judged.where("verdict = 'PASS'").join(runs.select("scenario", F.col("seq").cast("long").alias("seq"), "p50"), ["scenario", "seq"])
    return passed.withColumn("back", F.row_number().over(by)).where(F.col("back") <= keep).select("scenario", "seq", "p50", "back")


def first_of_each(rows: DataFrame, stratum: str, order: tuple[str, ...], most: int) -> DataFrame:
    """The first ``most`` rows of each stratum; Spark cuts each task's rows to as many before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("rank") <= most).drop("rank")
