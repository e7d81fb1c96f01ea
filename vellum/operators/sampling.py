"""Samples that flatten the histogram of their strata."""

from __future__ import annotations

from collections import Counter, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flattened(items: DataFrame, strata: tuple[str, ...], most: int) -> DataFrame:
    """(id, turn) of about ``most`` items: all that have a table and a formula; then those with one of them, from the kind that has fewer so far; then those with text
    alone; then the rest. The next is always the one whose strata have been taken least, by the least id.

    ``items``: id, has_table, has_formula, has_text and the strata. Items of the same kind and strata differ in their ids only, so the driver holds ``most`` ids of each
    such group at most, and counts. Items with both never come to the driver; their turn is 0.
    """
    both, one = F.col("has_table") & F.col("has_formula"), F.when(F.col("has_table"), "table").when(F.col("has_formula"), "formula").when(F.col("has_text"), "text").otherwise("rest")
    kept = items.select("id", F.when(both, "both").otherwise(one).alias("kind"), *strata)
    by = Window.partitionBy("kind", *strata).orderBy("id")
    first = kept.where("kind <> 'both'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    pools: dict[str, dict[tuple, deque]] = {k: {} for k in ("table", "formula", "text", "rest")}
    for r in sorted(first.collect(), key=lambda r: r["id"]):
        pools[r["kind"]].setdefault(tuple(r[s] for s in strata), deque()).append(r["id"])
    taken: Counter = Counter()
    chosen = 0
    for r in kept.where("kind = 'both'").groupBy(*strata).agg(F.count("*").alias("n")).collect():
        chosen += r["n"]
        for k, s in enumerate(strata):
            taken[k, r[s]] += r["n"]
    have = {"table": chosen, "formula": chosen}
    picked: list = []

    def left(*kinds: str) -> bool:
        return any(own for k in kinds for own in pools[k].values())

    def pick(*kinds: str) -> None:
        *_, kind, values = min((sum(taken[x] for x in enumerate(values)), own[0], kind, values) for kind in kinds for values, own in pools[kind].items() if own)
        picked.append(pools[kind][values].popleft())
        taken.update(enumerate(values))

    while chosen + len(picked) < most and left("table", "formula"):
        kind = "table" if left("table") and (not left("formula") or have["table"] <= have["formula"]) else "formula"
        pick(kind)
        have[kind] += 1
    for kinds in (("text",), tuple(pools)):
        while chosen + len(picked) < most and left(*kinds):
            pick(*kinds)
    spark = items.sparkSession
    turns = spark.createDataFrame([(x, k + 1) for k, x in enumerate(picked)], f"id {items.schema['id'].dataType.simpleString()}, turn int")
    return kept.where("kind = 'both'").select("id", F.lit(0).alias("turn")).unionByName(turns)
