"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouped minimum, summed up before the shuffle, and a join whose sides Spark can split where a node has very many
links. Steps write their links into the shared folder, so that plans stay short and a lost executor costs one step at most. The
links of a component end as a star around its smallest node. Nothing but a count and a checksum reaches the driver. What a round wrote
is deleted when the next has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import clean, materialise, written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node of a link (u, v) that is not the smallest of its component, and that smallest one.

    Null ends and links of a node with itself link nothing; repeated links count once.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    begun = written()
    links = materialise(links, "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "links")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _state(links)
        clean(spark, begun, keep=1)
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


class Forest:
    """Components among n numbered things within one task; the smallest number is the root."""

    def __init__(self, n: int):
        import numpy as np

        self.root = np.arange(n)

    def link(self, a, b) -> None:
        import numpy as np

        root = self.root
        while len(a):
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = root[root]
                if (jumped == root).all():
                    break
                root[:] = jumped
