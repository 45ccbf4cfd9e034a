"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(key, root) of every key in links (a, b); root is the smallest key of its component.

    Each round takes the smallest root among neighbours, then the root of that root, so
    the number of rounds grows with the logarithm of the longest path. Everything stays in
    tables; a key with very many links is an aggregation with partial sums and a join
    against one row.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    root = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("root")), "root")
    while True:
        near = edges.join(root.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = root.join(near, root["key"] == near["a"]).select("key", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        jump = lower.select(F.col("key").alias("to"), F.col("to").alias("then"))
        after = cut(lower.join(jump, "to").select("key", "was", F.col("then").alias("root")), "root")
        if after.where("root <> was").isEmpty():
            return after.select("key", "root")
        root = after.select("key", "root")
