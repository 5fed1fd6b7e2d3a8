"""Connected components of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.llm.work import settle


def components(links: DataFrame) -> DataFrame:
    """id, root for every end of the links (a, b); the root is the smallest id of the component.

    Each round takes the smallest root of all neighbours and then the root of that root, so chains are halved. Rounds end
    when no root changes; every round is written to the shared folder.
    """
    both = settle(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    roots = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("near"))
        pulled = roots.join(near, roots.id == near.a).select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        pulled = settle(pulled, "roots-pulled")
        above = pulled.select(F.col("id").alias("above"), F.col("root").alias("top"))
        jumped = pulled.join(above, pulled.root == above.above).select("id", "old", F.least("root", "top").alias("root"))
        jumped = settle(jumped, "roots-jumped")
        roots = jumped.select("id", "root")
        if jumped.where("old <> root").isEmpty():
            return roots
