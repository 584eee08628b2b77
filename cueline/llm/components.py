"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged


def components(links: DataFrame) -> Staged:
    """(node, comp) for each node of the links (a, b): comp is the least node that links lead to.

    Every round a node takes the least label among its neighbours, then its label's label, so chains shorten by
    half or more; rounds end when no label changes. Each round is a staged table.
    """
    both = Staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = Staged(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        old = labels.df
        near = both.df.join(old.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = old.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = old.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = new.join(jump, "comp").select("node", "was", F.least("comp", "root").alias("comp"))
        done, labels = labels, Staged(new, "labels")
        done.drop()
        if labels.df.filter("comp <> was").isEmpty():
            both.drop()
            labels.df = labels.df.select("node", "comp")
            return labels
