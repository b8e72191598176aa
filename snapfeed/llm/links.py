"""Connected components of a table of links, as DataFrame steps.

Every round each node takes the least label among its neighbours' and its own,
then its label's label (pointer jumping); rounds end when nothing changes. Each
round is stored, so a lost executor costs one round. Labels and links meet in an
equality join whose skewed keys Spark splits (both sides are read from storage);
what goes to a hot node is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the least node."""
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (both.join(small(labels), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        new = (labels.join(near, "node").withColumn("best", F.least("label", "near"))
               .join(small(jump), F.col("best") == F.col("at"), "left")
               .select("node", F.least("best", "far").alias("label"), (F.least("best", "far") != F.col("label")).alias("changed")))
        new = stored(new, "labels")
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels
