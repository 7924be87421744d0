"""Connected components of a link table, by rounds of joins whose results are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.session import materialize


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for the ends of links a, b (whole numbers, not null).

    Every round takes the smallest label of the neighbours and then follows labels of labels, so long chains close in
    a logarithmic number of rounds. Labels are combined before they are shuffled; joins on a hub are plain equi-joins
    that adaptive execution can split. ``files`` is the number of files of a written table, for links that are known
    to be few.
    """
    written = lambda df, name: materialize(df.repartition(files) if files else df, name)
    ends = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "ends")
    labels = written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (ends.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = written(hooked.join(up, "component").select("node", F.col("up").alias("component"), "before"), "jumped")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> before").isEmpty():
            return labels
