"""Connected components of a link table, by contraction: no group, component or link list is ever in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.llm.shared import written


def _flattened(parents: DataFrame) -> DataFrame:
    """``node``, ``root`` from ``node``, ``parent``, where every parent is a node and not larger than its child."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = written(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node that has a link; root is one node of the component, the same for all of it.

    ``links`` has two columns of one ordered type, either way round, repeats and loops allowed; nulls are ignored.
    Each round every node takes its smallest neighbour as parent, the trees are flattened, and each shrinks to its root;
    links between roots remain. A round at least halves the nodes, so there are few. A node with very many links is
    summed before the shuffle when minima are taken, and its joins are plain ones that adaptive execution can split.
    """
    a, b = links.columns
    ways = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))
    both = written(links.filter(F.col(a) != F.col(b)).select(F.inline(ways)).distinct(), "links")
    found = None
    while not both.isEmpty():
        smallest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        roots = _flattened(written(smallest.select("node", F.least("node", "b").alias("parent")), "parents"))
        if found is None:
            found = roots
        else:
            again = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = written(found.join(again, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        between = both.join(of_a, "a").join(of_b, "b").filter("root_a != root_b")
        both = written(between.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
    return links.sparkSession.createDataFrame([], both.select(F.col("a").alias("node"), F.col("b").alias("root")).schema) if found is None else found
