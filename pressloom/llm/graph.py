"""Connected components of a graph kept as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import write_and_read


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that is not the smallest of its component, from edges ``a, b`` (longs).

    Alternates large stars and small stars: every node links its greater neighbours, then its smaller ones, to the
    smallest it knows, until only stars are left. Each half round is written (lost executors, short lineage), and a
    neighbour list is never gathered: minima are combined map-side, and the joins with them can be split.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = write_and_read(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write_and_read(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = write_and_read(large.where("a <> b").distinct(), "stars")
        least = write_and_read(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write_and_read(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
