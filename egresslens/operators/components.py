"""Connected parts of a graph given by its edges."""

from pyspark.sql import DataFrame, functions as F

from egresslens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, from edges (a, b); root is the smallest node of its part.

    Large-star and small-star rounds in turn; the number of rounds grows with the logarithm of the size.
    """
    def star(edges: DataFrame) -> DataFrame:
        ways = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u > v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        return (large.join(lowest, "u").select(F.explode(F.array(
            F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("a"), F.col("e.m").alias("b")).filter("a > b").distinct())

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(edges)
    while True:
        edges = materialize(star(edges), "stars")
        now = mark(edges)
        if now == seen:
            return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
                    .union(edges.select("b", "b")).distinct())
        seen = now


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Add the ``root`` of ``node``; a node without a link is its own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
