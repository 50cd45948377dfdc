"""Connected components of a large edge list by alternating star contractions.

Every vertex is linked to the smallest vertex it knows, first from its larger then from its
smaller neighbours, until all edges are stars; the number of rounds grows with the logarithm of
the longest chain.  Each round is one written table in the shared work folder, so a lost
executor costs at most one round, and no vertex, edge or component reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import fresh_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared work folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    moved = down.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no ``b`` has two ``a`` or is an ``a`` itself."""
    ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("a").alias("v"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    met = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not met.agg(F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))).first()[0]


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Columns ``a``, ``b`` (linked vertices) to ``node``, ``component`` of every vertex met.

    ``component`` is the smallest vertex reachable.  Loops and repeated links are allowed;
    vertices without a link to another one do not appear.
    """
    state = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    while not _settled(state):
        state = stored(_small_star(_large_star(state)), label)
    members = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")
