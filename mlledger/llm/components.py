"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mlledger.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for links a, b.

    Alternates two kinds of steps, each of which hangs a node's neighbours to the smallest of them:
    first the larger neighbours, then the smaller ones. Both keep the components and end in stars
    after a number of steps that grows with the logarithm of the table. A step only takes minima
    (combined before the shuffle) and joins them back, so a node with very many links is no group
    that a task must hold. The minima are written first: a join that isn't tied to the layout of
    the groups lets Spark split the partition of such a node. Links to itself and nulls are left
    out.
    """
    edges = stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "components",
    )
    print_of = F.count("*"), F.bit_xor(F.xxhash64("u", "v"))
    before = edges.agg(*print_of).first()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = stored(least, "components")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        lowest = stored(down.groupBy("u").agg(F.min("v").alias("m")), "components")
        small = (
            down.join(lowest, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v")
        )
        edges = stored(small.filter("u <> v").distinct(), "components")
        after = edges.agg(*print_of).first()
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
