"""Connected components by rounds of local contraction; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (u long, v long); root is one vertex of its component.

    In a round each vertex takes the name of the vertex of least hash among itself and its neighbours, and links are
    renamed; vertices joined stay joined. Links left shrink geometrically; least values are found with map-side
    combining, so a vertex with very many links is no hot spot. Links of a vertex with itself are ignored.
    """
    links = written(_tidy(links.select("u", "v")), "links")
    named: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        name = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["x"].alias("to"))
        name = written(name, "names")
        if named is None:
            named = name.select(F.col("u").alias("v"), F.col("to").alias("root"))
        else:
            later = name.select(F.col("u").alias("root"), "to")
            named = named.join(later, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
        one = links.join(name, "u").select(F.col("to").alias("a"), "v")
        two = one.join(name.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("to").alias("v"))
        links = written(_tidy(two), "links")
    if named is None:
        return links.select("v", F.col("u").alias("root"))
    return named


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
