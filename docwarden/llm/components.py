"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.durable import written


def _stars(edges: DataFrame) -> bool:
    """Whether every document of the (larger, smaller) links hangs onto one other, which hangs onto none."""
    ends = edges.select(F.col("a").alias("end"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    most = ends.groupBy("end").agg((F.sum("up") + F.max("down")).alias("ways")).agg(F.max("ways")).first()[0]
    return (most or 0) < 2


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (doc_id, component_id) of every document that has a link to another one;
    component_id is the smallest document of its component. Links with a null end are ignored.

    Each round hangs the larger neighbours of a document, then the smaller ones, onto the smallest
    (Kiveris and others, 2014). Neighbour lists are never gathered: a minimum per document is joined
    back to the links, one row per document on that side, so a hub can be split. Links that are stars
    need no round."""
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(root.select("a", F.col("m").alias("b"))).distinct(), "stars")
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
