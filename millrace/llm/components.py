"""Distributed connected components by repeated contraction.

Every round, each vertex points to its smallest neighbour if that is smaller
than itself. Pointers lead downwards, so they form trees; pointer doubling finds
the roots. The edges are then carried to the roots, loops and repeats go, and
the rest is the next round's graph. Each vertex that still has an edge either
points down or is pointed to, so every round halves the vertices at least.

Hubs: minima are aggregates with partial sums on the map side; pointers are joined
from written tables, so that Spark can split a hot key's partition.
Nothing is collected but the number of edges that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, scratch


def _root_pointers(edges: DataFrame, n: int) -> DataFrame:
    """(v, p) for the vertices of the ``n`` ``edges`` (a, b): p is the root of v's tree."""
    both = edges.union(edges.select("b", "a")).toDF("v", "n")
    pointers = both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("p"))
    with scratch() as keep:
        while True:
            pointers = materialize(pointers, "pointers", 2 * n)
            up = pointers.where("v <> p").select(F.col("v").alias("p"), F.col("p").alias("pp"))
            if not pointers.join(up, "p", "left_semi").limit(1).count():
                return keep(pointers)
            pointers = pointers.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(v, root) for every vertex of the undirected ``edges`` (a, b), as a written table.

    ``root`` is one vertex of the component, the same for all its members. Ids may
    be of any type with an order; null ids, loops and repeated edges are dropped.
    No edges give no rows. ``most`` may bound the number of edges.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with scratch() as keep:
        edges = materialize(edges, "edges", most)
        labels, vertices = None, 0
        while n := edges.count():  # from the files' footers
            pointers = _root_pointers(edges, n)
            if labels is None:
                labels, vertices = materialize(pointers.select("v", F.col("p").alias("root")), "labels", 2 * n), 2 * n
            else:
                up = pointers.select(F.col("v").alias("root"), "p")
                labels = materialize(labels.join(up, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels", vertices)
            to_a = pointers.select(F.col("v").alias("a"), F.col("p").alias("x"))
            to_b = pointers.select(F.col("v").alias("b"), F.col("p").alias("y"))
            moved = edges.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            edges = materialize(moved, "edges", n)
        return keep(materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("root")), "labels", 0) if labels is None else labels)
