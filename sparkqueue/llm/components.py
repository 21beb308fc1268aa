"""Connected components of a link table, by local contraction and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkqueue.llm import common

#: Links that one task contracts; the bound on what it holds.
LINKS_A_TASK = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of some links, ascending, and the least vertex that each reaches."""
    vertices, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = np.split(place, 2)
    label = np.arange(len(vertices))
    while True:
        now = label.copy()
        np.minimum.at(now, a, label[b])
        np.minimum.at(now, b, label[a])
        # What hung on the old label follows it, and then twice as far.
        np.minimum.at(now, label, now.copy())
        now = now[now]
        if np.array_equal(now, label):
            return vertices, vertices[label]
        label = now


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Links with the same components: each task hooks the vertices of its links to their least one."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if held:
            vertex, root = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            hooked = vertex != root
            yield pa.RecordBatch.from_arrays([pa.array(vertex[hooked]), pa.array(root[hooked])], names=["u", "v"])

    return edges.repartition(tasks).mapInArrow(contract, "u long, v long")


def _least(links: DataFrame) -> DataFrame:
    """Each vertex's least neighbour, itself included."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, most_rounds: int = 60, links_a_task: int = LINKS_A_TASK) -> DataFrame:
    """``vertex, component`` for every vertex of ``links`` (columns ``a``, ``b``); the component is its least vertex.

    In each round, tasks of a bounded number of links first contract what they hold. If one task
    held them all, its stars are the components. Else the larger neighbours of each vertex are
    hooked to its least neighbour (large star), then the smaller ones (small star); components of
    n vertices become stars within about log(n)**2 rounds. Every step is written to the shared
    folder, which cuts the lineage. Vertices with very many links are split by adaptive
    execution, as both sides of each join are scans. Links of a vertex with itself are left out.
    """
    edges = common.written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    mark = None
    for _ in range(most_rounds):
        tasks = max(1, -(-edges.count() // links_a_task))
        held, edges = edges, common.written(_contracted(edges, tasks), "edges")
        common.drop_written(held)
        if tasks == 1:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(_least(both), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = common.written(large, "edges")
        common.drop_written(least)
        common.drop_written(edges)
        least = common.written(_least(large), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = common.written(small, "edges")
        common.drop_written(least)
        common.drop_written(large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
    out = common.written(stars, "components")
    common.drop_written(edges)
    return out
