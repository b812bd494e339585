"""Connected components of a graph of links: large-star and small-star rounds on DataFrames, nothing on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, tidy

#: Links that one round of the local union-find holds; more are taken in further rounds.
LOCAL_LINKS = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, least node of its tree) of a spanning forest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if not (ra != rb).any():
            break
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _shrinker(*names: str):
    def run(batches):
        yield from _shrink(batches, list(names))

    return run


def _shrink(batches, names: list[str]):
    def out(held):
        u = np.concatenate([b.column(0).to_numpy() for b in held])
        v = np.concatenate([b.column(1).to_numpy() for b in held])
        a, b = _forest(u, v)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL_LINKS:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Gives node, root for each node that has a link to another; root is the least node reachable.

    Null ends and loops are no links. Each partition first keeps only a spanning forest of its links; each round is
    written to the shared folder. A hub's links are never gathered: rounds take minima (combined map-side) and join. Only when at
    most LOCAL_LINKS links are left in all does one task end the work.
    """
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    edges = materialize(links.mapInArrow(tidy(_shrinker("u", "v")), "u long, v long").distinct(), "links")
    spark, before = edges.sparkSession, None
    if edges.count() <= LOCAL_LINKS:  # few enough for one task's union-find: 16 bytes a link
        return materialize(edges.coalesce(1).mapInArrow(tidy(_shrinker("node", "root")), "node long, root long"), "links-small")
    while True:  # a path of n nodes settles in the logarithm of n rounds
        # large star: a node's greater neighbours are linked to its least neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and its lesser neighbours are linked to the least of them; all links point downwards now
        large = materialize(large.distinct(), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, "links-small")
        now = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        release(spark, edges)
        release(spark, large)
        edges = small
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
