"""Connected components of a link table, by windows over neighbours: no link or label passes through the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stateweave.llm.common import staged

#: Links that a task contracts at a time.
CONTRACTED = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b: long) the smallest node it can reach.

    Small-star and large-star steps alternate.  A round hooks a node's larger
    neighbours to its smallest one, so the paths shorten geometrically.  The
    first step keeps one link of a node, the rest are links between its smaller
    neighbours, of which a dense group has few; tasks that read these contract
    them to spanning stars, which join the same nodes by fewer links.  The
    search ends as soon as every node leads to a root.  Every step is a written
    table of its own: a lost executor costs one step, and no plan holds another
    step's.  A hot node only ever sends its neighbours one row each.  Null nodes
    and self links are left out; repeated links count once.
    """
    sound = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    # The nodes of a dense group send the same links between their smaller neighbours.
    edges = staged(_star(sound.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), large=False).distinct(), "links")
    while not _settled(edges):
        larger = staged(_star(edges, large=True), "larger")
        # Files are read many to a task, so these hold more links of a component than the tasks that wrote them.
        edges = staged(_star(_contracted(larger), large=False), "stars")
    # Every edge now leads from a node to the root of its component; several nodes may have sent the same one.
    return edges.union(edges.select("b", "b")).distinct().toDF("node", "component")


def _settled(edges: DataFrame) -> bool:
    """Whether each node either leads to one other node, or others lead to it."""
    ends = edges.select("a", "b", F.lit(False).alias("led_to")).union(edges.select("b", F.lit(None).cast("long"), F.lit(True)))
    nodes = ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.max("led_to").alias("led_to"))
    return nodes.where("low <> high OR low IS NOT NULL AND led_to").isEmpty()


def _contract(batches):
    """Stars that connect what some links connect, each node to the least of its part."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CONTRACTED:
            yield _stars(held)
            held, rows = [], 0
    if held:
        yield _stars(held)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([x.column(c).to_numpy() for x in batches]) for c in ("a", "b"))
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    left, right = places[: len(a)], places[len(a) :]
    while len(left):
        # Roots hook to the least root they meet, then every path is cut short.
        low, high = np.minimum(parent[left], parent[right]), np.maximum(parent[left], parent[right])
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        differ = parent[left] != parent[right]
        left, right = left[differ], right[differ]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved], pa.int64()), pa.array(nodes[parent[moved]], pa.int64())], names=["a", "b"])


def _contracted(links: DataFrame) -> DataFrame:
    return links.mapInArrow(_contract, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link each larger neighbour to the least of the neighbourhood; small: each smaller one.

    Rows (a, b), a > b, are what comes in and goes out.
    """
    seen = edges.union(edges.select("b", "a")) if large else edges
    # One exchange and no join: a node's neighbours lie sorted in a task that writes to disk what its memory does not hold.
    joined = seen.select("a", "b", F.least("a", F.min("b").over(Window.partitionBy("a"))).alias("m"))
    if large:
        # A node with no larger neighbour keeps its link to the least.
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # The node itself takes the place of its least neighbour, which needs no link to itself.
    return joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
