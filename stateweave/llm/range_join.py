"""Embedding near-duplicates: an exact metric range join over the cells of pivots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stateweave.llm.common import staged
from stateweave.llm.components import components

#: Pivots a label has at most, the vectors one cell aims at, and one task's share of a side.
PIVOTS, CELL, BLOCK = 64, 2048, 2048
#: Labels that get pivots, the largest first: PIVOTS * LABELS vectors are broadcast at most. Other labels are one cell each, joined in blocks.
LABELS = 512
#: Room for rounding in the triangle inequality; it only ever adds replicas.
SLACK = 1e-9


def near_vectors(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Unit vectors of one label link at euclidean distance sqrt(2 - 2 cosine) or
    less.  A bounded sample of each label gives its pivots; a vector's home is
    its nearest pivot's cell.  With r the radius, a vector also visits each cell
    i for which (d_i^2 - d_home^2) / (2 d(p_i, p_home)) <= r: by the triangle
    inequality no link of a cell's own vectors lies elsewhere.  Cells are then
    joined independently, a crowded one in blocks of ``block`` by ``block``
    vectors.  A link is counted where its first end is at home, so counts add
    up; of the links themselves each block passes on a spanning forest only.

    Equal vectors of a label are joined once and counted with their number.
    A null label, and a vector that is null, empty, zero or holds null or
    non-finite components, links with nothing.  Vectors of other lengths link
    among themselves only.  Each input row gives a row; rows that share a
    vec_id are vectors of their own with one component.  A null vec_id counts
    as a vector and gets no component.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    base = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    rows = base.select("vec_id", "label", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v")).withColumn("dims", F.size("v"))
    # Equal vectors are one point with a weight; its number follows from its values, so it is the same on any run.
    points = staged(
        rows.where("v IS NOT NULL")
        .groupBy("label", "dims", "v")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
        .withColumn("point", F.xxhash64("label", "v")),
        "points",
    )
    large = points.groupBy("label", "dims").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    sizes = {(r["label"], r["dims"]): r["n"] for r in large.orderBy(F.desc("n"), "label", "dims").limit(LABELS).collect()}
    pivots = _pivots(points, sizes, cell)
    placed = staged(_place(points, vectors.sparkSession.sparkContext.broadcast(pivots), radius), "cells")
    found = staged(_join_cells(placed, cosine, block), "links")
    counts = found.where("other IS NULL").groupBy("label", "dims", "point").agg(F.sum("n").alias("n"))
    # Points are linked by the least vec_id of their copies, copies to it as well.
    named = points.select("label", "dims", "v", "point", "first", "weight")
    ends = points.select("label", "dims", "point", "first")
    links = (
        found.where("other IS NOT NULL")
        .join(ends, ["label", "dims", "point"])
        .join(ends.select("label", "dims", F.col("point").alias("other"), F.col("first").alias("second")), ["label", "dims", "other"])
        .select(F.col("first").alias("a"), F.col("second").alias("b"))
    )
    of = named.join(counts, ["label", "dims", "point"], "left").select("label", "dims", "v", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    joined = staged(rows.join(of, ["label", "dims", "v"], "left").select("vec_id", F.coalesce("first", "vec_id").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "rows")
    # All copies of a vec_id stand for one node.
    roots = components(links.union(joined.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))))
    return (
        joined.join(roots, joined["vec_id"] == roots["node"], "left")
        .select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _pivots(points: DataFrame, sizes: dict, cell: int) -> dict:
    """Pivots of each label: of those with the least hashes, spread out by farthest-point choice."""
    wanted = {key: min(PIVOTS, -(-n // cell)) for key, n in sizes.items()}
    if not wanted:
        return {}
    # About 16 candidates a pivot, by hash: a sample whose size does not grow with the table.
    spark = points.sparkSession
    share = spark.createDataFrame([(*key, min(1.0, 16 * wanted[key] / n)) for key, n in sizes.items()], "label " + points.schema["label"].dataType.simpleString() + ", dims int, share double")
    taken = (
        points.join(F.broadcast(share), ["label", "dims"])
        .where(F.pmod(F.xxhash64("point", F.lit(7)), F.lit(1 << 20)) <= F.col("share") * (1 << 20))
        .select("label", "dims", "v")
        .orderBy("label", "dims", "v")
        .collect()
    )
    sample: dict = {}
    for r in taken:
        sample.setdefault((r["label"], r["dims"]), []).append(r["v"])
    out = {}
    for key, n in wanted.items():
        unit = _unit(np.array(sample.get(key) or [[1.0] + [0.0] * (key[1] - 1)]))
        chosen, far = [0], np.full(len(unit), np.inf)
        while len(chosen) < min(n, len(unit)):
            far = np.minimum(far, 2 - 2 * unit @ unit[chosen[-1]])
            if far.max() < 1e-6:
                break
            chosen.append(int(far.argmax()))
        out[key] = unit[chosen]
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _place(points: DataFrame, pivots, radius: float) -> DataFrame:
    """A row for each cell that a point visits; ``home`` tells its own."""

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dims").to_pylist()))
            v = batch.column("v").to_pylist()
            take, cells, homes = [], [], []
            for key in set(keys):
                own = [i for i, k in enumerate(keys) if k == key]
                p = pivots.value.get(key)
                if p is None:
                    take, cells, homes = take + own, cells + [0] * len(own), homes + [True] * len(own)
                    continue
                square = np.maximum(0, 2 - 2 * _unit(np.array([v[i] for i in own])) @ p.T)
                home = square.argmin(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                line = np.arange(len(own))
                visits = square - square[line, home][:, None] <= 2 * radius * apart + SLACK
                visits[line, home] = True
                at, where = np.nonzero(visits)
                take += [own[i] for i in at]
                cells += where.tolist()
                homes += (where == home[at]).tolist()
            kept = batch.select(["label", "dims", "point", "weight", "v"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells, pa.int32()), pa.array(homes, pa.bool_())], names=[*kept.schema.names, "cell", "home"])

    kind = points.schema["label"].dataType.simpleString()
    return points.mapInArrow(run, f"label {kind}, dims int, point long, weight long, v array<double>, cell int, home boolean")


def _join_cells(placed: DataFrame, cosine: float, block: int) -> DataFrame:
    """(point, other null, n) counts of links, and (point, other) links that span what is connected."""
    cell = ["label", "dims", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.ceil(F.count("*") / block).cast("int").alias("n_all"), F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / block)).cast("int").alias("n_home")
    )
    held = placed.join(sizes, cell)
    part = lambda n: F.pmod(F.col("point"), F.col(n)).cast("int")
    left = held.where("home").withColumn("i", part("n_home")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    right = held.withColumn("j", part("n_all")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_home") - 1)))
    columns = [*cell, "i", "j", "point", "weight", "v"]
    both = left.select(*columns, F.lit(True).alias("mine")).union(right.select(*columns, F.lit(False).alias("mine")))
    kind = placed.schema["label"].dataType.simpleString()
    key = [*cell, "i", "j"]
    return both.groupBy(*key).applyInArrow(lambda k, t: _join_block(k, t, cosine), f"label {kind}, dims int, point long, other long, n long")


def _join_block(key: tuple, table: pa.Table, cosine: float) -> pa.Table:
    mine = table.column("mine").to_numpy()
    point, weight = table.column("point").to_numpy(), table.column("weight").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(mine), -1)
    unit = _unit(flat)
    at, to = np.flatnonzero(mine), np.flatnonzero(~mine)
    n, links = np.zeros(len(at), np.int64), []
    parent = {int(p): int(p) for p in point}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a in range(0, len(at), 512):
        rows = at[a : a + 512]
        near = (unit[rows] @ unit[to].T >= cosine) & (point[rows][:, None] != point[to][None, :])
        n[a : a + 512] = near @ weight[to]
        for i, line in zip(rows, near):
            x = int(point[i])
            for y in point[to[np.flatnonzero(line)]].tolist():
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[rx] = ry
                    links.append((x, y))
    label, dims = key[0], key[1]
    left = [*point[at].tolist(), *(x for x, _ in links)]
    other = [None] * len(at) + [y for _, y in links]
    return pa.table(
        {
            "label": pa.array([label.as_py()] * len(left), table.schema.field("label").type),
            "dims": pa.array([dims.as_py()] * len(left), pa.int32()),
            "point": pa.array(left, pa.int64()),
            "other": pa.array(other, pa.int64()),
            "n": pa.array([*n.tolist(), *[None] * len(links)], pa.int64()),
        }
    )
