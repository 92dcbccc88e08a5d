"""Connected components by repeated contraction, on tables only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, meet

#: Links (two numbers each) that one task finishes at most; more are contracted first.
LOCAL = 200_000


def smallest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links and the smallest node of each one's component: roots join smaller roots until no link lies between two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while (after[after] != after).any():
            after = after[after]
        root = after
    return nodes, nodes[root]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, roots = smallest_of(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.record_batch([pa.array(nodes), pa.array(roots)], names=["a", "to"])


def connected_components(staging: Staging, edges: DataFrame, local: int | None = None) -> DataFrame:
    """edges: u long, v long (staged, or cheap to count). Returns node long, component long (its smallest node) for every node that has an edge.

    Each round every node joins its smallest neighbour's smallest neighbour (smallest by hashed number, so that chains shrink by a constant
    factor in the mean), and the edges are rewritten between the nodes that are left. Nodes with very many neighbours only
    meet map-side minima and joins that adaptive execution can split. Each round's tables are written, so lineage stays short.
    Once at most ``LOCAL`` links are left, one task finishes them.
    """
    local = LOCAL if local is None else local
    pairs = edges.where("u <> v AND u IS NOT NULL AND v IS NOT NULL").select(F.xxhash64("u").alias("a"), F.xxhash64("v").alias("b"), "u", "v")
    staged = staging.put(pairs.distinct(), "edges", edges.count())
    n = rows = staged.count()
    names = staged.select(F.col("a").alias("key"), F.col("u").alias("node")).union(staged.select("b", "v")).distinct()
    names, now, steps = staging.put(names, "names", 2 * rows), staged.select("a", "b").where("a <> b"), []
    while n:
        if n <= local:
            step = staging.put(now.coalesce(1).mapInArrow(_finish, "a long, to long"), "step")
            n = 0
        else:
            both = now.union(now.select("b", "a"))
            hop = staging.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "hop", 2 * n)
            # the smallest neighbour's own smallest neighbour: two hops a round; every "to" is itself a node of hop
            step = staging.put(meet(hop, hop.select(F.col("a").alias("to"), F.col("to").alias("root")), "to").select("a", F.col("root").alias("to")), "step", 2 * n)
            left = meet(now, step.select("a", F.col("to").alias("ta")), "a")
            moved = meet(left, step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
            after = staging.put(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links", n)
            staging.drop(hop, now)
            now, n = after, after.count()
        steps.append(step)
    labelled = names.withColumn("label", F.col("key"))
    for step in steps:
        labelled = meet(labelled, step.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labelled = staging.put(labelled.select("node", "label"), "labels", 2 * rows)
    smallest = staging.put(labelled.groupBy("label").agg(F.min("node").alias("component")), "smallest", 2 * rows)
    out = staging.put(meet(labelled, smallest, "label").select("node", "component"), "components", 2 * rows)
    staging.drop(staged, names, now, labelled, smallest, *steps)
    return out
