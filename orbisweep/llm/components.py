"""Connected components by contraction, on tables only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Edges that a task combines at once.
EDGES = 1 << 20


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every `EDGES` edges of a task: each node with the smallest one it is connected to by them."""
    def stars(ends: list[np.ndarray]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        x, y = at.reshape(2, -1)
        label = np.arange(len(nodes))
        while True:
            low, new = np.minimum(label[x], label[y]), label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["a", "b"])

    waiting, held = [], 0
    for batch in batches:
        waiting.append(np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("a", "b")]))
        held += batch.num_rows
        if held >= EDGES:
            yield stars(waiting)
            waiting, held = [], 0
    if held:
        yield stars(waiting)


def components(edges: DataFrame, combine: bool = False) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b); component is one of its nodes.

    Each round maps every node to the smallest of itself and its neighbours and contracts the edges; node numbers
    should be hashes, so that chains shrink by a constant factor a round. Rounds end when no edge is left;
    their maps are then applied one after the other. Each round is written to the shared folder.

    With `combine`, tasks first replace the edges they hold by stars, so that little is left for the rounds; edges are
    packed into tasks of about `EDGES`.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    if combine:
        given = materialize(edges.select("a", "b").where("a <> b"), "given")
        edges = given.coalesce(-(-given.count() // EDGES) or 1).mapInArrow(_combined, "a long, b long")
    left = materialize(tidy(edges.select("a", "b")), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "hop")
        maps.append(to)
        a, b = to.toDF("a", "x"), to.toDF("b", "y")
        left = materialize(tidy(left.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = maps[0]
    for to in maps[1:]:
        step = to.toDF("component", "next")
        out = materialize(out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
    return out
