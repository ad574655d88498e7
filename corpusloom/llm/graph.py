"""Connected components in few shuffles: any part of the edges may be contracted to stars by itself, without changing what is connected."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, small

#: Edges that a task contracts at once.
CHUNK = 500_000
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) but the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield _stars_of(held)
            held = []
    if held:
        yield _stars_of(held)


def _stars_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(n).to_numpy() for b in held]) for n in ("u", "v"))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(u, v)], schema=_EDGES)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of each node of edges (a, b), which are longs, label being the least node of its component; a table that scratch can drop.

    In a round each task contracts what it reads, then what it gets by the larger end; so a node with very many neighbours comes once from each task.
    Then each end that is no root gives way to its own least neighbour. Rounds end when all edges lead to roots.
    """
    now = edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    before: list[DataFrame] = []
    while True:
        once = now.mapInArrow(_contracted, "u long, v long").repartition("u").mapInArrow(_contracted, "u long, v long")
        now = scratch.cut(once, "edges")
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("lower"), F.lit(False).alias("met"))
        ends = ends.union(now.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("lower"), F.lit(True).alias("met")))
        nodes = ends.groupBy("node").agg(F.min("lower").alias("lo"), F.max("lower").alias("hi"), F.max("met").alias("met"))
        nodes = nodes.select("node", F.coalesce("lo", "node").alias("label"), F.expr("lo is not null and met").alias("between"), F.expr("coalesce(lo < hi, false)").alias("forked"))
        nodes = scratch.cut(nodes, "nodes")
        scratch.drop(*before)
        if nodes.filter("between or forked").limit(1).count() == 0:
            scratch.drop(now)
            out = nodes.select("node", "label")
            out._scratch_path = nodes._scratch_path
            return out
        before = [now, nodes]
        up = small(nodes.filter("between").select(F.col("node").alias("v"), F.col("label").alias("upper")))
        now = now.join(up, "v", "left").select("u", F.coalesce("upper", "v").alias("v"))
