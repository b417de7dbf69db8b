"""Connected components by union-find in each partition, then star contraction between partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


class UnionFind:
    """Sets of ids whose root is their smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


#: Ids that a task's union-find holds before it gives its stars and begins anew.
MOST_IDS = 1 << 19


def _stars(sets: UnionFind) -> Iterator[pa.RecordBatch]:
    pairs = [(x, root) for x in sets.parent if (root := sets.find(x)) != x]
    for i in range(0, len(pairs), 50_000):
        u, v = zip(*pairs[i : i + 50_000], strict=True)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars for the components of this partition's edges, MOST_IDS ids at a time; edges that tie two of them follow later."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > MOST_IDS:
            yield from _stars(sets)
            sets = UnionFind()
    yield from _stars(sets)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every smaller neighbour, and the node itself, moves to the smallest neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v: long), component being its smallest node.

    Self-loops and repeated edges are allowed, null ends are ignored. The hot node of a large star is only
    pre-aggregated (min) and joined, which adaptive execution can split; no component is gathered anywhere.
    Every round is written to the shared folder."""
    clean = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    now = cut(clean.mapInArrow(_local_stars, "u long, v long"))
    state = None
    for _ in range(max_rounds):
        new = cut(_small_star(_large_star(now)))
        drop_cut(now)
        now = new
        got = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(got) == state:
            break
        state = tuple(got)
    else:
        raise RuntimeError("connected_components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components_in_memory(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of n positions, for a bounded block."""
    sets = UnionFind()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        sets.union(x, y)
    return np.fromiter((sets.find(i) for i in range(n)), np.int64, n)
