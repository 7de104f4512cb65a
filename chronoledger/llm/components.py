"""Connected components of a distributed edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def _union_find(batches):
    """Edges of one partition to stars around the least member of each of its sets; memory: the partition's nodes."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"a": pa.array([find(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node of ``edges`` (a, b: long): rows (node, component).

    Each partition first contracts its edges by union-find; then rounds of large-star and small-star (each node's
    larger, then smaller neighbours are hung on the least one around) run until nothing changes. Every round is one
    pair of aggregations and joins on nodes and is written to the shared folder; no node's neighbours are collected.
    """
    star = written(edges.select("a", "b").mapInArrow(_union_find, "a long, b long"), "stars")
    while True:
        both = star.select("a", "b").union(star.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        # Large star: hang each larger neighbour of n on the least node around n.
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("m").alias("a"), F.col("b")).where("a <> b").distinct()
        )
        # Small star: hang n and its smaller neighbours on the least of these.
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = (
            large.join(low, F.col("b") == F.col("n"))
            .select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a <> b")
            .distinct()
        )
        new = written(small, "stars")
        # Done when each node hangs on one root and no root hangs on anything.
        loose = new.groupBy("b").agg(F.count("*").alias("c")).where("c > 1").select(F.col("b"))
        deep = new.select(F.col("a").alias("b")).distinct().join(new.select("b").distinct(), "b", "left_semi")
        if not loose.unionByName(deep).take(1):
            return new.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                new.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        star = new
