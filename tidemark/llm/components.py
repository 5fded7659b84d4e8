"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Links from which on a node may have more neighbours than a task should join.
MANY_LINKS = 50_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a batch by at most one link for each node, to the least node it reaches there."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def connected_components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has a link to another node.

    ``component`` is the least node that can be reached. Links may repeat, point either way or to
    their own node; null ends are no links. Large-star and small-star rounds (Kiveris et al., 2014)
    alternate until the links no longer change; each round's links are checkpointed, and batches of
    links shrink to forests before every shuffle. No round brings the neighbours of one node together
    in a task: they are aggregated, and what a node with very many learns goes to their tasks (``join_hot``).
    """
    e = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    e = cut(e.mapInArrow(_forest, "u long, v long").distinct())
    seen = None
    for _ in range(rounds):
        n = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (n["n"], n["s"]) == seen:
            break
        seen = (n["n"], n["s"])
        if not n["n"]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = n["n"] > MANY_LINKS
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight")).select("u", F.least("u", "m").alias("m"), "weight")
        out = join_hot(both.where("v > u"), cut(least), ["u"], "weight") if many else both.where("v > u").join(least.drop("weight"), "u")
        large = out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large) if many else large
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        below = cut(below) if many else below
        out = join_hot(large, below, ["u"], "weight") if many else large.join(below.drop("weight"), "u")
        small = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", F.col("m").alias("v")))
        e = cut(small.where("u > v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
