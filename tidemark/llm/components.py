"""Connected components of links between whole-number nodes.

Each task first brings its own links to stars with a union-find, which keeps no
more than LOCAL links at a time. Where one such pass has seen all links, that is
the result; else large and small stars join what the passes found, round by
round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Links that one union-find holds.
LOCAL = 1_000_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links but the roots, and its component's least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    root = np.fromiter((find(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forests(batches):
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= LOCAL:
            yield _stars(held)
            held, n = [], 0
    if n:
        yield _stars(held)


def _stars(held) -> pa.RecordBatch:
    u, v = _forest(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step; links run from the higher node u to the lower v."""
    both = links if not large else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if large:  # higher neighbours move to the least node that u knows
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = least.where("m < u").select("u", F.col("m").alias("v"))
        return moved.unionByName(kept).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60, local: int = LOCAL, put: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of a link; root is the least node of its component.

    ``links`` has columns u and v; self links and repeats do no harm, nulls are
    left out. An empty table gives an empty one. Rounds grow with the logarithm
    of a component's width; each is written to the shared folder.
    """
    links = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    put = put or Scratch()
    links = put(links)
    for _ in range(most_rounds):
        n = links.count()
        tasks = max(1, -(-n // local))
        after = links.coalesce(tasks).mapInArrow(_forests, "u long, v long")
        if tasks > 1:
            after = _star(_star(after, True), False)
        after = put(after)
        put.drop(links)
        links = after
        if tasks == 1 or _settled(links):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: each node has one root, and no root is a node with a root."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("root").alias("root")).where("low > 1 or low > 0 and root > 0").isEmpty()
