"""Connected components of a graph of links, as a Spark loop of large-star and small-star steps.

Each step is one shuffle of edges by node and one pass over sorted rows, which sees a node's smallest
neighbour first and so keeps no group. Behind it, each task contracts what edges it has to stars, so that few rounds
are needed and no node keeps more smaller neighbours than there are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import cut, delete_tables, tables_written
from llm.vectext import distinct
from llm.worker import drop_tool, give_back

#: Edges that a task contracts at once.
CHUNK = 2_000_000
#: A node with more larger neighbours than this, and than a thousandth of all edges, is dealt over SALTS tasks: a thousand
#: nodes at most.
HOT_EDGES, SALTS = 100_000, 64
_EDGES = "u long, v long"


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: each node but the smallest of its component, and that smallest one."""
    nodes = distinct(np.concatenate((u, v)))
    a, b = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])  # a root hangs below the smallest root that it meets
        while True:
            above = label[label]
            if (above == label).all():
                break
            label = above
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[below], nodes[label[below]]


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _contracted(parts: Iterator[tuple[np.ndarray, np.ndarray]], chunk: int) -> Iterator[pa.RecordBatch]:
    """Edges of a task, some at a time, as stars."""
    us, vs, held = [], [], 0
    for u, v in parts:
        us.append(u)
        vs.append(v)
        held += len(u)
        if held >= chunk:
            yield _edges(*stars(np.concatenate(us), np.concatenate(vs)))
            us, vs, held = [], [], 0
    if held:
        yield _edges(*stars(np.concatenate(us), np.concatenate(vs)))
    give_back()


def _starred(batches: Iterator[pa.RecordBatch], large: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Over rows sorted by node x (and salt) and neighbour y: x and its neighbours, in a large star the larger ones only,
    each tied to the smallest of them all."""
    last, low = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x, salt, y = (batch.column(c).to_numpy() for c in ("x", "salt", "y"))
        head = np.ones(len(x), dtype=bool)
        head[1:] = (x[1:] != x[:-1]) | (salt[1:] != salt[:-1])
        first = np.flatnonzero(head)
        least = np.minimum(x[first], y[first])
        if last == (x[0], salt[0]):
            least[0] = low
        least = np.repeat(least, np.diff(np.concatenate((first, [len(x)]))))
        last, low = (x[-1], salt[-1]), least[-1]
        tied = (y > x) if large else (y != least)
        own = head & (x != least)
        yield np.concatenate((y[tied], x[own])), np.concatenate((least[tied], least[own]))


def _first(edges: DataFrame, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tool()
        yield from _contracted(((b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows), chunk)

    return edges.mapInArrow(run, _EDGES)


def _step(rows: DataFrame, large: bool, chunk: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tool()
        yield from _contracted(_starred(batches, large), chunk)

    return rows.repartition("x", "salt").sortWithinPartitions("x", "salt", "y").mapInArrow(run, _EDGES)


def _large_star(edges: DataFrame, chunk: int) -> DataFrame:
    total = edges.count()
    counts = edges.groupBy("v").count().where(F.col("count") > max(HOT_EDGES, total // 1000))
    hot = [r["v"] for r in counts.select("v").collect()]  # a thousand at most
    # Both directions. A hot node's larger neighbours are dealt over the salts; its few smaller ones go to each.
    up = edges.select(F.col("v").alias("x"), F.when(F.col("v").isin(hot), F.pmod(F.xxhash64("u"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.col("u").alias("y"))
    salts = F.when(F.col("u").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    down = edges.select(F.col("u").alias("x"), F.explode(salts).alias("salt"), F.col("v").alias("y"))
    return _step(up.unionAll(down), True, chunk)


def _small_star(edges: DataFrame, chunk: int) -> DataFrame:
    return _step(edges.select(F.col("u").alias("x"), F.lit(0).alias("salt"), F.col("v").alias("y")), False, chunk)


def connected(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node and component (its smallest reachable node) of every node of links (x, y).

    Alternates two steps until only stars are left: each node ties its larger neighbours to its smallest one
    (large star), then itself and its smaller neighbours to the smallest (small star). Self-links and
    repeated links are allowed; a node without any other is not returned.
    """
    spark = links.sparkSession
    edges, old = None, []
    while True:
        with tables_written() as new:
            if edges is None:
                edges = _first(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")), chunk)
            else:
                edges = _small_star(cut(_large_star(edges, chunk), "large-stars"), chunk)
            edges = cut(edges.distinct(), "stars")
        delete_tables(spark, old + new[:-1])
        old = new[-1:]
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("centre")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("centre").alias("centre")).where("below + centre > 1").isEmpty():
            break  # each node hangs below one centre, and no centre below another
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
