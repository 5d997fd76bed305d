"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from revq.session import materialise

CHUNK_ROWS = 200_000


def smallest_reached(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Per node 0, 1, ... the smallest node that the links (a, b) reach, by hooking and jumping."""
    top = np.arange(nodes)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(top, high, low)
        while not np.array_equal(further := top[top], top):
            top = further
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return top


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars, chunk by chunk: one row per chunk and node that is no smallest one."""

    def stars(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = pa.Table.from_batches(rows)
        ends = links["a"].to_pylist() + links["b"].to_pylist()
        which, nodes = pd.factorize(np.fromiter(ends, object, len(ends)), sort=True)
        top = smallest_reached(which[: len(links)], which[len(links) :], len(nodes))
        hung = np.flatnonzero(top != np.arange(len(nodes)))
        kind = links.schema.field("a").type
        ends = [pa.array(nodes[at].tolist(), kind) for at in (hung, top[hung])]
        yield from pa.table({"a": ends[0], "b": ends[1]}).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK_ROWS:
            yield from stars(held)
            held = []
    if held:
        yield from stars(held)


def _contracted(links: DataFrame) -> DataFrame:
    links = links.select("a", "b")
    return links.mapInArrow(_contract, links.schema)


def _hung(links: DataFrame) -> DataFrame:
    """Every node (`own`), and its other smaller neighbours, hung on the smallest of them."""
    mine = Window.partitionBy("a").orderBy("b")
    placed = links.withColumns({"least": F.first("b").over(mine), "own": F.row_number().over(mine) == 1})
    return placed.where("own OR b <> least").select(
        F.when(F.col("own"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"), "own"
    )


def _jumped(hung: DataFrame) -> DataFrame:
    """All links, from where they end to where that end hangs itself, if it does (`jumped`)."""
    above = hung.where("own").select(F.col("a").alias("b"), F.col("b").alias("above"))
    return hung.select("a", "b").join(above, "b", "left").select(
        "a", F.coalesce("above", "b").alias("b"), F.col("above").isNotNull().alias("jumped")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is its smallest node.

    Each task first turns its own links into stars, so a node has few rows whatever its
    number of neighbours. Then every node is hung on the smallest of its smaller
    neighbours, these as well (one exchange by node), and all links jump to where their
    smaller end hangs: a join with a written table, so Spark can split an end that very
    many share. Both repeat until no node has two smaller neighbours and no link jumps;
    the number of rounds grows with the logarithm of the longest path, in a forest there
    are only jumps. Nodes are longs, strings or binary; loops, repeated links and links
    with a null end add nothing.
    """
    hung = materialise(_hung(_contracted(links.where("a <> b"))))
    while True:
        forest = hung.where("NOT own").isEmpty()
        moved = materialise(_jumped(hung))
        if forest and moved.where("jumped").isEmpty():
            break
        hung = moved.withColumn("own", F.lit(True)) if forest else materialise(_hung(_contracted(moved)))
    return moved.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        moved.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
