"""Connected components of a link table, by repeated minimum labels, in DataFrame jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A node with more links than this, and than a 50,000th of all, is a hub: at most 100,000 nodes are.
HUB_LINKS, HUB_SHARE = 1_000, 50_000
#: Links that a task joins at a time.
JOINED_LINKS = 200_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, and the least node that each reaches by them."""
    nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = number[: len(a)], number[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def joined_links(links: DataFrame) -> DataFrame:
    """For links (a, b, moved) that lie in one task, a row for each node with the least node that it reaches there; moved if some link there is."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made():
            table = pa.Table.from_batches(held)
            node, least = least_reached(table.column("a").to_numpy(), table.column("b").to_numpy())
            moved = np.full(len(node), table.column("moved").to_numpy().any())
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least), pa.array(moved)], names=["a", "b", "moved"])

        for batch in found:
            held.append(batch)
            size += batch.num_rows
            if size >= JOINED_LINKS:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    return links.mapInArrow(run, "a long, b long, moved boolean")


def with_least(rows: DataFrame, least: DataFrame, hub_links: int) -> DataFrame:
    """Adds m of `least` (a, m, n) to rows (a, b) by a. Rows of hubs get it by broadcast and go to tasks by both ends, so no task gets all rows of a hub."""
    hubs = F.broadcast(least.where(F.col("n") > hub_links).select("a", F.col("m").alias("_m")))
    marked = rows.join(hubs, "a", "left").withColumn("_key", F.when(F.col("_m").isNull(), F.col("a")).otherwise(F.xxhash64("a", "b")))
    known = least.select(F.col("a").alias("_node"), "m")
    met = marked.join(known, (F.col("_key") == F.col("_node")) & F.col("_m").isNull(), "left")
    return met.select("a", "b", F.coalesce("_m", "m").alias("m"))


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of it) for all nodes of `links` (a long, b long; any direction, loops allowed).

    Each round links every node's neighbours to the least of its neighbourhood, so that ways to the least node halve,
    and is one aggregation and one join of a stored table; tasks then join what lies with them. It ends when no link
    has moved: the links are stars around the least nodes. A round makes two rows of a link at most.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL")
    # Links may come from a Python step. Stored first, they are joined in tasks of their own, so no task holds two Python workers.
    edges = stored(joined_links(stored(links.withColumn("moved", F.lit(True)), "links")), "links")
    for _ in range(most_rounds):
        size, moved = edges.agg(F.count("*"), F.max("moved")).first()
        if not moved:
            break
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        met = with_least(both, least, max(HUB_LINKS, 2 * size // HUB_SHARE))
        moves = met.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"), (F.col("m") != F.least("a", "b")).alias("moved"))
        edges = stored(joined_links(moves), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
