"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is the smallest node that links reach.

    Each round links every node's larger neighbours to the smallest node around it (large star), then its smaller ones (small star), and writes what is
    left to the shared folder. Neighbour lists are never gathered: minima are aggregates, and the way back to the links is a join. Rounds grow with the
    logarithm of the nodes. Links of a node to itself, repeated links and missing ends do no harm.
    """
    a, b = F.col(left), F.col(right)
    edges = edges.where(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct()
    edges = stored(edges, "links")
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionAll(edges.select(F.col("small").alias("u"), F.col("big").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        lowest = large.groupBy("big").agg(F.min("small").alias("m"))
        across = large.join(lowest, "big").where("small != m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        edges = stored(across.unionAll(lowest.select("big", F.col("m").alias("small"))).distinct(), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("small").alias("node")).distinct()
    return edges.select(F.col("big").alias("node"), F.col("small").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def forest(ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For positions joined by ``pairs``: the smallest id in reach of each."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    low = place.copy()  # rank of the smallest id so far
    i, j = pairs
    while True:
        was = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[order][low]  # follow the smallest one's own
        if (low == was).all():
            break
    return ids[order[low]]


def resolve_links(rows: DataFrame, ids: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """One row per row of ``rows`` (id): id, n_links, component_id, kept.

    ``ids`` has the class (h1, h2) of each id that takes part, ``classes`` the representative and the number of ids of each class, and ``links`` rows
    (rep, n, other) found in separate places: n more linked ids, and an id in reach. Members of a class link with each other. An id in several
    classes gets the sum of their links and stands for all of them in components.
    """
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = classes.join(counts, "rep", "left").select("h1", "h2", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_id = ids.select("id", "h1", "h2").join(joined, ["h1", "h2"]).select("id", "rep", "n_links")
    ends = links.select(F.col("rep").alias("a"), F.col("other").alias("b")).unionAll(by_id.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    reach = components(ends.where("a != b"))
    sums = by_id.groupBy("id").agg(F.sum("n_links").alias("n_links")).join(reach, F.col("id") == F.col("node"), "left").select(F.col("id").alias("of"), "n_links", "component")
    out = rows.join(sums, F.col("id") == F.col("of"), "left")
    component = F.coalesce("component", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
