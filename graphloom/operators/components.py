"""Connected components by alternating large-star and small-star steps.

Every step sends each node's neighbours to the smallest among them: a minimum by node (summed up in each task first)
joined back to the edges, so a hub's edges spread over the join's tasks. Rounds grow with the logarithm of the largest
component. Each round is written to the shared checkpoint folder. A graph of few edges can be labelled by one task instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: of both directions, neighbours above u go to u's least neighbour; small: those below."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        sent = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        sent = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return sent.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())


def _labels(batches):
    """(id, component) of all edges (u, v) of a task: labels sink to the least along edges, and to their own labels' labels."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    ends = pa.chunked_array(rows["u"].chunks + rows["v"].chunks)
    ids = pc.unique(ends)
    ids = ids.take(pc.sort_indices(ids))
    at = pc.index_in(ends, value_set=ids).to_numpy().astype(np.int64)
    a, b = at[: rows.num_rows], at[rows.num_rows :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], ["id", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = 0) -> DataFrame:
    """(id, component): each node that has an edge to another one, with the least node of its component.

    Loops and repeated edges change nothing, a null end makes an edge void, and an empty table gives an empty result.
    Up to `small` edges are labelled by one task, with the same result. Raises RuntimeError if max_rounds do not suffice.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(f"`{src}` is not null and `{dst}` is not null and u <> v").distinct()
    now = materialise(now, "components")
    state = _state(now)
    if state[0] <= small:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_labels, f"id {kind}, component {kind}")
    for _ in range(max_rounds):
        now = materialise(_star(_star(now, True), False), "components")
        after = _state(now)
        if after == state:
            # Stars now: every node points to the least of its component.
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
