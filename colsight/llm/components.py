"""Connected components of an edge table by randomised contraction.

Each round gives every node a new random order and moves it to the least node among itself and its neighbours; the
edges between the nodes moved to are the next round's graph, which has about half as many nodes. Least nodes are taken
with map-side combine, and the table joined to the edges has one row a node, so a node with very many edges, like the
centre of a star, is one key that skewed joins may split. Once SMALL edges or fewer are left, one task finds the least
node of each component of them. Afterwards the moves are composed, last round first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsight.llm.common import stored

#: Edges that one task finishes: time only, never the result.
SMALL = 10_000


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) for each node of edges (a, b) with a <> b; root names the component. Stored; no edges, no rows."""
    # Both ends of an edge are kept in one order, and each edge once.
    live = stored(_distinct(edges.select("a", "b")), "components-edges")
    moves = []
    while live.count() > small:
        order = F.xxhash64(F.lit(len(moves)), "node")
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64(F.lit(len(moves)), "other").alias("at"), F.col("other").alias("to"))).alias("least"))
        own = F.struct(order.alias("at"), F.col("node").alias("to"))
        move = stored(least.select("node", F.least(own, "least")["to"].alias("to")), "components-moves")
        moves.append(move)
        moved = live.join(move.select(F.col("node").alias("a"), F.col("to").alias("a_to")), "a")
        moved = moved.join(move.select(F.col("node").alias("b"), F.col("to").alias("b_to")), "b")
        live = stored(_distinct(moved.select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))), "components-edges")
    kind = dict(live.dtypes)["a"]
    roots = stored(live.coalesce(1).mapInArrow(_least, f"node {kind}, root {kind}"), "components-roots")
    for move in reversed(moves):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = stored(move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "components-roots")
    return roots


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least node, by place, of each node's component; of a few edges."""
    held = list(batches)
    if not held:
        return
    names = pa.chunked_array([batch.column(k) for k in range(2) for batch in held]).combine_chunks().dictionary_encode()
    a, b = np.asarray(names.indices).reshape(2, -1)
    least = np.arange(len(names.dictionary))
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least[least] != least).any():
            least = least[least]
    yield pa.RecordBatch.from_arrays([names.dictionary, names.dictionary.take(pa.array(least))], names=["node", "root"])


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
