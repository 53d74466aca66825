"""Connected components of an edge table by contraction, as joins and grouped minima.

Defined cases: an empty edge table gives an empty result; repeated edges and edges from a node to
itself change nothing; edges with a null end are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that one task takes to the end by itself; more are contracted first, round by round.
FEW = 50_000


def _solved(batches):
    """(node, comp) of at most ``FEW`` edges: smaller labels run along edges, labels of labels shorten the way."""
    parts = list(batches)
    a, b = (np.concatenate([p.column(c).to_numpy() for p in parts] or [np.zeros(0, np.int64)]) for c in ("a", "b"))
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y, label[x], label[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "comp"])


def _near_minima(both: DataFrame, seed: int) -> DataFrame:
    """(node, comp): of all nodes within two steps, the one that comes first in an order drawn by ``seed``."""
    drawn = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("v"))
    one = both.groupBy("a").agg(F.min(drawn("b")).alias("low")).select(F.col("a").alias("b"), F.least("low", drawn("a")).alias("low"))
    return both.join(stored(one), "b").groupBy("a").agg(F.min("low").alias("low")).select(F.col("a").alias("node"), F.col("low.v").alias("comp"))


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a, b); comp is the smallest node that it reaches.

    Each round merges every node with the first of its neighbours' neighbours in a random order and goes on with the edges between
    merged nodes, until few enough are left for one task. A star is one node after one round and a chain loses a constant share of its nodes each round, so
    rounds are few and each is smaller than the last. Minima are combined before the shuffle, so a hub costs no
    task more; where names are looked up, rows are two integers, and adaptive execution splits the partition of a hub.
    """
    return contracted(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long")), FEW, parts)


def contracted(some: DataFrame, few: int, parts: int | None = None) -> DataFrame:
    names, last = [], None
    while last is None:
        some = stored(some.distinct(), parts)
        if some.count() <= few:  # the number of rows stands in the files
            last = stored(some.coalesce(1).mapInArrow(_solved, "node long, comp long"))
            break
        both = some.union(some.select("b", "a"))
        names.append(stored(_near_minima(both, len(names)), parts))
        at = lambda end, new: names[-1].select(F.col("node").alias(end), F.col("comp").alias(new))
        some = some.where("a <> b").join(at("b", "y"), "b").join(at("a", "x"), "a").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not names:
        return last  # labels are smallest nodes already
    while names:
        after = last.select(F.col("node").alias("comp"), F.col("comp").alias("later"))
        last = stored(names.pop().join(after, "comp", "left").select("node", F.coalesce("later", "comp").alias("comp")), parts)
    least = stored(last.groupBy("comp").agg(F.min("node").alias("least")), parts)
    return stored(last.join(least, "comp").select("node", F.col("least").alias("comp")), parts)
