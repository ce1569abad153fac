"""Connected components of a link table, by repeated contraction.

Each round hangs every node on its smallest neighbour (or itself), follows the
parents two steps up, and rewrites the links between the nodes reached; links
inside one tree vanish. Rounds end when no link is left. Every round is
written to the shared folder; links and labels never reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is one node of its component.

    Nodes may be of any orderable type. Links with a null end and links from a
    node to itself only name the node. An empty table gives no rows."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while labels is None or not edges.where("a <> b").isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "tree")
        up1 = tree.select(F.col("node").alias("n1"), F.col("up").alias("u1"))
        up2 = tree.select(F.col("node").alias("n2"), F.col("up").alias("u2"))
        tree = saved(tree.join(up1, F.col("up") == F.col("n1")).join(up2, F.col("u1") == F.col("n2"))
                     .select("node", F.col("u2").alias("up")), "tree")
        ta = tree.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        tb = tree.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = saved(edges.where("a <> b").join(ta, "a").join(tb, "b").where("ra <> rb")
                      .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if labels is None:
            labels = tree.select("node", F.col("up").alias("root"))
        else:
            nxt = tree.select(F.col("node").alias("root"), "up")
            labels = saved(labels.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
    return labels


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes inside one task."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        on = ra != rb
        a, b, ra, rb = a[on], b[on], ra[on], rb[on]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
