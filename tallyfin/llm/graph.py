"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouped minimum (partially aggregated before its shuffle) and one join.  Hubs, nodes
with more than one in HUBS of all edges as a sketch of the ends finds them, are few; their rows meet
their minimum by broadcast, so a node with very many edges is no task's own burden.  Lineage is cut
by a reliable checkpoint after each round; nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfin.llm.common import HOT_ROWS, checkpoint


#: Share of all edges from which a node is a hub, and edges in a partition.
HUBS, EDGES = 100, 100_000


def _star(edges: DataFrame, large: bool, hubs: list[int]) -> DataFrame:
    """edges (u, v) with u > v.  Large star: each node's larger neighbours meet its least; small star: its smaller ones do."""
    if large:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    hub = F.col("x").isin(hubs) if hubs else F.lit(False)
    met = both.filter(~hub).join(least.filter(~hub), "x")
    if hubs:
        met = met.unionByName(both.filter(hub).join(F.broadcast(least.filter(hub)), "x"))
    if large:
        out = met.filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("y").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, object, list[int]]:
    """Number of edges, their checksum, and the hubs among their ends."""
    tops = [F.call_function("approx_top_k", F.col(c), F.lit(2 * HUBS)).alias(c) for c in ("u", "v")]
    found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"), *tops).first()
    ends: dict[int, int] = {}
    for top in (found["u"], found["v"]):
        for r in top or ():
            if r["item"] is not None:
                ends[r["item"]] = ends.get(r["item"], 0) + r["count"]
    return found["n"], found["s"], sorted(x for x, times in ends.items() if times > max(HOT_ROWS, found["n"] // HUBS))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node that it reaches.

    Edges may repeat, run either way and join a node to itself (such edges say nothing).  Null ends are left out.
    """
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = known.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v").distinct()
    now, before = checkpoint(now), None
    while True:
        n, checksum, hubs = _state(now)
        if n == 0 or (n, checksum) == before:
            break
        before = (n, checksum)
        parts = 1 + n // EDGES  # a step has few edges more than the one before
        now = checkpoint(_star(checkpoint(_star(now, True, hubs).coalesce(parts)), False, hubs).coalesce(parts))
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
