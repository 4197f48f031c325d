"""Subtree totals of forests by parallel tree contraction, in join rounds.

Every round takes away, at once, all leaves (rake: a leaf's total is known and is added to its parent)
and about half of the nodes of unary chains (compress: a node with one child leaves, the child moves up
to its parent and carries what the node would have added; which ones leave is decided by a bit of
their depth, so that no two neighbours do). A chain of n nodes is gone after about log2(n) rounds, and
so is any tree. Then the rounds are read backwards: the total of a node that was compressed is that of
the child it left, which is known by then, and the sum it took along.

Nodes have keys of two numbers (node, depth) and one of parents (parent, depth - 1 at first). Every join
is on a node's own key, of which there is one row on each side; only sums are grouped by parent, and
those are combined before the shuffle, so a node with very many children is no hot key. Each round is
written once and holds the nodes still in the tree; sizes fall geometrically.

Defined cases: an empty forest gives an empty result; many roots are allowed (a null parent); a node
whose parent is no node is a root too; a cycle ends in an error, as no round can take its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolark.core import scratch, staged

LIVE, RAKED, SPLICED = 0, 1, 2
KEY, PARENT = ("node", "depth"), ("parent", "parent_depth")


def _started(nodes: DataFrame, values: list[str]) -> DataFrame:
    """own_v: what a node has of value v so far; up_v: what its edge adds on the way to its parent; kids: children left."""
    kids = nodes.where("parent is not null").groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)]).agg(F.count(F.lit(1)).alias("kids"))
    zero = F.lit(0).cast("long")
    columns = [*KEY, *PARENT, *[F.col(v).alias(f"own_{v}") for v in values], *[zero.alias(f"up_{v}") for v in values]]
    return nodes.select(*columns).join(kids, list(KEY), "left").withColumn("kids", F.coalesce("kids", zero))


def _coin(turn: int, bits: int) -> Column:
    """A bit of the depth, another one each round; from one pass over the bits to the next its sense turns."""
    bit = F.shiftright("depth", turn % bits).bitwiseAND(F.lit(1))
    return bit == F.lit(1 - turn // bits % 2)


def _round(live: DataFrame, values: list[str], turn: int, bits: int) -> DataFrame:
    """live with `state`: leaves are RAKED, compressed nodes SPLICED with the child that they left (to, to_depth)
    and what it had added to their own (own_v then is what they add to the child's total)."""
    leaf, unary = F.col("kids") == 0, F.col("kids") == 1
    of_leaves = [F.sum(F.when(leaf, F.col(f"own_{v}") + F.col(f"up_{v}")).otherwise(0)).alias(f"got_{v}") for v in values]
    #: Of an only child: its key, what its edge adds, and whether it hinders its parent's leaving.
    child = [F.min("node").alias("to"), F.min("depth").alias("to_depth"), F.bool_or(leaf | (unary & _coin(turn, bits))).alias("hindered"), *[F.sum(f"up_{v}").alias(f"of_{v}") for v in values]]
    below = live.where("parent is not null").groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY, strict=True)]).agg(F.count_if(leaf).alias("raked"), *of_leaves, *child)
    seen = live.join(below, list(KEY), "left")
    out = unary & F.col("parent").isNotNull() & _coin(turn, bits) & ~F.col("hindered")
    state = F.when(leaf, RAKED).when(out, SPLICED).otherwise(LIVE).cast("int")
    own = [(F.col(f"own_{v}") + F.coalesce(f"got_{v}", F.lit(0)) + F.when(out, F.col(f"of_{v}")).otherwise(0)).alias(f"own_{v}") for v in values]
    gone = [F.when(out, F.col(c)).alias(c) for c in ("to", "to_depth")]
    seen = staged(seen.select(*KEY, *PARENT, *own, *[f"up_{v}" for v in values], (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids"), state.alias("state"), *gone))
    # the children that they leave move up
    moved = seen.where(F.col("state") == SPLICED).select(F.col("to").alias("node"), F.col("to_depth").alias("depth"), F.col("parent").alias("new"), F.col("parent_depth").alias("new_depth"), *[(F.col(f"own_{v}") + F.col(f"up_{v}")).alias(f"more_{v}") for v in values])
    seen = seen.join(moved, list(KEY), "left")
    above = [F.coalesce(n, p).alias(p) for n, p in (("new", "parent"), ("new_depth", "parent_depth"))]
    # more_v has the child's own up_v in it
    up = [F.coalesce(f"more_{v}", f"up_{v}").alias(f"up_{v}") for v in values]
    return seen.select(*KEY, *above, *[f"own_{v}" for v in values], *up, "kids", "state", "to", "to_depth")


def subtree_totals(nodes: DataFrame, values: list[str], depth_bits: int) -> DataFrame:
    """(node, depth, *values), staged: sums over each node and all below it, of nodes (node, depth, parent,
    parent_depth, *values) in long integers. `depth_bits`: bits of the largest depth, from 1."""
    with scratch(nodes.sparkSession):
        live, rounds = staged(_started(nodes, values)), []
        left, idle = live.count(), 0
        while left:
            seen = staged(_round(live, values, len(rounds), depth_bits))
            rounds.append(seen)
            live = seen.where(F.col("state") == LIVE).drop("state", "to", "to_depth")
            before, left = left, live.count()
            idle = idle + 1 if left == before else 0
            if idle > 2 * depth_bits:
                raise ValueError(f"{left} nodes hang from no root")
        return staged(_expanded(rounds, values) if rounds else nodes.select(*KEY, *values), keep=True)


def _expanded(rounds: list[DataFrame], values: list[str]) -> DataFrame:
    """Totals of all nodes, from the last round to the first; those of a round are written once they are known."""
    known = None
    for seen in reversed(rounds):
        total = [F.col(f"own_{v}").alias(v) for v in values]
        found = seen.where(F.col("state") == RAKED).select(*KEY, *total)
        if known is not None:
            spliced = seen.where(F.col("state") == SPLICED).select(*KEY, "to", "to_depth", *[f"own_{v}" for v in values])
            of_child = known.select(F.col("node").alias("to"), F.col("depth").alias("to_depth"), *values)
            found = found.union(spliced.join(of_child, ["to", "to_depth"]).select(*KEY, *[(F.col(f"own_{v}") + F.col(v)).alias(v) for v in values]))
        found = staged(found)
        known = found if known is None else known.union(found)
    return known
