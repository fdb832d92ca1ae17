"""Connected groups from pairs, by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import Scratch

#: Stands for a null scope, so that joins needn't be null-safe.
NO_SCOPE = "\x00none"
#: Every so many rounds equal edges become one, and finished groups are set aside.
SET_ASIDE = 2


def _least(edges: DataFrame) -> DataFrame:
    """v and its smallest smaller neighbour m. Partly aggregated before its shuffle."""
    return edges.groupBy("v").agg(F.min("u").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest of the node and its neighbours.

    Edges (v, u) have v > u, so that the smallest of u and its neighbours is u's least in
    the other edges, or u. The join's small side has one row a node, so that a hub's edges
    may be split over tasks (AQE). `moved` tells which edges are new."""
    up = _least(edges).withColumnRenamed("v", "u")
    return edges.join(up, "u", "left").select("v", F.coalesce("m", "u").alias("u"), F.col("m").isNotNull().alias("moved"))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these. Equal edges stay: they change no minimum."""
    joined = edges.join(_least(edges), "v")
    stays = F.col("u") == F.col("m")
    return joined.select(F.when(stays, F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"), (F.col("moved") | ~stays).alias("moved"))


def connected_groups(nodes: DataFrame, edges: DataFrame, scope: str = "project_id", node: str = "node_id", src: str = "from_id", dst: str = "to_id") -> DataFrame:
    """scope, group_node_id, node_id: one row for each distinct node with the smallest
    node of its group.

    Edges count in either direction, however often; self loops, null ends and ends that
    no node of the scope has don't. Null nodes aren't nodes; a null scope is a scope of
    its own. Empty tables give an empty result.

    Nodes are numbered once, in the order of scope and node, so that the least number of a
    group is its least node and rounds shuffle pairs of numbers. Large-star and small-star
    rounds go on until a round moves no edge, for any input: a moved edge has a lower end.
    Each round is written to the shared folder. On the way, stars that are whole groups are
    set aside: where a star touches any other edge, a round makes a new edge at its centre, so
    a centre at no moved edge is finished."""
    scratch = Scratch(nodes.sparkSession, "groups")
    key = F.coalesce(F.col(scope), F.lit(NO_SCOPE)).alias("p")
    own = nodes.where(F.col(node).isNotNull()).select(key, F.col(node).alias("v")).distinct()
    own = scratch.save(own.repartitionByRange("p", "v").sortWithinPartitions("p", "v").withColumn("i", F.monotonically_increasing_id()), "nodes")
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = e.select(key, F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    e = e.join(own.select("p", F.col("v").alias("a"), F.col("i").alias("ia")), ["p", "a"]).join(own.select("p", F.col("v").alias("b"), F.col("i").alias("ib")), ["p", "b"])
    e, seen = scratch.save_with(e.select(F.col("ia").alias("v"), F.col("ib").alias("u")), "edges", n=F.count(F.lit(1)))
    done: list[DataFrame] = []
    n = 0
    while seen["n"]:
        n += 1
        step = small_star(large_star(e.select("v", "u")))
        if n % SET_ASIDE:
            step = step.groupBy("v", "u").agg(F.bool_or("moved").alias("moved"))
        step, seen = scratch.save_with(step, "edges", n=F.count_if("moved"))
        scratch.drop(e)
        e = step
        if seen["n"] and n % SET_ASIDE:
            open_ = scratch.save(e.where("moved").select(F.explode(F.array("v", "u")).alias("u")).distinct(), "open")
            done.append(scratch.save(e.join(open_, "u", "left_anti").select("v", "u"), "done"))
            step = scratch.save(e.join(open_, "u", "left_semi").select("v", "u"), "edges")
            scratch.drop(e)
            scratch.drop(open_)
            e = step
    star = e.select("v", "u").distinct()
    for d in done:
        star = star.unionByName(d)
    led = own.join(star.select(F.col("v").alias("i"), "u"), "i", "left").select("p", "v", F.coalesce("u", "i").alias("g"))
    out = led.join(own.select(F.col("i").alias("g"), F.col("v").alias("least")), "g")
    return out.select(F.when(F.col("p") != NO_SCOPE, F.col("p")).alias(scope), F.col("least").alias("group_node_id"), F.col("v").alias(node))
