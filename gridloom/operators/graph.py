"""Iterative operators on graphs: components, pruning, independent sets, pointer jumping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import Scratch

def neighbours(edges: DataFrame, scope: str = "project_id", src: str = "from_id", dst: str = "to_id") -> DataFrame:
    """scope, node_id, other: both directions of every edge once, without self loops."""
    e = edges.where(F.col(src) != F.col(dst))
    return e.select(scope, F.col(src).alias("node_id"), F.col(dst).alias("other")).union(e.select(scope, F.col(dst), F.col(src))).distinct()


def components(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str], label: str = "component") -> DataFrame:
    """keys and the least key of each node's component.

    nodes has `keys` (the last one is the node, those before it its scope); pairs has
    the scope, a and b. In a round each node takes the least label among its neighbours, and so
    does the node that its label names; labels then jump twice to the labels of labels. So whole
    trees join at once, and a path of n nodes takes about log n rounds. Labels only fall, so
    rounds end for any input. Each is written to the shared folder."""
    *scope, node = keys
    scratch = Scratch(nodes.sparkSession, "components")
    both = scratch.save(pairs.select(*scope, "a", "b").union(pairs.select(*scope, F.col("b"), F.col("a"))).where(F.col("a") != F.col("b")).distinct(), "pairs")
    state, _ = scratch.save_with(nodes.select(*scope, F.col(node).alias("n")).distinct().withColumn("l", F.col("n")), "labels", n=F.count(F.lit(1)))
    while True:
        near = both.join(state.select(*scope, F.col("n").alias("b"), "l"), [*scope, "b"]).groupBy(*scope, F.col("a").alias("n")).agg(F.min("l").alias("m"))
        found = state.join(near, [*scope, "n"]).where(F.col("m") < F.col("l"))
        hooks = found.select(*scope, F.explode(F.array("n", "l")).alias("n"), "m").groupBy(*scope, "n").agg(F.min("m").alias("m"))
        step, seen = scratch.save_with(state.join(hooks, [*scope, "n"], "left").select(*scope, "n", F.least("l", "m").alias("l"), F.col("m").isNotNull().alias("moved")), "step", moved=F.count_if("moved"))
        if not seen["moved"]:
            return state.select(*scope, F.col("n").alias(node), F.col("l").alias(label))
        scratch.drop(state)
        for _ in range(2):
            jump = step.select(*scope, F.col("n").alias("l"), F.col("l").alias("ll"))
            far = scratch.save(step.join(jump, [*scope, "l"], "left").select(*scope, "n", F.least("l", "ll").alias("l")), "labels")
            scratch.drop(step)
            step = far
        state = step


def prune(edges: DataFrame, scope: str = "project_id", a: str = "a", b: str = "b") -> DataFrame:
    """The edges left when nodes of degree one go, again and again.

    Whole dangling chains go at once: each edge gives two darts n -> f, a dart whose f has degree two
    goes on to f's other neighbour, and by pointer doubling each dart learns whether its way ends in
    a leaf. So a chain of n nodes takes log n rounds, and as every leaf that then appears had
    two chains or more, log n such passes are enough for any graph."""
    scratch = Scratch(edges.sparkSession, "prune")
    now = scratch.save(edges, "edges")
    while True:
        ends = now.select(scope, F.col(a).alias("n"), F.col(b).alias("f")).unionAll(now.select(scope, F.col(b), F.col(a)))
        slim = ends.groupBy(scope, "f").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("k <= 2")
        on = F.col("k") == 2
        other = F.when(F.col("n") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        darts = ends.distinct().join(slim, [scope, "f"]).select(scope, "n", "f", F.when(on, F.col("f")).alias("tn"), F.when(on, other).alias("tf"), (~on).alias("hit"))
        state, seen = scratch.save_with(darts, "darts", hits=F.count_if("hit"))
        if not seen["hits"]:
            scratch.drop(state)
            return now
        while True:
            far = state.select(scope, F.col("n").alias("tn"), F.col("f").alias("tf"), F.col("tn").alias("nn"), F.col("tf").alias("nf"), F.col("hit").alias("ends"))
            step = state.join(far, [scope, "tn", "tf"], "left").select(scope, "n", "f", F.col("nn").alias("tn"), F.col("nf").alias("tf"), (F.col("hit") | F.coalesce("ends", F.lit(False))).alias("hit"))
            new, after = scratch.save_with(step, "darts", hits=F.count_if("hit"))
            scratch.drop(state)
            state, grown, seen = new, after["hits"] > seen["hits"], after
            if not grown:  # none between 2^k and 2^(k+1) steps from a leaf, so none farther
                break
        chain = state.where("hit").select(scope, F.col("f").alias("n")).distinct()
        rest = now.join(chain.withColumnRenamed("n", a), [scope, a], "left_anti").join(chain.withColumnRenamed("n", b), [scope, b], "left_anti")
        new = scratch.save(rest.select(*edges.columns), "edges")
        scratch.drop(state)
        scratch.drop(now)
        now = new


#: Undecided items that one task settles in their order.
BLOCK = 50_000


def first_leaders(items: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and is_leader: an item leads unless an earlier leader lies near it.

    The sequential rule "take each item in order, skip it if near one taken" is the
    lexicographically first independent set of the pairs (scope, a, b with a < b). Each round
    decides all items without an undecided earlier neighbour. What is left waits in long chains:
    blocks of items next to each other in order then go through the rule itself, and only items
    that wait for another block stay open. The first open item of a scope is decided in every
    round, so this ends for any input."""
    *scope, item = keys
    scratch = Scratch(items.sparkSession, "leaders")
    near = scratch.save(pairs.select(*scope, "a", "b").where("a < b").distinct(), "pairs")
    state = scratch.save(items.select(*scope, F.col(item).alias("i")).distinct().withColumn("s", F.lit(0)), "state")
    schema = state.schema
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("i"))
    while True:
        mark = state.select(*scope, F.col("i").alias("a"), F.col("s").alias("sa"))
        seen = near.join(mark, [*scope, "a"]).groupBy(*scope, F.col("b").alias("i")).agg(F.max((F.col("sa") == 1).cast("int")).alias("led"), F.max((F.col("sa") == 0).cast("int")).alias("open"))
        new = state.join(seen, [*scope, "i"], "left")
        s = F.when(F.col("s") != 0, F.col("s")).when(F.col("led") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        new, left = scratch.save_with(new.select(*scope, "i", s.alias("s")), "state", open=F.count_if(F.col("s") == 0))
        scratch.drop(state)
        state = new
        if left["open"]:
            todo = state.where("s = 0").select(*scope, "i", F.floor(place / BLOCK).alias("block"))
            mark = state.select(*scope, F.col("i").alias("a"), F.col("s").alias("sa"))
            waits = near.join(todo.select(*scope, F.col("i").alias("b"), "block"), [*scope, "b"]).join(mark, [*scope, "a"]).where("sa <> 2")
            waits = waits.groupBy(*scope, "block", F.col("b").alias("i")).agg(F.bool_or(F.col("sa") == 1).alias("led"), F.collect_list(F.when(F.col("sa") == 0, F.col("a"))).alias("open"))
            rows = todo.join(waits, [*scope, "block", "i"], "left")
            done = rows.groupBy(*scope, "block").applyInPandas(_settle, schema).where("s <> 0").withColumnRenamed("s", "t")
            new, left = scratch.save_with(state.join(done, [*scope, "i"], "left").select(*scope, "i", F.coalesce("t", "s").alias("s")), "state", open=F.count_if(F.col("s") == 0))
            scratch.drop(state)
            state = new
        if not left["open"]:
            return state.select(*scope, F.col("i").alias(item), (F.col("s") == 1).alias("is_leader"))


def _settle(rows):
    """The sequential rule over one block; an item that waits for one outside stays 0."""
    rows = rows.sort_values("i", ignore_index=True)
    known: dict = {}
    for i, led, waits in zip(rows["i"], rows["led"], rows["open"]):
        near = [] if waits is None else [known.get(a, 0) for a in waits]
        known[i] = 2 if led is True or led == 1 or 1 in near else 0 if 0 in near else 1
    rows["s"] = [known[i] for i in rows["i"]]
    return rows.drop(columns=["block", "led", "open"])


def min_over_cycle(successor: DataFrame, scope: str, node: str, following: str) -> DataFrame:
    """scope, node, ring: the least node on each node's cycle under `following`, by
    pointer doubling. Every node must have one follower and be one's follower."""
    scratch = Scratch(successor.sparkSession, "cycles")
    now = scratch.save(successor.select(scope, F.col(node).alias("n"), F.col(following).alias("f"), F.least(node, following).alias("m")), "jump")
    while True:
        far = now.select(scope, F.col("n").alias("f"), F.col("f").alias("ff"), F.col("m").alias("mm"))
        step = now.join(far, [scope, "f"]).select(scope, "n", F.col("ff").alias("f"), F.least("m", "mm").alias("new"), "m")
        new, seen = scratch.save_with(step.select(scope, "n", "f", F.col("new").alias("m"), (F.col("new") != F.col("m")).alias("moved")), "jump", moved=F.count_if("moved"))
        scratch.drop(now)
        now = new.drop("moved")
        now._gridloom_path = new._gridloom_path
        if not seen["moved"]:
            break
    return now.select(scope, F.col("n").alias(node), F.col("m").alias("ring"))


