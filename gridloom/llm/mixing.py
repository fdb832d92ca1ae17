"""Mixing sources to target shares by Poisson replication."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import Scratch

#: Targets are sent to all workers; more than this is refused.
MAX_TARGETS = 10_000
#: Sums of tokens by draw that are gathered for all sources together, and of one source at most and at least.
SUMS, MAX_BINS, MIN_BINS = 1 << 20, 8_192, 64


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        below += p
        mean += 1.0 - below
        p *= rate / (k + 1)
    return mean


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose capped mean is `mean` (below cap)."""
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 600:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def steps(rate: float, cap: int) -> list[float]:
    """Where the inverse of the capped distribution steps up: a draw u gives as many
    copies as there are steps below u."""
    out, p, below = [], math.exp(-rate), 0.0
    for k in range(cap):
        below += p
        out.append(below)
        p *= rate / (k + 1)
        if 1.0 - below < 1e-15:
            break
    return out


def spread(rate: float, cap: int) -> float:
    """Variance of min(Poisson(rate), cap)."""
    p, left, mean, square = math.exp(-rate), 1.0, 0.0, 0.0
    for k in range(cap):
        mean, square, left = mean + k * p, square + k * k * p, left - p
        p *= rate / (k + 1)
    left = max(left, 0.0)
    return max(0.0, square + cap * cap * left - (mean + cap * left) ** 2)


def used_at(rate: float, cap: int, below: np.ndarray) -> float:
    """Tokens used at a rate; below[i] is the tokens of the documents whose draw is under i / bins."""
    bins = len(below) - 1
    return sum(below[-1] - np.interp(t * bins, np.arange(bins + 1), below) for t in steps(rate, cap))


def fitted_rate(goal: float, cap: int, below: np.ndarray) -> float:
    """The rate at which the drawn copies come to `goal` tokens. A larger rate never takes a
    copy away, so that bisection finds it."""
    low, high = 0.0, 1.0
    while used_at(high, cap, below) < goal and high < 600:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if used_at(mid, cap, below) < goal else (low, mid)
    return (low + high) / 2


@dataclass
class Source:
    name: str
    share: float
    cap: int
    tokens: int = 0
    docs: int = 0
    largest: int = 0
    squares: float = 0.0


def total_size(sources: list[Source]) -> float:
    """The total number of tokens at which shares can come nearest to their targets.

    Sources without tokens can't count: the others share in proportion. The candidates
    are the totals at which each source runs out. A larger total leaves that source
    short; a smaller one makes whole documents coarse steps. The sum of both errors decides,
    then the larger total."""
    have = [s for s in sources if s.tokens > 0 and s.cap > 0 and s.share > 0]
    whole = sum(s.share for s in have)
    if not have:
        return 0.0
    def error(total: float) -> float:
        used = [min(total * s.share / whole, s.tokens * s.cap) for s in have]
        n = sum(used)
        return sum(abs(u / n - s.share / whole) + s.largest / (2 * n) for u, s in zip(used, have))
    return min((s.tokens * s.cap * whole / s.share for s in have), key=lambda t: (round(error(t), 9), -t))


def unit_hash(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(2**53))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, source, n_tokens. targets: source_name, target_share, max_repeats.

    Returns (doc_id, source_name, n_tokens, times) of each document in use, and the
    report: source_name, target_share, max_repeats, n_docs, n_tokens, rate, docs_used, tokens_used,
    reached_share, draw_error of every target.

    Each document's copies are the inverse of its source's Poisson distribution, capped
    at max_repeats, at a draw u in [0, 1) that is the seeded hash of its doc_id; so draws are
    independent, and no document's depends on others. At the rate whose mean is the wanted
    one, a source would miss its share by chance, by about draw_error (a standard deviation). As
    draws are fixed, the tokens that come out grow with the rate alone: the rate is the one
    at which they come to the wanted number, read from sums of tokens by source and
    interval of u. What is gathered is bounded (SUMS, or MIN_BINS a target), whatever the corpus.

    Documents without tokens, without a source, or of an unnamed one
    aren't used; a target named twice counts with the sum of its shares and its larger
    max_repeats; null shares and repeats count as 0. Rows with a repeated doc_id are documents of
    their own with the same draw."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    named = targets.where(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    rows = named.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    target_schema = "source_name string, target_share double, max_repeats int"
    goals = spark.createDataFrame([(r[0], float(r[1]), int(r[2])) for r in rows], target_schema)
    used = docs.select("doc_id", F.col("source").alias("source_name"), "n_tokens").where(F.col("n_tokens") > 0)
    used = used.join(F.broadcast(goals.select("source_name")), "source_name", "left_semi").withColumn("u", unit_hash(F.col("doc_id"), seed=seed))
    used = scratch.save(used, "docs")
    bins = max(MIN_BINS, min(MAX_BINS, SUMS // max(1, len(rows))))
    sums = used.groupBy("source_name", F.floor(F.col("u") * bins).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("largest"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("squares")).toPandas()
    below, sources = {}, []
    parts = dict(tuple(sums.groupby("source_name")))
    for name, share, cap in rows:
        s = Source(name, float(share), int(cap))
        if name in parts:
            part = parts[name]
            s.tokens, s.docs, s.largest, s.squares = int(part["n"].sum()), int(part["docs"].sum()), int(part["largest"].max()), float(part["squares"].sum())
            below[name] = np.r_[0.0, np.cumsum(np.bincount(part["bin"], part["n"], bins))]
        sources.append(s)
    total = total_size(sources)
    whole = sum(s.share for s in sources if s.tokens > 0 and s.cap > 0) or 1.0
    chosen, rates, errors = [], {}, {}
    for s in sources:
        if not (s.tokens > 0 and s.cap > 0 and s.share > 0):
            continue
        goal = min(total * s.share / whole, s.tokens * s.cap)
        if goal >= s.tokens * s.cap * (1 - 1e-9):  # all of it, as often as allowed
            chosen.append((s.name, [-1.0] * s.cap))
            continue
        rates[s.name] = fitted_rate(goal, s.cap, below[s.name])
        errors[s.name] = math.sqrt(s.squares * spread(rate_for(goal / s.tokens, s.cap), s.cap)) / total
        chosen.append((s.name, steps(rates[s.name], s.cap)))
    plan = spark.createDataFrame(chosen, "source_name string, steps array<double>")
    times = used.join(F.broadcast(plan), "source_name").withColumn("times", F.size(F.filter("steps", lambda t: F.col("u") > t))).where(F.col("times") > 0).select("doc_id", "source_name", "n_tokens", "times")
    done = times.groupBy("source_name").agg(F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("n_tokens") * F.col("times")).alias("tokens_used"))
    have = spark.createDataFrame([(s.name, s.share, s.cap, s.docs, s.tokens, rates.get(s.name), errors.get(s.name, 0.0)) for s in sources], target_schema + ", n_docs bigint, n_tokens bigint, rate double, draw_error double")
    report = have.join(done, "source_name", "left").na.fill(0, ["docs_used", "tokens_used"])
    report = report.withColumn("reached_share", F.col("tokens_used") / F.greatest(F.lit(1), F.sum("tokens_used").over(Window.partitionBy())))
    return times, report


def sequence(times: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, copy_no, order_key: every document once per use, in an order that is
    random over all sources and the same in every run."""
    one = times.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"))
    keyed = one.withColumn("order_key", F.xxhash64("doc_id", "copy_no", F.lit(seed)))
    return keyed.repartitionByRange("order_key").sortWithinPartitions("order_key", "doc_id", "copy_no")
