"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, shuffle_parts, stored
from .tokens import count_tokens, default_vocabulary

#: Targets are a configuration; more sources than this are refused rather than brought to the driver.
MOST_SOURCES = 10_000


def poisson_window(rate: float) -> tuple[int, np.ndarray]:
    """The least number and the probabilities of all numbers from it on that a draw of 53 bits can hit (nine deviations
    either way), from ratios of neighbours around the mode, so that nothing under- or overflows at any rate."""
    mode, reach = int(rate), int(9 * math.sqrt(rate)) + 40
    up = np.cumprod(rate / np.arange(mode + 1, mode + reach + 1))
    down = np.cumprod(np.arange(mode, max(mode - reach, 0), -1) / rate) if mode else np.empty(0)
    p = np.concatenate([down[::-1], [1.0], up])
    return mode - len(down), p / p.sum()


def capped_mean(rate: float, cap: int) -> float:
    """Mean of min(N, cap) for a Poisson number N of the given rate."""
    low, p = poisson_window(rate)
    return float(np.minimum(np.arange(low, low + len(p)), cap) @ p)


def poisson_rate(mean: float, cap: int) -> float:
    """Rate whose capped mean is ``mean`` (0 < mean < cap), by bisection."""
    low, high = 0.0, max(1.0, 2 * mean)
    while capped_mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def inverse_table(mean: float, cap: int) -> tuple[int, list[float]]:
    """(``base``, ``steps``): ``base`` and the number of steps at or below a uniform number are together a Poisson number
    capped at ``cap`` whose mean is ``mean``. Steps are cumulative probabilities, about 18 roots of the rate of them.
    A mean of ``cap`` or more always gives ``cap`` copies."""
    if cap <= 0 or mean <= 0:
        return 0, []
    if mean >= cap:
        return cap, []
    low, p = poisson_window(poisson_rate(mean, cap))
    if low >= cap:
        return cap, []
    return low, np.minimum(np.cumsum(p), 1.0)[: cap - low].tolist()


def source_key(c):
    """Sources are equal without regard to case and surrounding blanks (of any kind)."""
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 11, vocabulary: str | None = None, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, plan) for ``documents`` (``doc_id``, ``text``, ``source``) and ``targets`` (``source_name``,
    ``target_share``, ``max_repeats``).

    The mixture aims at ``total_tokens``, by default all tokens T of the documents whose source is a target. A source that
    needs its text m times on average gives each document a number of copies drawn from a Poisson distribution capped at
    ``max_repeats`` and shifted so that the capped mean is m, by inverting it at a uniform number hashed from the seed and
    the document's id. A source that would need more than its cap gives every document ``max_repeats`` times.

    report, one row a target: ``source_name``, ``target_share``, ``max_repeats``, ``n_docs``, ``own_tokens``,
    ``wanted_tokens``, ``mean_repeats``, ``copies``, ``reached_tokens``, ``reached_share``, ``can_reach``.
    plan: the same before drawing, with ``key`` and the inverted distribution (``base``, ``steps``), for ``draw``.

    Null sources belong to no target; null and empty texts have no tokens, a blank text those of its blanks; null ids share one draw; rows of one id get the
    same number of copies. A target's null share or cap counts as 0; a null name is no target; of repeated targets the
    greatest share, then cap, holds. A target without documents is in the report, out of reach if it wants any.
    """
    vocabulary = vocabulary or default_vocabulary()
    wanted = targets.select(source_key(F.col("source_name")).alias("key"), "source_name", F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats")).filter("key is not null")
    wanted = wanted.groupBy("key").agg(F.max(F.struct("target_share", "max_repeats", "source_name")).alias("m")).select("key", "m.*")
    rows = wanted.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many target sources")
    keys = wanted.sparkSession.createDataFrame([(r["key"], r["source_name"]) for r in rows], "key string, source_name string")
    named = documents.select(F.col("doc_id").cast("long"), "text", source_key(F.col("source")).alias("key")).join(F.broadcast(keys), "key")  # at most MOST_SOURCES rows
    sized = stored(named.select("doc_id", "key", "text").mapInArrow(count_tokens(vocabulary, 2, ["doc_id", "key"]), "doc_id long, key string, n_tokens long"))
    own = {r["key"]: (r["n"], r["t"]) for r in sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    total = sum(t for _, t in own.values()) if total_tokens is None else total_tokens
    plan = []
    for r in rows:
        n, tokens = own.get(r["key"], (0, 0))
        need, cap = r["target_share"] * total, max(0, r["max_repeats"])
        mean = need / tokens if tokens else 0.0
        plan.append((r["key"], r["source_name"], r["target_share"], cap, n, tokens, need, min(mean, float(cap)), need <= cap * tokens, *inverse_table(mean, cap)))
    plan_rows = wanted.sparkSession.createDataFrame(plan, "key string, source_name string, target_share double, max_repeats int, n_docs long, own_tokens long, wanted_tokens double, mean_repeats double, can_reach boolean, base int, steps array<double>")
    copies = draw(sized, plan_rows, seed)
    took = copies.groupBy("key").agg(F.sum("n_copies").alias("copies"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("reached_tokens"))
    took = cut(took)  # one row a source
    every = took.agg(F.sum("reached_tokens").alias("every"))
    report = plan_rows.drop("base", "steps").join(F.broadcast(took), "key", "left").crossJoin(F.broadcast(every))  # one row
    report = report.select("source_name", "target_share", "max_repeats", "n_docs", "own_tokens", "wanted_tokens", "mean_repeats", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"), F.coalesce(F.try_divide(F.col("reached_tokens").cast("double"), F.col("every")), F.lit(0.0)).alias("reached_share"), "can_reach")
    return report, plan_rows


def draw(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (``doc_id``, ``key``, ...) of planned sources with ``source_name`` and ``n_copies``."""
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") / F.lit(float(1 << 53))
    planned = rows.join(F.broadcast(plan.select("key", "source_name", "base", "steps")), "key").withColumn("u", uniform)  # at most MOST_SOURCES rows
    return planned.withColumn("n_copies", F.col("base") + F.size(F.filter("steps", lambda x: x <= F.col("u")))).drop("u", "base", "steps")


def shuffled_copies(documents: DataFrame, targets: DataFrame, seed: int = 11, **options) -> DataFrame:
    """Every copy as a row (``source_name``, ``doc_id``, ``copy_no``, ``text``) in an order random over the whole: copies
    go to partitions and into order by a hash of seed, document and copy. Draws are those of ``mixture``'s report."""
    _, plan = mixture(documents, targets, seed, **options)
    named = documents.select(F.col("doc_id").cast("long"), "text", source_key(F.col("source")).alias("key"))
    each = draw(named, plan, seed).filter("n_copies > 0").select("source_name", "doc_id", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy_no"), "text")
    placed = each.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "copy_no", F.lit("place")))
    return placed.repartition(shuffle_parts(documents.sparkSession), "at").sortWithinPartitions("at").drop("at")
