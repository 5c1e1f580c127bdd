"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on the key followed by a secondary order; Spark takes the split points from a sample of
the rows, so a heavy key is cut into as many partitions as its weight asks for. Each partition reduces its piece to
one partial state per key, and the few states of a key are stitched where the pieces meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, shuffle_parts

TIE, PART = "__tie", "__part"


def range_split(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` cut by sampled quantiles of (keys, order) with the partition's number in ``__part``.

    A running row number, which depends on a row's place in the input only, comes last in the order, so that a group of
    exact copies is cut as well.
    """
    n = parts or shuffle_parts(df.sparkSession)
    ranged = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(n, *keys, *order, TIE)
    return ranged.withColumn(PART, F.spark_partition_id())


def split_key_aggregate(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, lows: dict[str, str] | None = None, highs: dict[str, str] | None = None, runs: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """One row per value of ``keys``: ``n_rows`` and the named results, with no task bound to a heavy key.

    ``sums``, ``lows`` and ``highs`` map a result to the column whose sum, minimum or maximum it holds. ``runs`` maps a
    result to the first column of ``order``, whose distinct values it counts: neighbouring pieces of a key that end and
    begin with the same value share it, so one is taken off at each such border.

    Null keys form a group of their own, null values are left out as in SQL (a sum of nothing is null); null counts as no
    distinct value. An empty table gives no rows. Columns not named here never enter the shuffle.
    """
    sums, lows, highs, runs = sums or {}, lows or {}, highs or {}, runs or {}
    if any(c != order[0] for c in runs.values()):
        raise ValueError("runs can only count the first column of the secondary order")
    lead = order[:1] if runs else []
    wanted = [*dict.fromkeys([*keys, *order, *sums.values(), *lows.values(), *highs.values()])]
    pieces = range_split(df.select(*wanted), keys, order, parts)
    state = (
        [F.count(F.lit(1)).alias("n_rows")]
        + [F.sum(c).alias(a) for a, c in sums.items()]
        + [F.min(c).alias(a) for a, c in lows.items()]
        + [F.max(c).alias(a) for a, c in highs.items()]
    )
    merge = (
        [F.sum("n_rows").alias("n_rows")]
        + [F.sum(a).alias(a) for a in sums]
        + [F.min(a).alias(a) for a in lows]
        + [F.max(a).alias(a) for a in highs]
    )
    if not runs:
        return pieces.groupBy(*keys, PART).agg(*state).groupBy(*keys).agg(*merge)
    low, high, dist, before = "__low", "__high", "__distinct", "__before"
    inner = pieces.groupBy(*keys, PART, *lead).agg(*[s for s in state])
    piece = inner.groupBy(*keys, PART).agg(*merge, F.count(lead[0]).alias(dist), F.min(lead[0]).alias(low), F.max(lead[0]).alias(high))
    w = Window.partitionBy(*keys).orderBy(PART)
    shared = F.when(F.col(low) == F.last(high, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    return (
        piece.withColumn(before, shared)
        .groupBy(*keys)
        .agg(*merge, *[(F.sum(dist) - F.sum(before)).alias(a) for a in runs])
    )


def split_key_running(df: DataFrame, keys: list[str], order: list[str], value: str, out_rank: str = "row_rank", out_total: str = "running_total", parts: int | None = None) -> DataFrame:
    """Every row with its rank and the running total of ``value`` within its key, in ``order`` (ties in input order).

    Each piece of a key is numbered on its own; the totals of a key's earlier pieces, at most one open key per partition,
    are then added. Null values add nothing.
    """
    pieces = cut(range_split(df, keys, order, parts))  # both uses below see the same pieces
    own = Window.partitionBy(*keys, PART).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.withColumn(out_rank, F.count(F.lit(1)).over(own)).withColumn(out_total, F.coalesce(F.sum(value).over(own), F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    states = pieces.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__t"))
    borders = states.withColumn("__n0", F.sum("__n").over(earlier)).withColumn("__t0", F.coalesce(F.sum("__t").over(earlier), F.lit(0))).filter("__n0 is not null")
    borders = borders.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(PART).alias("__p"), "__n0", "__t0")
    cond = rows[PART] == borders["__p"]
    for i, k in enumerate(keys):
        cond = cond & rows[k].eqNullSafe(borders[f"__k{i}"])
    joined = rows.join(F.broadcast(borders), cond, "left")  # at most one row a partition: a range cut opens one key only
    return joined.select(*df.columns, (F.col(out_rank) + F.coalesce("__n0", F.lit(0))).alias(out_rank), (F.col(out_total) + F.coalesce("__t0", F.lit(0))).alias(out_total))
