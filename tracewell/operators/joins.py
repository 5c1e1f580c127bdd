"""Joins that need more than equality: as-of, range, overlap, prioritised keys, positional merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, pick: list[str]) -> DataFrame:
    """``left`` with the columns ``pick`` of the ``right`` row of the same ``by`` with the greatest ``right_at`` at or below
    ``left_at`` (null if none). Ties take the greatest ``pick``. Null keys and places match nothing.

    One sort of both sides together and a running last value, so nothing is multiplied out.
    """
    marks = right.filter(F.col(by).isNotNull() & F.col(right_at).isNotNull()).groupBy(F.col(by).alias("__by"), F.col(right_at).alias("__at")).agg(F.max(F.struct(*pick)).alias("__pick"))
    both = left.select("*", F.col(by).alias("__by"), F.col(left_at).alias("__at"), F.lit(None).cast(marks.schema["__pick"].dataType).alias("__pick"), F.lit(1).alias("__side"))
    tail = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema], "__by", "__at", "__pick", F.lit(0).alias("__side"))
    w = Window.partitionBy("__by").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(tail).withColumn("__hit", F.last("__pick", ignorenulls=True).over(w)).filter("__side = 1")
    usable = F.col("__by").isNotNull() & F.col("__at").isNotNull()
    return found.select(*left.columns, *[F.when(usable, F.col(f"__hit.{c}")).alias(c) for c in pick])


def within_range(points: DataFrame, ranges: DataFrame, by: str, at: str, low: str, high: str, width: int = 64) -> DataFrame:
    """Rows of ``points`` with each row of ``ranges`` of the same ``by`` whose [low, high] holds ``at``.

    Ranges are cut into cells of ``width`` so that the join is on (by, cell) and a key with many ranges is spread out.
    """
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(low, high) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, [by, "__cell"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("__cell")


def overlapping(left: DataFrame, right: DataFrame, by: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = 64) -> DataFrame:
    """Pairs of the same ``by`` whose closed spans overlap, each once: only in the first cell that both touch."""
    (a, b), (c, d) = left_span, right_span
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.greatest(lo, hi) / width)))
    both = left.withColumn("__cell", cell(a, b)).join(right.withColumn("__cell", cell(c, d)), [by, "__cell"])
    first = F.floor(F.greatest(a, c) / width)
    return both.filter((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__cell") == first)).drop("__cell")


def resolve_by_priority(left: DataFrame, key: str, right: DataFrame, right_key: str, forms: list) -> DataFrame:
    """``left`` with ``resolved``: the right key found by the first form of ``key`` that exists (null if none does).

    ``forms`` are functions of a column, tried in order; all candidates go through one equi-join.
    """
    known = right.select(F.col(right_key).alias("__k")).dropna().distinct()
    asked = left.select(key).distinct().select(key, F.posexplode(F.array(*[f(F.col(key)) for f in forms])).alias("__rank", "__k"))
    best = asked.join(known, "__k").groupBy(key).agg(F.min(F.struct("__rank", "__k")).alias("__m")).select(key, F.col("__m.__k").alias("resolved"))
    return left.join(best, key, "left")


def merge_positional(coverage: DataFrame, order: str, func: str, pos: str, line: str, hits: str) -> DataFrame:
    """Line coverage of several profiles merged onto the first profile (least ``order``) that has a function.

    A place (func, pos) of that profile keeps its line with the greatest hits of all profiles that have the same line
    there; profiles with another line at the place drop it (the first differing one ends it for good).
    """
    first = Window.partitionBy(func)
    w = Window.partitionBy(func, pos).orderBy(order)
    rows = coverage.withColumn("__first", F.min(order).over(first))
    base = F.first(F.when(F.col(order) == F.col("__first"), F.col(line)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = rows.withColumn("__line", base).filter("__line is not null")
    return seen.groupBy(func, pos).agg(F.min("__line").alias(line), F.max(hits).alias(hits), F.max((F.col(line) != F.col("__line")).cast("int")).alias("__off")).filter("__off = 0").drop("__off")


def suffix_join(long: DataFrame, key: str, short: DataFrame, short_key: str) -> DataFrame:
    """Rows of both sides where ``key`` ends with ``short_key``: all endings of the distinct keys, joined by equality.
    Null and empty ``short_key`` match nothing."""
    ends = long.select(key).distinct().filter(F.length(key) > 0).select(key, F.explode(F.sequence(F.lit(1), F.length(key))).alias("__i")).select(key, F.expr(f"substring(`{key}`, __i)").alias("__end"))
    lengths = short.select(F.length(short_key).alias("__n")).distinct()
    asked = ends.withColumn("__n", F.length("__end")).join(lengths, "__n", "left_semi").drop("__n")  # endings of lengths that occur
    return short.join(asked, short[short_key] == asked["__end"]).drop("__end").join(long, key)


def branch_blockers(coverage: DataFrame, sides: DataFrame, hit_lines: DataFrame, key: list[str]) -> DataFrame:
    """Sides of branches that are never taken while another side of the branch is.

    ``coverage``: ``key``, ``line``, ``hits`` (a count a side; of a switch, ``switched``, the first two are the switch
    itself). ``sides``: ``key``, ``side_no``, ``side_line`` and four complexities. ``hit_lines``: lines of functions (``key``
    without its last column, ``side_line``) that ran. A branch counts if it has as many counts as sides. A side counts if it
    does not lie before its branch and its own line never ran (else it is fallen through to). ``hit_difference`` is the
    greatest of the counts, for a switch also of its own.
    """
    taken = coverage.withColumn("own", F.when(F.col("switched"), F.array_max(F.slice("hits", 1, 2))).otherwise(-1)).withColumn("counts", F.when(F.col("switched"), F.slice("hits", 3, 1 << 20)).otherwise(F.col("hits")))
    mixed = taken.filter(F.exists("counts", lambda n: n == 0) & F.exists("counts", lambda n: n != 0))
    asked = mixed.select(*key, "line", F.size("counts").alias("n"), F.greatest(F.array_max("counts"), "own").cast("int").alias("hit_difference"), F.posexplode("counts").alias("side_no", "count")).filter("count = 0")
    sized = sides.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    met = asked.join(sized, [*key, "n"], "left_semi").join(sides, [*key, "side_no"]).filter("side_line >= line")
    cold = met.join(hit_lines, [*key[:-1], "side_line"], "left_anti")
    return cold.select(*key, "side_no", "side_line", "unique_not_covered_cc", "unique_reachable_cc", "not_covered_cc", "reachable_cc", "hit_difference")


def latest_by(df: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Row of greatest ``version`` of each key (nulls are a key; null versions come first; ties take the greatest row)."""
    best = df.groupBy(*keys).agg(F.max(F.struct(version, *columns)).alias("__m"))
    return best.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in columns])


def percentage(part: Column, whole: Column) -> Column:
    """Guarded percentage: 0 where there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double") * F.lit(100.0).cast("double"), whole.cast("double")), F.lit(0.0).cast("double"))
