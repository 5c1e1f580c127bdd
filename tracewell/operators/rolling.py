"""Totals over trailing periods by block decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = "__day"


def daily_series(df: DataFrame, entity: list[str], date: str, values: list[str], version: str, anchor: str) -> DataFrame:
    """One row for each calendar day from an entity's first to its last day with a value of ``anchor``.

    Of several rows of a day the greatest ``version`` holds (a null version comes first; among equal ones the greatest
    values), even if its values are null. Texts that are no date and null dates are left out; NaN and infinite values
    count as null. An entity without any value gives no rows. Result: ``entity``, ``date`` (type date), ``values``.
    """
    def finite(c: str):
        kind = dict(df.dtypes)[c]
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) if kind in ("double", "float") else F.col(c)

    clean = df.select(*entity, F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd").alias(date), F.col(version).alias("__v"), F.struct(*[finite(c).alias(c) for c in values]).alias("__row")).filter(F.col(date).isNotNull())
    days = clean.groupBy(*entity, date).agg(F.max(F.struct("__v", "__row")).alias("__m")).select(*entity, date, "__m.__row.*")
    span = days.filter(F.col(anchor).isNotNull()).groupBy(*entity).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    calendar = span.select(*entity, F.explode(F.sequence("__a", "__b")).alias(date)).withColumn("__in", F.lit(1))
    blank = calendar.select(*entity, date, "__in", *[F.lit(None).cast(dict(days.dtypes)[c]).alias(c) for c in values])
    both = blank.unionByName(days.withColumn("__in", F.lit(None).cast("int")))
    return both.groupBy(*entity, date).agg(F.max("__in").alias("__in"), *[F.max(c).alias(c) for c in values]).filter("__in = 1").drop("__in")


def trailing_totals(series: DataFrame, entity: list[str], date: str, values: list[str], lengths: list[int]) -> DataFrame:
    """For each day of a gapless series and each length L: ``n_<value>_<L>`` and ``sum_<value>_<L>`` over the day and the
    L - 1 days before it (fewer at the start; null values count for nothing, a sum of nothing is null).

    The calendar is cut into blocks of L days. Inside a block, prefix and suffix sums are running sums; the trailing total
    of day d is the prefix up to d plus the suffix from d - L + 1, which lies in the block before, so each value is added
    twice whatever L is. A series holds one row a day, so its length is bounded by the calendar and not by the rows
    delivered.
    """
    day = series.withColumn(DAY, F.unix_date(date))
    whole = Window.partitionBy(*entity).orderBy(DAY)
    out = day
    for size in lengths:
        block = f"__b{size}"
        out = out.withColumn(block, F.floor(F.col(DAY) / size))
    for size in lengths:
        inside = Window.partitionBy(*entity, f"__b{size}")
        prefix = inside.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
        suffix = inside.orderBy(F.desc(DAY)).rowsBetween(Window.unboundedPreceding, 0)
        for v in values:
            for tag, w in (("p", prefix), ("s", suffix)):
                out = out.withColumn(f"__{tag}n_{v}_{size}", F.count(v).over(w)).withColumn(f"__{tag}t_{v}_{size}", F.sum(v).over(w))
    ends = lambda size: F.pmod(F.col(DAY), F.lit(size)) == size - 1
    picked = []
    for v in values:
        for size in lengths:
            n, t = f"n_{v}_{size}", f"t_{v}_{size}"
            # Before the series is L days long, the suffix of its first day stands for the missing one, if that lies a block back.
            back_n, back_t = (F.lag(f"__s{x}", size - 1).over(whole) for x in (n, t))
            opening = F.col(f"__b{size}") > F.first(f"__b{size}").over(whole)
            first_n, first_t = (F.when(opening, F.first(f"__s{x}").over(whole)) for x in (n, t))
            back_n, back_t = F.coalesce(back_n, first_n), F.when(back_n.isNull(), first_t).otherwise(back_t)
            count = F.when(ends(size), F.col(f"__p{n}")).otherwise(F.col(f"__p{n}") + F.coalesce(back_n, F.lit(0)))
            left = F.col(f"__p{t}")
            total = F.when(ends(size), left).otherwise(F.coalesce(left + back_t, left, back_t))
            picked += [count.alias(f"n_{v}_{size}"), total.alias(f"sum_{v}_{size}")]
    return out.select(*entity, date, *values, *picked)
