"""What changed between consecutive full snapshots of a table.

Rows never meet the calendar of snapshots before they are folded: after one fold of versions, neighbouring rows of one key
with equal values become runs that carry their dates. Runs, which are few, are then joined with the calendar; one
that spans more snapshots than it has rows is cut at its gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import same, stored

HASH = "__hash"


def row_hash(*columns: str):
    """64-bit hash of the columns in which null differs from every value; compared between neighbours of one key only."""
    return F.xxhash64(*[x for c in columns for x in (F.isnull(c), F.col(c))])


def version_number(df: DataFrame, version: str):
    """A version column as a long; null comes before all others."""
    c = F.col(version)
    number = F.unix_micros(c.cast("timestamp")) if dict(df.dtypes)[version].startswith(("timestamp", "date")) else c.cast("long")
    return F.coalesce(number, F.lit(-(1 << 62)))


def snapshot_calendar(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Snapshots of each entity: ``__e``, ``__d``, its number ``seq`` (from 1) and the ``next_day`` with a snapshot. Null
    dates are no snapshot."""
    dates = df.select(F.col(entity).alias("__e"), F.col(date).alias("__d")).filter("__d is not null").distinct()
    w = Window.partitionBy("__e").orderBy("__d")
    return dates.select("__e", "__d", F.row_number().over(w).alias("seq"), F.lead("__d").over(w).alias("next_day"))


def _folded(df: DataFrame, entity: str, date: str, keys: list[str], values: list[str], version: str) -> DataFrame:
    """Neighbouring rows of one key with equal values as one: ``entity``, ``keys``, ``__a``, ``__b`` (first and last date),
    ``days`` (all of them in order), ``__hash``."""
    key = [entity, *keys]
    rows = df.select(*key, F.col(date).alias("__d"), version_number(df, version).alias("__v"), row_hash(*values).alias(HASH)).filter("__d is not null")
    # Copies fold on the map side into one row per version; the winner is picked after the shuffle that the runs need anyway.
    versions = rows.groupBy(*key, "__d", "__v").agg(F.max(HASH).alias(HASH))
    w = Window.partitionBy(*key).orderBy("__d", "__v")
    valid = versions.withColumn("__after", F.lead("__d").over(w)).filter("__after is null or __after <> __d")
    w = Window.partitionBy(*key).orderBy("__d")
    opens = F.coalesce(F.lag(HASH).over(w) != F.col(HASH), F.lit(True))
    numbered = valid.withColumn("__run", opens.cast("int")).withColumn("__run", F.sum("__run").over(w))
    runs = numbered.groupBy(*key, "__run").agg(F.min("__d").alias("__a"), F.max("__d").alias("__b"), F.sort_array(F.collect_list("__d")).alias("days"), F.min(HASH).alias(HASH))
    return runs.drop("__run")


def _runs(df: DataFrame, calendar: DataFrame, entity: str, date: str, keys: list[str], values: list[str], version: str) -> DataFrame:
    """Longest runs of consecutive snapshots with equal values: ``entity``, ``keys``, ``first_seq``, ``last_seq``,
    ``first_day``, ``last_day``, ``next_day`` (null after the entity's last snapshot), ``__hash``."""
    at = lambda seq, day, *more: calendar.select(F.col("__e").alias(f"__e_{seq}"), F.col("__d").alias(f"__k_{seq}"), F.col("seq").alias(seq), F.col("__d").alias(day), *[F.col(c) for c in more])
    found = stored(_folded(df, entity, date, keys, values, version))
    first, last = at("first_seq", "first_day"), at("last_seq", "last_day", "next_day")
    met = found.join(first, same(found, first, [(entity, "__e_first_seq"), ("__a", "__k_first_seq")]))
    met = met.join(last, same(met, last, [(entity, "__e_last_seq"), ("__b", "__k_last_seq")]))
    whole = F.col("last_seq") - F.col("first_seq") + 1 == F.size("days")
    out = [entity, *keys, "first_seq", "last_seq", "first_day", "last_day", "next_day", HASH]
    placed = stored(met.select(*out, whole.alias("__whole"), F.when(~whole, F.col("days")).alias("days")))
    # What a gap interrupts is told apart by the difference of snapshot number and place.
    torn = placed.filter("not __whole").select(entity, *keys, HASH, F.col("first_seq").alias("__of"), F.posexplode("days").alias("__i", "__x"))
    each = calendar.select("__e", F.col("__d").alias("__y"), "seq", "next_day")
    torn = torn.join(each, same(torn, each, [(entity, "__e"), ("__x", "__y")]))
    ends = lambda how, c: how(F.struct("seq", "__x", "next_day"))[c]
    pieces = torn.groupBy(entity, *keys, "__of", (F.col("seq") - F.col("__i")).alias("__gap")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("__x").alias("first_day"), F.max("__x").alias("last_day"), ends(F.max, "next_day").alias("next_day"), F.min(HASH).alias(HASH))
    return placed.filter("__whole").select(*out).unionByName(pieces.select(*out))


def validity_intervals(df: DataFrame, entity: str, date: str, keys: list[str], values: list[str], version: str) -> DataFrame:
    """Longest runs of consecutive snapshots in which a key is there with the same ``values``.

    Columns: ``entity``, ``keys``, ``first_seq``, ``last_seq``, ``valid_from``, ``valid_to`` (dates of the first and last
    snapshot of the run), ``next_date`` (the snapshot after the run, null if there is none).

    Of several deliveries of one (entity, date, keys) the greatest ``version`` holds, among equal ones the greatest row
    hash; a null version comes before all others. Nulls in entity and keys are values like any other. Rows without a date
    are left out; dates may be of any type with an order (a date takes a third of the room of a text).
    """
    runs = _runs(df, stored(snapshot_calendar(df, entity, date)), entity, date, keys, values, version)
    return runs.select(entity, *keys, "first_seq", "last_seq", F.col("first_day").alias("valid_from"), F.col("last_day").alias("valid_to"), F.col("next_day").alias("next_date"))


def snapshot_changes(df: DataFrame, entity: str, date: str, keys: list[str], values: list[str], version: str) -> DataFrame:
    """Change events between each two neighbouring snapshots of an entity: ``entity``, ``date`` (the later one), ``keys``,
    ``change_kind``: ``added``, ``removed`` or ``changed`` (``values`` differ; null differs from a value, not from null).

    A run that begins where no other ends is an addition, one that ends where no other begins a removal, two that touch a
    change. An entity's first snapshot has nothing to be compared with, so it gives no events. Versions, nulls and missing
    dates are treated as in ``validity_intervals``.
    """
    runs = _runs(df, stored(snapshot_calendar(df, entity, date)), entity, date, keys, values, version)
    w = Window.partitionBy(entity, *keys).orderBy("first_seq")
    touches = F.coalesce(F.lag("last_seq").over(w) == F.col("first_seq") - 1, F.lit(False))
    followed = F.coalesce(F.lead("first_seq").over(w) == F.col("last_seq") + 1, F.lit(False))
    seen = runs.withColumn("__touches", touches).withColumn("__followed", followed)
    start = F.when(F.col("__touches"), "changed").when(F.col("first_seq") > 1, "added")
    end = F.when(~F.col("__followed") & F.col("next_day").isNotNull(), "removed")
    events = F.array(F.struct(F.col("first_day").alias("__s"), start.alias("change_kind")), F.struct(F.col("next_day").alias("__s"), end.alias("change_kind")))
    told = seen.select(entity, *keys, F.inline(events)).filter("change_kind is not null")
    return told.select(entity, F.col("__s").alias(date), *keys, "change_kind")
