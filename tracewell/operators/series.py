"""Order-dependent rules over short series and selections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import closure

#: An outage begins below and ends at these shares of the median of the last BASE kept values (fixed values).
ENTER, LEAVE, BASE = 0.85, 0.95, 15


def outage_filter(values: list[float | None]) -> list[bool]:
    """Which values of a series are kept: those outside outages.

    The baseline is the median of the last 15 values kept. A value below 85 % of it begins an outage, one of 95 % or more
    ends it; a value of 0 or less (or null) is always dropped and begins one. While there is no baseline yet a positive value
    is kept, but does not end an outage.
    """
    kept: list[float] = []
    out, down = [], False
    for v in values:
        alive = v is not None and v > 0
        wanted = median(kept[-BASE:]) * (LEAVE if down else ENTER) if kept else None
        keep = alive and (wanted is None or v >= wanted)
        if not alive or wanted is not None:
            down = not keep
        if keep:
            kept.append(v)
        out.append(keep)
    return out


def without_outages(df: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """Rows of each series outside outages; series hold a row a day, so one fits a task. Null entities are one series."""
    packed = df.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col(at).cast("string").alias("at"), F.col(value).cast("double").alias("v")))).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for who, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep = outage_filter([x["v"] for x in line])
                out += [(who, x["at"], x["v"]) for x, k in zip(line, keep, strict=True) if k]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], [entity, at, value])

    return packed.mapInArrow(run, f"{entity} string, {at} string, {value} double")


def forward_reds(nodes: DataFrame, tree: str, idx: str, hits: str, weight: str) -> DataFrame:
    """``nodes`` with ``forward_reds``: the run of nodes without hits that follows a node with hits (or the first node),
    and ``largest_idx``: the first of the greatest positive ``weight`` in the run. Other nodes carry 0 and null."""
    red = ~((F.col(hits) != 0) | (F.col(idx) == 0))
    w = Window.partitionBy(tree).orderBy(idx)
    marked = nodes.withColumn("__red", red).withColumn("__isl", F.sum((~red).cast("int")).over(w))
    runs = marked.filter("__red").groupBy(tree, "__isl").agg(F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col(weight) > 0, F.struct(F.col(weight).alias("w"), (-F.col(idx)).alias("i")))).alias("__m"))
    both = marked.join(runs, [tree, "__isl"], "left")
    out = lambda c, other: F.when(~F.col("__red"), c).otherwise(other)
    return both.select(*nodes.columns, out(F.coalesce("__n", F.lit(0)), F.lit(0)).alias("forward_reds"), out(-F.col("__m.i"), F.lit(None).cast("long")).alias("largest_idx"))


def runs_of(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Neighbouring rows of equal ``value`` merged: ``by``, ``value``, ``first_at``, ``last_at``, ``length``."""
    w = Window.partitionBy(by).orderBy(at)
    change = (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("__c", change).withColumn("__r", F.sum("__c").over(w)).groupBy(by, "__r", value).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("length")).drop("__r")


def greedy_targets(functions: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Functions (``k``, ``cc``, ``argc``, ``bb``, ``hit``) picked one a round by the greatest complexity not yet reached
    at or below them: ``round_no``, ``k``, ``undiscovered_cc``. What a pick reaches counts as hit from then on.

    Candidates have arguments, more than one block, complexity of 20 or more at or below them and 35 or more not reached.
    Ties go to the least ``k``. The closure is cut once; a round joins it with the functions still unhit.
    """
    reach = cut(closure(edges).unionByName(functions.select(F.col("k").alias("src"), F.col("k").alias("dst"))).distinct())
    open_ = cut(functions.filter("not hit").select(F.col("k").alias("dst"), F.col("cc").alias("dcc")))
    total = cut(reach.join(functions.select(F.col("k").alias("dst"), F.col("cc").alias("dcc")), "dst").groupBy("src").agg(F.sum("dcc").alias("total")).filter("total >= 20"))
    able = cut(functions.filter("argc > 0 and bb > 1").select(F.col("k").alias("src")).join(total.select("src"), "src"))
    picks: list[tuple[int, int, int]] = []
    for n in range(1, rounds + 1):
        left = reach.join(open_, "dst").groupBy("src").agg(F.sum("dcc").alias("u")).filter("u >= 35")
        best = left.join(able, "src").join(open_.select(F.col("dst").alias("src")), "src", "left_semi").orderBy(F.desc("u"), "src").limit(1).collect()  # one row
        if not best:
            break
        picks.append((n, best[0]["src"], best[0]["u"]))
        open_ = cut(open_.join(reach.filter(F.col("src") == best[0]["src"]).select("dst"), "dst", "left_anti"))
    return functions.sparkSession.createDataFrame(picks, "round_no int, k long, undiscovered_cc long")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and what of ``old`` has no row of the same key in it; of repeated keys in either all rows stay."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and what of ``new`` has a key that is not stored yet: the first write wins."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def fold_top(rows: list, most: int, size: Callable) -> list:
    """The first ``most`` rows, later ones replacing the first smaller entry."""
    top: list = []
    for r in rows:
        if len(top) < most:
            top.append(r)
            continue
        for i, x in enumerate(top):
            if size(x) < size(r):
                top[i] = r
                break
    return top
