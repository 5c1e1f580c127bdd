"""Snapshot changes against brute force."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from tracewell.functions.paths import resolve_path
from tracewell.operators import snapshots as S

ROW = "p string, d string, k string, f string, v int, w int, t timestamp, seq int, change_kind string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], ROW)


def brute(rows):
    valid, dates = {}, {}
    for p, d, k, f, v, _, t in rows:
        if d is None:
            continue
        dates.setdefault(p, set()).add(d)
        old = valid.get((p, d, k, f))
        if old is None or (t or datetime.min) >= (old[1] or datetime.min):
            valid[(p, d, k, f)] = (v, t)
    out = set()
    for p, ds in dates.items():
        ds = sorted(ds)
        for a, b in zip(ds, ds[1:], strict=False):
            one = {(k, f): v for (q, d, k, f), (v, _) in valid.items() if (q, d) == (p, a)}
            two = {(k, f): v for (q, d, k, f), (v, _) in valid.items() if (q, d) == (p, b)}
            out |= {(p, b, *x, "added") for x in two.keys() - one.keys()} | {(p, b, *x, "removed") for x in one.keys() - two.keys()}
            out |= {(p, b, *x, "changed") for x in one.keys() & two.keys() if one[x] != two[x]}
    return out


def changes(df):
    return {tuple(r) for r in S.snapshot_changes(df, "p", "d", ["k", "f"], ["v"], "t").select("p", "d", "k", "f", "change_kind").collect()}


def test_random(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(900):
        rows.append((rnd.choice(["a", "b", None]), rnd.choice([None, *(f"2025-01-0{i}" for i in range(1, 8))]), rnd.choice(["x", "y", "z", None]), rnd.choice(["f", "", None]), rnd.choice([1, 2, None]), 0, datetime(2025, 1, 1, 0, 0, 0, rnd.randrange(1 << 19))))
    rows += rows[:200]
    got = changes(rows_of(spark, rows))
    assert got == brute(rows) and {x[4] for x in got} == {"added", "removed", "changed"}


def test_empty_and_single_snapshot(spark):
    assert changes(rows_of(spark, [])) == set()
    assert changes(rows_of(spark, [("a", "2025-01-01", "x", "f", 1, 0, None)])) == set()


def test_null_against_value(spark):
    t = datetime(2025, 1, 1)
    rows = [("a", "1", "x", "f", None, 0, t), ("a", "2", "x", "f", None, 0, t), ("a", "3", "x", "f", 0, 0, t), ("a", "4", "x", "f", None, 0, t)]
    assert changes(rows_of(spark, rows)) == {("a", "3", "x", "f", "changed"), ("a", "4", "x", "f", "changed")}


def test_null_version_comes_first(spark):
    t = datetime(2025, 1, 1)
    rows = [("a", "1", "x", "f", 1, 0, t), ("a", "2", "x", "f", 5, 0, None), ("a", "2", "x", "f", 1, 0, t)]
    assert changes(rows_of(spark, rows)) == set()


def test_intervals(spark):
    t = datetime(2025, 1, 1)
    rows = [("a", d, "x", "f", v, 0, t) for d, v in (("1", 1), ("2", 1), ("4", 1), ("5", 2))] + [("a", "3", "y", "f", 1, 0, t)]
    got = sorted((r["k"], r["valid_from"], r["valid_to"], r["next_date"]) for r in S.validity_intervals(rows_of(spark, rows), "p", "d", ["k", "f"], ["v"], "t").collect())
    assert got == [("x", "1", "2", "3"), ("x", "4", "4", "5"), ("x", "5", "5", None), ("y", "3", "3", "4")]


def test_gaps_and_dates_of_any_type(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), f"2025-01-{1 + rnd.randrange(9):02d}", rnd.choice("xyz"), "f", rnd.randrange(2), 0, datetime(2025, 1, 1, 0, 0, i)) for i in range(60)]
    assert changes(rows_of(spark, rows)) == brute(rows)
    typed = rows_of(spark, rows).withColumn("d", F.to_date("d"))
    got = S.snapshot_changes(typed, "p", "d", ["k", "f"], ["v"], "t").select("p", F.col("d").cast("string"), "k", "f", "change_kind")
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_paths(spark):
    cases = {"/a/./b//c": "/a/b/c", "/a/x/../b": "/a/b", "a/../../b": "../b", "/../a": "/a", "/a/b/": "/a/b", "": "", "//a": "/a", "a/..": "", "./a": "a", "/": "/", "..": "..", "/a/b/../../c": "/c", "a.b/..c": "a.b/..c", None: None, "../../a": "../../a"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want string")
    bad = df.withColumn("got", resolve_path(F.col("p"))).filter("not got <=> want").collect()
    assert not bad, bad
