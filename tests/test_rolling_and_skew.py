"""Trailing totals and heavy keys against brute force."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest

from tracewell.operators import rolling as R
from tracewell.operators import skew as S

DAY0 = date(2025, 1, 1)


@pytest.mark.parametrize("lengths", [[1, 7, 30], [2, 3]])
def test_trailing_against_brute_force(spark, lengths):
    rnd = random.Random(7)
    rows = []
    for e in ("a", "b", None, "null only"):
        for d in range(rnd.randrange(70)):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                v = None if e == "null only" or rnd.random() < 0.2 else rnd.choice([1.5, 2.0, float("nan"), float("inf"), -3.25])
                rows.append((e, str(DAY0 + timedelta(d)), v, datetime(2025, 5, 1, 0, 0, 0, rnd.randrange(1 << 19)), 1))
    rows += [("a", None, 5.0, None, 1), ("a", "no date", 5.0, None, 1), *rows[:20]]
    df = spark.createDataFrame(rows, "e string, d string, v double, t timestamp, n_v_7 int")
    valid = {}
    for e, d, v, t, _ in rows:
        if d in (None, "no date"):
            continue
        if (e, d) not in valid or t >= valid[(e, d)][0]:
            valid[(e, d)] = (t, None if v is None or v != v or abs(v) == float("inf") else v)
    want = {}
    for e in {x for x, _ in valid}:
        days = {date.fromisoformat(d): v for (x, d), (_, v) in valid.items() if x == e}
        has = [d for d, v in days.items() if v is not None]
        if not has:
            continue
        for i in range((max(has) - min(has)).days + 1):
            at = min(has) + timedelta(i)
            for n in lengths:
                vs = [days[x] for x in (at - timedelta(j) for j in range(n)) if x >= min(has) and days.get(x) is not None]
                want[(e, at, n)] = (len(vs), round(sum(vs), 6) if vs else None)
    series = R.daily_series(df, ["e"], "d", ["v"], "t", "v")
    got = {}
    for r in R.trailing_totals(series, ["e"], "d", ["v"], lengths).collect():
        for n in lengths:
            s = r[f"sum_v_{n}"]
            got[(r["e"], r["d"], n)] = (r[f"n_v_{n}"], None if s is None else round(s, 6))
    assert got == want


def test_trailing_empty(spark):
    df = spark.createDataFrame([], "e string, d string, v double, t timestamp")
    assert R.trailing_totals(R.daily_series(df, ["e"], "d", ["v"], "t", "v"), ["e"], "d", ["v"], [7]).collect() == []


def skewed(spark, n=2000):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else rnd.choice(["x", "y", None]), rnd.choice("abc"), rnd.choice([1, 2, None]), i) for i in range(n)]
    rows += [("copies", "a", 1, 0)] * 700
    return rows, spark.createDataFrame(rows, "k string, o string, v int, n_rows int")


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_split_aggregate(spark, parts):
    rows, df = skewed(spark)
    got = {r["k"]: (r["n"], r["s"], r["lo"], r["hi"], r["os"]) for r in S.split_key_aggregate(df.drop("n_rows"), ["k"], ["o"], {"s": "v"}, {"lo": "o"}, {"hi": "v"}, {"os": "o"}, parts).withColumnRenamed("n_rows", "n").collect()}
    by = defaultdict(list)
    for k, o, v, _ in rows:
        by[k].append((o, v))
    want = {k: (len(x), sum(v for _, v in x if v), min(o for o, _ in x), max(v for _, v in x if v), len({o for o, _ in x})) for k, x in by.items()}
    assert got == want


def test_heavy_keys_are_split(spark):
    _, df = skewed(spark)
    pieces = S.range_split(df, ["k"], ["o"], 12).groupBy(S.PART).count().collect()
    sizes = [r["count"] for r in pieces]
    assert max(sizes) < 3 * sum(sizes) / len(sizes) and len(sizes) >= 10


@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, parts):
    rows, df = skewed(spark, 600)
    got = S.split_key_running(df, ["k"], ["o", "n_rows"], "v", parts=parts).collect()
    by = defaultdict(list)
    for k, o, v, n in rows:
        by[k].append((o, n, v))
    want = Counter()
    for k, x in by.items():
        total = 0
        for i, (o, n, v) in enumerate(sorted(x, key=lambda r: r[:2])):
            total += v or 0
            want[(k, o, n, i + 1, total)] += 1
    assert Counter((r["k"], r["o"], r["n_rows"], r["row_rank"], r["running_total"]) for r in got) == want


def test_skew_empty(spark):
    df = spark.createDataFrame([], "k string, o string, v int")
    assert S.split_key_aggregate(df, ["k"], ["o"], {"s": "v"}, runs={"os": "o"}).collect() == []
    assert S.split_key_running(df, ["k"], ["o"], "v").collect() == []
