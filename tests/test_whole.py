"""Queries that take all rows where their SQL takes a part of the ids: against brute force, and the SQL without that condition."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
import compare


def brute_reach(edges, start):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    seen, stack = {start}, [start]
    while stack:
        for y in adj.get(stack.pop(), ()):
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return seen


@pytest.fixture(scope="module")
def many_harnesses(spark, sf, tmp_path_factory):
    """The smallest tables with 25 suppliers."""
    d = tmp_path_factory.mktemp("many")
    for p in Path(sf).iterdir():
        if p.name != "supplier.parquet":
            (d / p.name).symlink_to(p)
    kind = spark.read.parquet(f"{sf}/supplier.parquet").schema["s_suppkey"].dataType
    spark.createDataFrame([(i,) for i in range(25)], T.StructType([T.StructField("s_suppkey", kind)])).write.parquet(f"{d}/supplier.parquet")
    return str(d)


def by_sql(folder, sql):
    con = duckdb.connect()
    for t in compare.TABLES:
        at = Path(f"{folder}/{t}.parquet")
        if at.exists():
            con.execute(f"create view {t} as select * from read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return compare.rows_of(cols, res.fetchall())


def test_every_supplier_is_a_harness(spark, many_harnesses):
    parts = [r[0] for r in spark.read.parquet(f"{many_harnesses}/part.parquet").select("p_partkey").collect()]
    edges = [(k, k // 3) for k in parts] + [(k, k // 5) for k in parts] + [(k, k * 3 + 1) for k in parts if k < 4]
    got = {(r["h"], r["k"]) for r in entry.queries()["g3_harness_reach"](spark, many_harnesses).collect()}
    assert got == {(h, k) for h in range(25) for k in brute_reach(edges, max(parts) - 7 * h)}


@pytest.mark.parametrize("name", ["g10_frontend_reach", "j1_reach_by_harness", "h2_unreached"])
def test_all_harnesses_agree_with_sql(spark, many_harnesses, name):
    sql = entry.oracle_sql()[name]
    df = entry.queries()[name](spark, many_harnesses)
    assert compare.rows_of(df.columns, df.collect()) == by_sql(many_harnesses, sql)


def keys_of(spark, sf):
    return [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]


def test_struct_closure_of_every_struct(spark, sf):
    keys = [k for k in keys_of(spark, sf) if k > 0]
    edges = [(k, k // 2) for k in keys if k % 7] + [(k, k // 3) for k in keys if k % 5 == 0]
    below = {a: set().union(*(brute_reach(edges, y) for x, y in edges if x == a)) for a, _ in edges}
    df = entry.queries()["g18_struct_closure"](spark, sf)
    assert {(r["addr"], r["types"], r["least"]) for r in df.collect()} == {(a, len(b), min(b)) for a, b in below.items()}
    assert compare.rows_of(df.columns, df.collect()) == by_sql(sf, entry.oracle_sql()["g18_struct_closure"])


def test_subclasses_below_every_class(spark, sf):
    links = [(k // 4, k) for k in keys_of(spark, sf) if k > 0]
    below = {a: {c for c in brute_reach(links, a) - {a} if c % 3} for a, _ in links}
    df = entry.queries()["g22_concrete_subclasses"](spark, sf)
    assert {(r["root"], r["concrete"], r["first_class"]) for r in df.collect()} == {(a, len(b), min(b)) for a, b in below.items() if b}
    assert compare.rows_of(df.columns, df.collect()) == by_sql(sf, entry.oracle_sql()["g22_concrete_subclasses"])


def test_overlapping_spans_of_all_functions(spark, sf, tmp_path):
    for p in Path(sf).iterdir():
        if p.name != "part.parquet":
            (tmp_path / p.name).symlink_to(p)
    one = spark.read.parquet(f"{sf}/part.parquet")
    one.selectExpr(*[f"'{v}' as {c}" if (v := {"p_brand": "B", "p_type": "T"}.get(c)) else c for c in one.columns]).write.parquet(f"{tmp_path}/part.parquet")  # all in one file
    rows = [(k, n * 10, n * 10 + k % 40) for k, n in one.select("p_partkey", "p_size").collect()]
    want = {(a, b) for a, ab, ae in rows for b, bb, be in rows if a < b and ab <= be and bb <= ae}
    df = entry.queries()["j8_overlapping_spans"](spark, str(tmp_path))
    got = [(r["k"], r["other"]) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    assert compare.rows_of(df.columns, df.collect()) == by_sql(tmp_path, entry.oracle_sql()["j8_overlapping_spans"])


def test_call_tree_of_every_entry(spark, sf):
    from tracewell.plans.domain import Tables

    calls = {}
    for r in Tables(spark, sf).cs.filter("site_dst is not null and src_func is not null").select("project_name", "src_func", "site_dst").distinct().collect():
        calls.setdefault(r["project_name"], []).append((r["src_func"], r["site_dst"]))
    got = {}
    for r in entry.queries()["g13_calltree_text"](spark, sf).collect():
        got.setdefault((r["project_name"], r["entry_function"]), set()).add(r["function_name"])
    for ns, edges in calls.items():
        reach = {f: brute_reach(edges, f) for f in {a for a, _ in edges}}
        want = {f for f in reach if all(a in reach[f] and f <= a for a in reach if f in reach[a])}
        assert {e for p, e in got if p == ns} == want
        assert all(got[(ns, e)] == reach[e] for e in want)
    assert len(got) > len(calls)


def test_entries_of_cycles():
    from tracewell.operators import graph as G

    calls = {f: [(c, 1) for c in to] for f, to in {"m": "b", "x": "y", "y": "xa", "a": "b", "s": "s"}.items()}
    assert G.call_tree_entries(calls) == ["m", "s", "x"]


def test_call_paths_to_every_called_function(spark, sf):
    from tracewell.plans.domain import Tables

    t = Tables(spark, sf)
    known = {tuple(r) for r in t.ff.select("project_name", "function_name").collect()}
    callers = {}
    for ns, a, b in t.cs.select("project_name", "src_func", "site_dst").distinct().collect():
        if (ns, b) in known and a is not None:
            callers.setdefault((ns, b), set()).add(a)

    def has_path(ns, target):  # an outermost caller is above it
        edges = [(b, a) for (p, b), found in callers.items() if p == ns for a in found]
        return any((ns, f) not in callers for f in brute_reach(edges, target))

    rows = entry.queries()["g7_call_paths"](spark, sf).collect()
    assert {(r["project_name"], r["function_name"]) for r in rows} == {k for k in callers if has_path(*k)}
    assert any((r["project_name"], r["function_name"]) in {(ns, a) for (ns, _), found in callers.items() for a in found} for r in rows)
    for r in rows:
        path = r["call_path"].split(" > ")
        assert path[-1] == r["function_name"] and (r["project_name"], path[0]) not in callers
        assert all(a in callers[(r["project_name"], b)] for a, b in zip(path, path[1:]))


def test_whole_paths_to_sinks(spark):
    from tracewell.plans import composed

    edges = "m>a a>b b>xp_open n>c c>xp_open k>d d>e e>f f>xp_open m>xp_log".split()

    class Few:
        cs = spark.createDataFrame([("p", *e.split(">")) for e in edges], "project_name string, src_func string, site_dst string")

        af = spark.createDataFrame([("p", f, 1.0 if f in "mankd" else 0.0) for f in "mabnckdef"], "project_name string, function_name string, line_cov double")

    two = [(r["path_no"], r["functions"], r["call_path"]) for r in composed.t6_shortest_paths(Few()).filter("sink = 'xp_open'").orderBy("path_no").collect()]
    assert two == [(1, 3, "n > c > xp_open"), (2, 4, "m > a > b > xp_open")]
    ends = {r["last_caller"]: (r["paths"], r["first_path"]) for r in composed.a20_call_paths_by_end(Few()).filter("sink = 'xp_open'").collect()}
    assert ends == {"b": (1, "m > a > b"), "c": (1, "n > c"), "f": (1, "k > d > e > f")}
    got = {(r["sink"], r["call_path"]): (r["callers_hit"], r["blocker"]) for r in composed.j14_sink_blockers(Few()).collect()}
    assert got == {("xp_open", "m > a > b"): (0, "a"), ("xp_open", "n > c"): (0, "n"), ("xp_open", "k > d > e > f"): (0, "d"), ("xp_log", "m"): (1, None)}
