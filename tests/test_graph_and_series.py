"""Graph, join and series operators against brute force."""

import random
from statistics import median

from tracewell.operators import graph as G
from tracewell.operators import joins as J
from tracewell.operators import series as S


def brute_closure(edges):
    adj = {}
    for a, b in edges:
        if a is not None and b is not None:
            adj.setdefault(a, set()).add(b)
    out = set()
    for a in adj:
        seen, stack = set(), list(adj[a])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += adj.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def test_closure_and_reach(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)] + [(1, 1), (1, 1), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = brute_closure(edges)
    assert {tuple(r) for r in G.closure(df).collect()} == want
    got = G.reach_from(df, spark.createDataFrame([(0,), (5,), (99,), (None,)], "start long")).collect()
    assert {tuple(r) for r in got} == {(a, b) for a, b in want if a in (0, 5)} | {(x, x) for x in (0, 5, 99)}
    assert G.closure(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_parents(spark):
    rnd = random.Random(2)
    rows = []
    for h in range(3):
        depth = 0
        for i in range(60):
            rows.append((h, i, depth))
            depth = max(1, rnd.randrange(depth + 2))
    got = {(r["h"], r["idx"]): r["parent_idx"] for r in G.parents_from_depth(spark.createDataFrame(rows, "h int, idx int, depth int"), "h", "idx", "depth").collect()}
    for h, i, d in rows:
        assert got[(h, i)] == max((j for g, j, e in rows if g == h and j < i and e == d - 1), default=None)


def test_order_dependent_graph_rules():
    assert G.function_depths(["a", "b", "c"], {"a": ["b"], "b": ["c"], "c": []}) == {"a": 2, "b": 1, "c": 0}
    assert G.function_depths(["c", "b", "a"], {"a": ["b"], "b": ["c"]}) == {"c": 0, "b": 1, "a": 2}
    assert G.function_depths(["a", "b"], {"a": ["b"], "b": ["a"]}) == {"a": 3, "b": 4}
    assert G.call_tree_lines("m", {"m": [("a", 1), ("b", 2)], "a": [("b", 3)], "b": [("m", 4)]}) == [(0, "m", -1), (1, "a", 1), (2, "b", 3), (3, "m", 4), (1, "b", 2)]
    assert G.call_paths("t", {"t": ["a", "b"], "a": ["r"], "b": ["r", "a"]}) == [["r", "b", "t"]]
    assert G.call_paths("t", {"t": ["a"], "a": ["t"]}) == []


def test_asof_and_ranges(spark):
    rnd = random.Random(3)
    keys = ["x", "y", None]
    left = [(i, rnd.choice(keys), rnd.choice([None, *range(60)])) for i in range(150)]
    right = [(rnd.choice(keys), rnd.choice([None, *range(60)]), rnd.choice(["p", "q", None])) for _ in range(60)]
    dl, dr = spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "k string, a int, name string")
    got = {r["i"]: (r["a"], r["name"]) for r in J.asof_backward(dl, dr, "k", "at", "a", ["a", "name"]).collect()}
    for i, k, at in left:
        hits = [(a, n is not None, n or "", n) for q, a, n in right if q == k and q is not None and a is not None and at is not None and a <= at]
        best = max(hits, default=None)
        assert got[i] == ((best[0], best[3]) if best else (None, None))
    spans = [(j, rnd.choice("xy"), a, a + rnd.randrange(200)) for j in range(40) for a in [rnd.randrange(300)]]
    ds = spark.createDataFrame(spans, "j int, k string, lo int, hi int")
    points = [(i, rnd.choice("xy"), rnd.randrange(500)) for i in range(80)]
    got = sorted((r["i"], r["j"]) for r in J.within_range(spark.createDataFrame(points, "i int, k string, at int"), ds, "k", "at", "lo", "hi").collect())
    assert got == sorted((i, j) for i, k, at in points for j, q, lo, hi in spans if q == k and lo <= at <= hi)
    other = ds.selectExpr("j as j2", "k", "lo as lo2", "hi as hi2")
    got = sorted((r["j"], r["j2"]) for r in J.overlapping(ds, other, "k", ("lo", "hi"), ("lo2", "hi2")).collect())
    assert got == sorted((a, b) for a, k, lo, hi in spans for b, q, lo2, hi2 in spans if k == q and lo <= hi2 and lo2 <= hi)


def test_merge_and_priority(spark):
    rows = [(1, "f", 0, 10, 2), (1, "f", 1, 11, 0), (2, "f", 0, 10, 5), (2, "f", 1, 99, 7), (2, "f", 2, 12, 1), (2, "g", 0, 1, 1)]
    got = sorted(map(tuple, J.merge_positional(spark.createDataFrame(rows, "h int, f string, pos int, line int, hits int"), "h", "f", "pos", "line", "hits").collect()))
    assert got == [("f", 0, 10, 5), ("g", 0, 1, 1)]
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([("A",), ("b",), ("Z",), (None,), ("b",)], "k string")
    known = spark.createDataFrame([("a",), ("b",), ("B",)], "n string")
    got = sorted(((r["k"] or "", r["resolved"]) for r in J.resolve_by_priority(asked, "k", known, "n", [lambda c: c, F.lower]).collect()), key=repr)
    assert got == [("", None), ("A", "a"), ("Z", None), ("b", "b"), ("b", "b")]


def test_outages():
    good = [100.0] * 20
    assert S.outage_filter([*good, 80, 90, 95, 0, 94, 96]) == [True] * 20 + [False, False, True, False, False, True]
    assert S.outage_filter([]) == [] and S.outage_filter([None, 0, -1, 5]) == [False, False, False, True]
    rnd = random.Random(4)
    for _ in range(50):
        values = [rnd.choice([0, 50, 84, 86, 94, 96, 100, None]) for _ in range(40)]
        kept, down = [], False
        for v, k in zip(values, S.outage_filter(values), strict=True):
            if not v:
                down = True
                assert not k
            elif not kept:  # no baseline yet: kept, but the outage goes on
                assert k
                kept.append(v)
            else:
                down = v < (0.95 if down else 0.85) * median(kept[-15:])
                assert k is not down
                kept += [v] * k
    assert S.outage_filter([0, 100, 90, 96]) == [False, True, False, True]


def test_first_names(spark):
    links = [(1, 2, None), (2, 3, None), (3, None, "n"), (4, 5, None), (5, 4, None), (6, 7, None), (None, 1, "x"), (3, None, "n"), (8, 8, None)] + [(100 + i, 101 + i, None) for i in range(150)] + [(250, None, "far")]
    got = {(r["a"], r["name"], r["hops"]) for r in G.first_names(spark.createDataFrame(links, "a long, b long, name string"), "a", "b", "name").collect()}
    assert got == {(1, "n", 2), (2, "n", 1), (3, "n", 0), (250, "far", 0)} | {(100 + i, "far", 150 - i) for i in range(150)}


def test_suffix_join(spark):
    long = spark.createDataFrame([("/a/b.c", 1), ("/x/b.c", 2), ("b.c", 3), (None, 4), ("", 5)], "path string, i int")
    short = spark.createDataFrame([("b.c", "s"), ("/b.c", "t"), ("", "u"), (None, "v"), ("zz", "w")], "tail string, j string")
    got = sorted((r["i"], r["j"]) for r in J.suffix_join(long, "path", short, "tail").collect())
    assert got == [(1, "s"), (1, "t"), (2, "s"), (2, "t"), (3, "s")]


def test_branch_blockers(spark):
    coverage = [("f", "b:10,1", 10, [0, 5], False), ("f", "b:20,1", 20, [3, 4, 0, 2], True), ("f", "b:30,1", 30, [0, 0], False), ("f", "b:40,1", 40, [1, 0, 0], False), ("f", "b:50,1", 50, [0, 7], False), ("f", "b:60,1", 60, [7, 0], False)]
    sides = [("f", b, i, n, 1, 2, 3, 4) for b, ns in (("b:10,1", (11, 12)), ("b:20,1", (21, 22)), ("b:30,1", (31, 32)), ("b:40,1", (41, 42)), ("b:50,1", (49, 51)), ("b:60,1", (61, 62))) for i, n in enumerate(ns)]
    dc = spark.createDataFrame(coverage, "fn string, branch string, line int, hits array<int>, switched boolean")
    ds = spark.createDataFrame(sides, "fn string, branch string, side_no int, side_line int, unique_not_covered_cc int, unique_reachable_cc int, not_covered_cc int, reachable_cc int")
    got = {(r["branch"], r["side_no"], r["side_line"], r["hit_difference"]) for r in J.branch_blockers(dc, ds, spark.createDataFrame([("f", 62)], "fn string, side_line int"), ["fn", "branch"]).collect()}
    # taken on both sides or none, of another number of sides, before its branch, or on a line that ran: no blocker
    assert got == {("b:10,1", 0, 11, 5), ("b:20,1", 0, 21, 4)}


def test_forward_reds(spark):
    rnd = random.Random(5)
    rows = [(t, i, rnd.choice([0, 0, 0, 3]), rnd.choice([0, 1, 5, 5])) for t in range(6) for i in range(40)]
    got = {(r["t"], r["i"]): (r["forward_reds"], r["largest_idx"]) for r in S.forward_reds(spark.createDataFrame(rows, "t int, i long, h int, w int"), "t", "i", "h", "w").collect()}
    by = {(t, i): (h, w) for t, i, h, w in rows}
    for t, i, h, _ in rows:
        run = []
        if h or i == 0:
            j = i + 1
            while (t, j) in by and not by[(t, j)][0]:
                run.append(j)
                j += 1
        best = max((by[(t, j)][1] for j in run), default=0)
        assert got[(t, i)] == (len(run), min(j for j in run if by[(t, j)][1] == best) if best > 0 else None)


def test_greedy(spark):
    rnd = random.Random(6)
    n = 40
    functions = [(k, rnd.randrange(1, 30), rnd.randrange(3), rnd.randrange(1, 5), rnd.random() < 0.3) for k in range(n)]
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(60)]
    reach = {}
    for a, b in brute_closure(edges):
        reach.setdefault(a, set()).add(b)
    cc = {k: c for k, c, *_ in functions}
    hit, want = {k for k, *_, h in functions if h}, []
    below = {k: reach.get(k, set()) | {k} for k in cc}
    for r in range(1, 6):
        best = None
        for k, _, argc, bb, _ in functions:
            u = sum(cc[x] for x in below[k] - hit)
            if k not in hit and argc > 0 and bb > 1 and sum(cc[x] for x in below[k]) >= 20 and u >= 35 and (best is None or u > best[1]):
                best = (k, u)
        if best is None:
            break
        want.append((r, *best))
        hit |= below[best[0]]
    got = S.greedy_targets(spark.createDataFrame(functions, "k long, cc long, argc int, bb int, hit boolean"), spark.createDataFrame(edges, "src long, dst long"), 5)
    assert sorted(map(tuple, got.collect())) == want and want


def test_small_rules(spark):
    assert S.fold_top([1, 2, 3, 9, 8, 2], 3, lambda x: x) == [9, 8, 3]
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted(map(tuple, S.upsert(old, new, ["k"]).collect())) == [(1, "o"), (2, "n"), (3, "n")]
    assert sorted(map(tuple, S.append_new(old, new, ["k"]).collect())) == [(1, "o"), (2, "o"), (3, "n")]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, None, None, 2, 1])], "b string, i int, v int")
    assert sorted(map(tuple, S.runs_of(rows, "b", "i", "v").select("first_at", "last_at", "v", "length").collect()), key=lambda r: r[0]) == [(0, 1, 1, 2), (2, 3, None, 2), (4, 4, 2, 1), (5, 5, 1, 1)]
