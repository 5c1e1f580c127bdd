"""Hierarchies against brute force, with small limits so that every path is taken."""

import random

import pytest

from tracewell.operators import hierarchy as H


@pytest.fixture
def few_tasks(spark):
    """Many rounds on tiny tables: one partition, no re-planning."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def brute_cycles(nodes, links):
    adj = {}
    for ns, a, b in links:
        if (ns, a) in nodes and (ns, b) in nodes:
            adj.setdefault((ns, a), set()).add((ns, b))
    out = set()
    for n in nodes:
        seen, stack = set(), list(adj.get(n, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += adj.get(x, ())
        if n in seen:
            out.add(n)
    return out


def run(spark, nodes, links, **kw):
    n = spark.createDataFrame(nodes, "ns string, node string, extra int")
    e = spark.createDataFrame(links, "ns string, src string, dst string, component int")
    return {(r["ns"], r["node"]): r for r in H.hierarchy(n, e, **kw).collect()}


def forest(seed, n=24, ns="p"):
    rnd = random.Random(seed)
    nodes = [(ns, f"f{i}", 1) for i in range(n)]
    links = [(ns, f"f{rnd.randrange(i)}", f"f{i}", 0) for i in range(1, n) if rnd.random() < 0.85]
    parent = {b: a for _, a, b, _ in links}
    for _ in range(4):  # links that close a cycle
        x = f"f{rnd.randrange(n)}"
        up = [x]
        while up[-1] in parent:
            up.append(parent[up[-1]])
        links.append((ns, x, rnd.choice(up), 0))
    return nodes, links


@pytest.mark.parametrize("limits", [{}, {"task_links": 7}, {"task_links": 5, "task_nodes": 5}])
def test_forest_with_cycles(spark, few_tasks, limits):
    nodes, links = forest(1)
    more_nodes, more_links = forest(2, 12, "q")
    nodes, links = nodes + more_nodes, links + more_links
    got = run(spark, nodes, links, **limits)
    keys = {(a, b) for a, b, _ in nodes}
    assert set(got) == keys
    assert {k for k, r in got.items() if r["on_cycle"]} == brute_cycles(keys, [x[:3] for x in links])
    for (ns, node), r in got.items():
        assert r["path"][0] == r["root"] and r["path"][-1] == node and len(r["path"]) == r["depth"] + 1
        assert r["parent"] == (r["path"][-2] if r["depth"] else None)
        assert r["descendants"] == sum(1 for o in got.values() if o["ns"] == ns and node in o["path"][:-1])
    back = {(k[0], k[1], b) for k, r in got.items() for b in r["back_to"]}
    assert all(b in got[(ns, a)]["path"] for ns, a, b in back)


def test_limits_give_the_same_paths(spark, few_tasks):
    nodes, links = forest(5, 20)
    plain = run(spark, nodes, links)
    large = run(spark, nodes, links, task_links=4, task_nodes=2)
    for k, r in plain.items():
        for c in SAME:
            assert r[c] == large[k][c], (k, c)


SAME = ("root", "parent", "depth", "path", "descendants", "enter", "leave", "on_cycle", "cycle", "back_to")


def tangled(seed):
    """Several parents, cycles within cycles, a ring, a chain with links back, loops."""
    rnd = random.Random(seed)
    nodes, links = [], []
    for g in range(8):
        n = rnd.choice((4, 7, 10))
        nodes += [(f"g{g}", f"n{i:02d}", 0) for i in range(n)]
        links += [(f"g{g}", f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}", 0) for _ in range(rnd.choice((n // 2, n, 2 * n)))]
    ring = [f"r{i}" for i in range(4)]
    nodes += [("ring", x, 0) for x in ring] + [("tail", f"t{i}", 0) for i in range(8)]
    links += [("ring", a, b, 0) for a, b in zip(ring, ring[1:] + ring[:1])]
    links += [("tail", f"t{i}", f"t{i + 1}", 0) for i in range(7)] + [("tail", "t4", "t2", 0), ("tail", "t6", "t6", 0), ("tail", "t1", "t5", 0)]
    rnd.shuffle(links)
    return nodes, links


@pytest.mark.parametrize("limits", [{"task_nodes": 1, "task_links": 40}, {"task_nodes": 40, "task_edges": 8, "paths": False}])
def test_random_graphs_give_the_same_rows_whatever_a_task_holds(spark, few_tasks, limits):
    nodes, links = tangled(1)
    plain, large = run(spark, nodes, links), run(spark, nodes, links, **limits)
    assert {k for k, r in plain.items() if r["on_cycle"]} == brute_cycles(set(plain), [x[:3] for x in links])
    assert set(large) == set(plain)
    for k, r in plain.items():
        for c in SAME:
            want = None if c == "path" and not limits.get("paths", True) else r[c]
            assert want == large[k][c], (limits, k, c, want, large[k][c])


def test_parent_rule_against_brute_force(spark):
    rnd = random.Random(8)
    nodes = [("p", f"n{i:02d}", 0) for i in range(40)]
    links = [("p", f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}", 0) for _ in range(55)]
    got = run(spark, nodes, links)
    reach = reach_of(set(got), links)
    part = {n: min([m[1] for m in reach[n] if n in reach[m]] + [n[1]]) for n in got}
    pairs = sorted({(a, b) for _, a, b, _ in links if a != b})
    inside = {}
    for n in got:
        inside.setdefault(part[n], set()).add(n[1])
    want = {}
    for p, members in inside.items():
        doors = [(a, b) for a, b in pairs if b in members and a not in members]
        entry, want_parent = (doors[0][1], doors[0][0]) if doors else (min(members), None)
        want[entry], level, seen = want_parent, [entry], {entry}
        while level:
            below = {}
            for a, b in pairs:
                if a in level and b in members and b not in seen:
                    below.setdefault(b, a)
            want.update(below)
            seen |= set(below)
            level = sorted(below)
    assert {n[1]: r["parent"] for n, r in got.items()} == want
    assert all((r["cycle"] or n[1]) == part[n] for n, r in got.items())
    order = sorted(got.values(), key=lambda r: (r["component"], r["enter"]))
    assert [r["path"] for r in order] == sorted((r["path"] for r in order), key=lambda p: (got[("p", p[0])]["component"], p))


def test_random_graphs_find_all_cycles(spark, few_tasks):
    rnd = random.Random(3)
    nodes = [(f"g{g}", f"n{i}", 0) for g in range(4) for i in range(9)]
    links = [(f"g{g}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", 0) for g in range(4) for _ in range(4 + 3 * g)]
    want = brute_cycles({(a, b) for a, b, _ in nodes}, [x[:3] for x in links])
    for limits in ({}, {"task_nodes": 4}):
        got = run(spark, nodes, links, **limits)
        assert {k for k, r in got.items() if r["on_cycle"]} == want
        assert len(got) == len(nodes)


def test_enter_and_leave_name_the_descendants(spark):
    got = run(spark, *forest(9))
    for k, r in got.items():
        below = {o["node"] for o in got.values() if o["component"] == r["component"] and r["enter"] < o["enter"] <= r["leave"]}
        assert below == {o["node"] for o in got.values() if k[1] in o["path"][:-1]}


def test_nulls_repeats_unknown_names_and_case(spark):
    nodes = [("p", "a", 1), ("p", "a", 2), ("p", "A", 1), ("p", None, 1), (None, "a", 1), ("q", "a", 1), ("p", "loop", 1), ("p", "", 1)]
    links = [("p", "a", "A", 1), ("p", "a", "A", 2), ("p", "A", "gone", 1), ("p", "x", "a", 1), ("p", None, "a", 1), ("p", "a", None, 1), ("q", "a", "A", 1), ("p", "loop", "loop", 1)]
    got = run(spark, nodes, links)
    assert set(got) == {("p", "a"), ("p", "A"), ("q", "a"), ("p", "loop"), ("p", "")}
    assert got[("p", "A")]["path"] == ["a", "A"] and not got[("p", "A")]["on_cycle"]
    assert got[("p", "loop")]["on_cycle"] and got[("p", "loop")]["back_to"] == ["loop"]


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert len(run(spark, [("p", "a", 1)], [])) == 1


def test_cycle_without_entry_starts_at_first_name(spark):
    got = run(spark, [("p", x, 0) for x in "cab"], [("p", "a", "b", 0), ("p", "b", "c", 0), ("p", "c", "a", 0)])
    assert all(r["on_cycle"] and r["root"] == "a" for r in got.values())


def test_long_chain(spark):
    n = 3000
    got = run(spark, [("p", f"{i:05d}", 0) for i in range(n)], [("p", f"{i:05d}", f"{i + 1:05d}", 0) for i in range(n - 1)], paths=False)
    assert got[("p", f"{n - 1:05d}")]["depth"] == n - 1 and got[("p", "00000")]["descendants"] == n - 1


def reach_of(nodes, links):
    adj = {}
    for ns, a, b, *_ in links:
        adj.setdefault((ns, a), set()).add((ns, b))
    out = {}
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            x = stack.pop()
            for y in adj.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        out[n] = seen - {n}
    return out


@pytest.mark.parametrize("limits", [{}, {"task_links": 5, "task_nodes": 3}])
def test_function_below_a_cycle_is_no_root(spark, few_tasks, limits):
    names = "x y z a b c"
    links = [("p", *e.split(">"), 0) for e in "x>y y>z z>x y>b b>a a>c".split()]
    got = run(spark, [("p", n, 0) for n in names.split()], links, **limits)
    assert {r["root"] for r in got.values()} == {"x"}
    assert got[("p", "c")]["path"] == ["x", "y", "b", "a", "c"] and got[("p", "x")]["descendants"] == 5
    reach = reach_of(set(got), links)
    for node, at in (("a", 1), ("b", 2), ("x", 5)):
        assert got[("p", node)]["descendants"] == len(reach[("p", node)]) == at


@pytest.mark.parametrize("limits", [{}, {"task_nodes": 3}])
def test_roots_against_reachability(spark, few_tasks, limits):
    rnd = random.Random(15)
    nodes = [(f"g{g}", f"n{i}", 0) for g in range(12) for i in range(9)]
    links = [(f"g{g}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", 0) for g in range(12) for _ in range(5 + g)]
    got = run(spark, nodes, links, **limits)
    reach = reach_of(set(got), links)
    above = {n: {a for a in got if n in reach[a]} for n in got}
    want = {n for n in got if all(a in reach[n] and n[1] <= a[1] for a in above[n])}  # the first name of what has no caller outside
    assert {n for n, r in got.items() if r["depth"] == 0} == want
    for n, r in got.items():
        assert r["path"][0] == r["root"] and (n[0], r["root"]) in want
        assert all((n[0], b) in reach[(n[0], a)] for a, b in zip(r["path"], r["path"][1:]))
    for root in want:  # all that only this root reaches
        only = {n for n in reach[root] if not any(n in reach[o] for o in want - {root})}
        below = {n for n, r in got.items() if n[0] == root[0] and r["root"] == root[1]} - {root}
        assert only <= below <= reach[root] and got[root]["descendants"] == len(below)
