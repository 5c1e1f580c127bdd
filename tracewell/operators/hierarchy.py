"""Parent-child links to full hierarchies.

1. Connected components. Links are brought together by namespace (links never leave one) and contracted by a union-find in
   each task; a namespace with too many links is salted over several tasks, and what these have in common is merged by
   rounds of minimum labels with pointer jumping. Component ids are hashes: should two ever collide, their components go to
   the same task, where namespaces are told apart.
2. Each component is brought into one task. An iterative depth-first walk with node colours and low links finds cycles
   (strongly connected parts); a second one over the chosen parents numbers the nodes and gives depths, paths, descendants
   and back links.
3. A component of more than ``task_nodes`` nodes or ``task_edges`` links is not brought into a task. Its parts are found over
   the cluster (leaves and roots raked off, chains compressed, colours spread over the core), and depths, paths, sizes and
   numbers by pointer doubling. The choice of parents does not depend on any order of walking, so both ways give equal rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, shuffle_parts, stored
from .skew import split_key_running

#: Links of one namespace that one task contracts; larger namespaces are salted.
TASK_LINKS = 500_000
#: Nodes and links of one component (or of one cycle of a larger one) that one task walks, about 400 and 30 bytes each.
TASK_NODES, TASK_EDGES = 500_000, 4_000_000

ROWS = "ns string, node string, component long, root string, parent string, depth int, path array<string>, descendants long, enter long, leave long, on_cycle boolean, cycle string, back_to array<string>"


def clean_links(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes and distinct links with both ends among the nodes. Nulls name no node and no link."""
    nodes = nodes.select("ns", "node").dropna().distinct()
    links = links.select("ns", "src", "dst").dropna().distinct()
    links = links.join(nodes.withColumnRenamed("node", "src"), ["ns", "src"], "left_semi")
    return nodes, links.join(nodes.withColumnRenamed("node", "dst"), ["ns", "dst"], "left_semi")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one (namespace, salt) at a time; the batches come sorted by it."""
    def flush(parent: dict, key) -> pa.RecordBatch:
        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        members = list(parent)
        return pa.RecordBatch.from_arrays([pa.array([key[1] > 1] * len(members)), pa.array(members, pa.int64()), pa.array([find(x) for x in members], pa.int64())], ["salted", "v", "rep"])

    key, parent = None, {}
    for batch in batches:
        for ns, salts, salt, u, v in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if key != (ns, salts, salt):
                if parent:
                    yield flush(parent, key)
                key, parent = (ns, salts, salt), {}
            for x in (u, v):
                if x not in parent:
                    parent[x] = x
            a, b = u, v
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield flush(parent, key)


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``v`` (hash of namespace and node) and ``component`` for every node that has a link."""
    spark = links.sparkSession
    sized = links.groupBy("ns").count().filter(F.col("count") > task_links)
    # at most (all links) / task_links rows
    hot = F.broadcast(sized.select("ns", F.ceil(F.col("count") / task_links).cast("int").alias("salts")))
    coded = links.join(hot, "ns", "left").select("ns", F.coalesce("salts", F.lit(1)).alias("salts"), F.xxhash64("ns", "src").alias("u"), F.xxhash64("ns", "dst").alias("v"))
    coded = coded.withColumn("salt", F.pmod(F.hash("u"), F.col("salts"))).select("ns", "salts", "salt", "u", "v")
    parts = shuffle_parts(spark)
    stars = cut(coded.repartition(parts, "ns", "salt").sortWithinPartitions("ns", "salts", "salt").mapInArrow(_contract, "salted boolean, v long, rep long"))
    done = stars.filter("not salted").select("v", F.col("rep").alias("component"))
    open_stars = stars.filter("salted").select("v", "rep")
    if open_stars.isEmpty():
        return done
    return done.unionByName(_merge(open_stars))


def _merge(stars: DataFrame) -> DataFrame:
    """Components of star links by minimum labels: each round takes the least label of the neighbours, then jumps."""
    ends = stars.filter("v <> rep").select(F.col("v").alias("a"), F.col("rep").alias("b"))
    both = stored(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(stars.select("v").unionByName(stars.select(F.col("rep").alias("v"))).distinct().withColumn("component", F.col("v")))
    while True:
        near = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("least"))
        hooked = label.join(near, "v", "left").select("v", "component", F.least("component", "least").alias("l"))
        # The old label's own node hooks as well, so that whole trees move in one round.
        push = hooked.groupBy(F.col("component").alias("v")).agg(F.min("l").alias("p"))
        moved = stored(hooked.join(push, "v", "left").select("v", "component", F.least("l", "p").alias("l")))
        jump = moved.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        after = stored(moved.join(jump, "l", "left").select("v", F.col("component").alias("old"), F.least("l", "ll").alias("component")))
        if after.filter("old <> component").isEmpty():
            return after.select("v", "component")
        label = after.select("v", "component")


# One component in one task ----------------------------------------------------------------------------------------------
def strong_parts(children: list[list[int]]) -> list[int]:
    """Least member of the strongly connected part of each node, by one depth-first walk with colours: white nodes are
    unseen, grey ones not yet assigned to a part, black ones done; low links tell where a part begins."""
    n = len(children)
    colour, low, enter, part = bytearray(n), [0] * n, [0] * n, list(range(n))
    clock, pool = 0, []
    for start in range(n):
        if colour[start]:
            continue
        colour[start], enter[start], low[start] = 1, clock, clock
        clock += 1
        pool.append(start)
        stack = [(start, iter(children[start]))]
        while stack:
            u, kids = stack[-1]
            for v in kids:
                if not colour[v]:
                    colour[v], enter[v], low[v] = 1, clock, clock
                    clock += 1
                    pool.append(v)
                    stack.append((v, iter(children[v])))
                    break
                if colour[v] == 1 and enter[v] < low[u]:
                    low[u] = enter[v]
            else:
                stack.pop()
                if low[u] == enter[u]:
                    at = len(pool) - 1
                    while pool[at] != u:
                        at -= 1
                    least = min(pool[at:])
                    for w in pool[at:]:
                        colour[w], part[w] = 2, least
                    del pool[at:]
                if stack and low[u] < low[stack[-1][0]]:
                    low[stack[-1][0]] = low[u]
    return part


def spread_levels(entry: int, children: list[list[int]], inside: list[int], name: int, parent: list[int]) -> None:
    """Parents below ``entry`` within the part ``name``: the first caller in order on the level above."""
    level, seen = [entry], {entry}
    while level:
        below = []
        for u in level:
            for v in children[u]:
                if inside[v] == name and v not in seen:
                    seen.add(v)
                    parent[v] = u
                    below.append(v)
        level = sorted(below)


def choose_parents(children: list[list[int]], part: list[int]) -> list[int]:
    """Parent of each node (-1 for a root) of a graph with sorted ``children``: a part is entered by the first link
    (caller, then callee) from outside it, without one at its least member; inside, nodes hang on the level above."""
    n = len(children)
    parent, entry, size = [-1] * n, [-1] * n, [0] * n
    for u in range(n):
        size[part[u]] += 1
        for v in children[u]:
            if part[u] != part[v] and entry[part[v]] < 0:
                entry[part[v]], parent[v] = v, u
    for p in range(n):
        if size[p] > 1:
            spread_levels(entry[p] if entry[p] >= 0 else p, children, part, p, parent)
    return parent


def number_forest(parent: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Pre-order, order of entering and leaving, depth and root of each node; roots and children in order."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v, p in enumerate(parent):
        if p >= 0:
            kids[p].append(v)
    order, enter, leave, depth, root = [], [0] * n, [0] * n, [0] * n, [0] * n
    for start in range(n):
        if parent[start] >= 0:
            continue
        stack = [(start, iter(kids[start]))]
        enter[start], root[start] = len(order), start
        order.append(start)
        while stack:
            u, rest = stack[-1]
            v = next(rest, -1)
            if v < 0:
                stack.pop()
                leave[u] = len(order) - 1
                continue
            enter[v], depth[v], root[v] = len(order), depth[u] + 1, start
            order.append(v)
            stack.append((v, iter(kids[v])))
    return order, enter, leave, depth, root


def cycle_starts(names: list[str], children: dict[int, list[int]], rest: list[int]) -> list[int]:
    """The first name of each strongly connected part of ``rest`` without callers outside it, in name order. All callers of
    ``rest`` are in it."""
    by_name = sorted(rest, key=names.__getitem__)
    at = {i: k for k, i in enumerate(by_name)}
    lists = [[at[v] for v in children.get(i, ()) if v in at] for i in by_name]
    part = strong_parts(lists)
    entered = {part[v] for u, found in enumerate(lists) for v in found if part[u] != part[v]}
    return [by_name[k] for k in range(len(by_name)) if part[k] == k and k not in entered]


_FIELDS = pa.schema([("ns", pa.string()), ("node", pa.string()), ("component", pa.int64()), ("root", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("descendants", pa.int64()), ("enter", pa.int64()), ("leave", pa.int64()), ("on_cycle", pa.bool_()), ("cycle", pa.string()), ("back_to", pa.list_(pa.string()))])


def in_order(found: dict[str, int], ends: array) -> tuple[list[str], list[list[int]]]:
    """Names in order and the sorted callees of each, from names numbered as they came and pairs of these numbers."""
    names = sorted(found)
    rank = array("l", bytes(array("l").itemsize * len(names)))
    for i, name in enumerate(names):
        rank[found[name]] = i
    children: list[list[int]] = [[] for _ in names]
    for i in range(0, len(ends), 2):
        children[rank[ends[i]]].append(rank[ends[i + 1]])
    for kids in children:
        kids.sort()
    return names, children


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict[str, int], array]]:
    """Groups of batches sorted by their first ``keys`` columns, followed by ``a`` and ``b`` (null: ``a`` alone)."""
    key, found, ends = None, {}, array("l")
    for batch in batches:
        for *now, a, b in zip(*(batch.column(i).to_pylist() for i in range(keys + 2)), strict=True):
            if key != (now := tuple(now)):
                if found:
                    yield key, found, ends
                key, found, ends = now, {}, array("l")
            i = found.setdefault(a, len(found))
            if b is not None:
                ends.append(i)
                ends.append(found.setdefault(b, len(found)))
    if found:
        yield key, found, ends


def _walk(paths: bool):
    def rows(key: tuple, found: dict[str, int], ends: array) -> Iterator[tuple]:
        component, ns = key
        names, children = in_order(found, ends)
        part = strong_parts(children)
        many = [0] * len(names)
        for p in part:
            many[p] += 1
        parent = choose_parents(children, part)
        order, enter, leave, depth, root = number_forest(parent)
        line: list[str] = []
        for u in order:  # in pre-order the path is what is left of the last one, and the node
            if paths:
                del line[depth[u] :]
                line.append(names[u])
            back = [names[v] for v in children[u] if enter[v] <= enter[u] <= leave[v]]
            cyclic = many[part[u]] > 1 or names[u] in back
            yield (ns, names[u], component, names[root[u]], names[parent[u]] if parent[u] >= 0 else None, depth[u], line.copy() if paths else None, leave[u] - enter[u], enter[u], leave[u], cyclic, names[part[u]] if cyclic else None, back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

        for group in _groups(batches, 2):
            for row in rows(*group):
                out.append(row)
                held += 1 + len(row[6] or ())
                if held > 200_000:
                    yield pack()
                    out, held = [], 0
        if out:
            yield pack()

    return run


def hierarchy(nodes: DataFrame, links: DataFrame, paths: bool = True, task_links: int = TASK_LINKS, task_nodes: int = TASK_NODES, task_edges: int = TASK_EDGES) -> DataFrame:
    """Full hierarchy of ``nodes`` (ns, node) under ``links`` (ns, src, dst), one row per distinct node.

    ``root``: the entry node above it; ``parent``: null for a root; ``depth``: links from the root; ``path``: names from
    root to node (null if ``paths`` is false); ``descendants``: number of nodes below; all of them are exactly the nodes of
    the same namespace and component with ``enter`` in (enter, leave], in the order of a depth-first walk by names.
    ``on_cycle``: a chain of one or more links leads back to the node; ``cycle``: the first name of the strongly connected
    part that it lies in, if it is on a cycle; ``back_to``: nodes above (or itself) that the node links back to, in order.

    Names are compared exactly within their namespace. Null names are no nodes and no links; links to or from other names
    count for nothing; repeated rows count once. A node without links is a root of its own. A node with several callers
    hangs below the first of them by name. A part (nodes on common cycles) is entered by its first link (caller, then callee)
    from outside, without one at its first name, which is then a root; inside it a node hangs below the first caller on the
    level above. The rows do not depend on ``task_links``, ``task_nodes`` and ``task_edges``, which only bound what one task
    holds.
    """
    nodes, links = clean_links(nodes, links)
    links = stored(links)
    comp = components(links, task_links)
    ids = stored(nodes.withColumn("v", F.xxhash64("ns", "node")).join(comp, "v", "left").select("ns", "node", F.coalesce("component", "v").alias("component")))
    linked = links.join(ids.withColumnRenamed("node", "src"), ["ns", "src"]).select("component", "ns", F.col("src").alias("a"), F.col("dst").alias("b"))
    alone = ids.select("component", "ns", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"))
    every = alone.unionByName(linked)
    over = []  # each at most (all nodes) / task_nodes or (all links) / task_edges rows
    if ids.count() > task_nodes:  # counts of stored tables, from their footers
        over.append(ids.groupBy("component").count().filter(F.col("count") > task_nodes).select("component"))
    if links.count() > task_edges:
        over.append(linked.groupBy("component").count().filter(F.col("count") > task_edges).select("component"))
    large = stored(_union(over).distinct()) if over else None
    large = None if large is None or large.isEmpty() else F.broadcast(large)
    small = every if large is None else every.join(large, "component", "left_anti")
    placed = small.repartition(shuffle_parts(links.sparkSession), "component").sortWithinPartitions("component", "ns")
    walked = placed.mapInArrow(_walk(paths), ROWS)
    if large is None:
        return walked
    inner = stored(linked.join(large, "component", "left_semi").select("component", "ns", F.col("a").alias("src"), F.col("b").alias("dst")))
    return walked.unionByName(_large(stored(ids.join(large, "component", "left_semi")), inner, paths, task_nodes, task_edges))


# Components that no single task may hold ----------------------------------------------------------------------------------
def _ends(links: DataFrame, side: str) -> DataFrame:
    return links.select("ns", F.col(side).alias("node")).distinct()


def _chains(live: DataFrame) -> DataFrame:
    """Nodes with one caller and one callee: ``ns``, ``node``, ``prev``, ``next``."""
    ins = live.groupBy("ns", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("prev")).filter("i = 1")
    outs = live.groupBy("ns", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("next")).filter("o = 1")
    return ins.join(outs, ["ns", "node"]).select("ns", "node", "prev", "next")


def _compress(live: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Live links with each chain as one link, and ``ns``, ``node``, ``first``, ``last``, ``ring`` of the nodes on chains:
    the ends of the chain, or for a ring of nothing else its least name. None if there is no chain."""
    chain = stored(_chains(live))
    n = chain.count()
    if not n:
        return None
    state = chain.withColumn("least", F.col("node"))
    for _ in range(n.bit_length() + 1):
        near = lambda end, c: chain_state.select("ns", F.col("node").alias(end), F.col(end).alias(f"{end}_2"), *c)
        chain_state = state
        moved = state.join(near("next", [F.col("least").alias("least_2")]), ["ns", "next"], "left").join(near("prev", []), ["ns", "prev"], "left")
        after = moved.select("ns", "node", F.coalesce("prev_2", "prev").alias("prev"), F.coalesce("next_2", "next").alias("next"), F.least("least", "least_2").alias("least"), (F.col("next_2").isNotNull() | F.col("prev_2").isNotNull()).alias("went"))
        after = stored(after)
        state = after.drop("went")
        if after.filter("went").isEmpty():
            break
    on = chain.select("ns", "node")
    rings = state.join(on.withColumnRenamed("node", "next"), ["ns", "next"], "left_semi").select("ns", "node", F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"), F.col("least").alias("ring"))
    open_ = state.join(on.withColumnRenamed("node", "next"), ["ns", "next"], "left_anti").select("ns", "node", F.col("prev").alias("first"), F.col("next").alias("last"), F.lit(None).cast("string").alias("ring"))
    kept = live.join(on.withColumnRenamed("node", "src"), ["ns", "src"], "left_anti").join(on.withColumnRenamed("node", "dst"), ["ns", "dst"], "left_anti")
    short = open_.select("ns", F.col("first").alias("src"), F.col("last").alias("dst")).filter("src <> dst")
    return stored(kept.select("ns", "src", "dst").unionByName(short).distinct()), stored(open_.unionByName(rings))


def _parts(links: DataFrame, task_nodes: int, task_edges: int) -> DataFrame:
    """``ns``, ``node``, ``part`` (its least name) of the strongly connected parts of two or more nodes.

    What no cycle can pass is raked off and chains are compressed to single links, so trees and chains of any depth take a
    logarithmic number of rounds. The parts of the core left over are found in one task if it fits there, else by colours:
    the greatest hash that reaches a node is its colour, and what of a colour leads back to its origin is one part. A node of
    a chain is in the part that holds both ends of the chain.
    """
    live, chains = stored(links.filter("src <> dst").select("ns", "src", "dst")), []
    while True:
        while not live.isEmpty():
            kept = stored(live.join(_ends(live, "dst").withColumnRenamed("node", "src"), ["ns", "src"], "left_semi").join(_ends(live, "src").withColumnRenamed("node", "dst"), ["ns", "dst"], "left_semi"))
            shrunk = kept.count() < live.count()
            live = kept
            if not shrunk or not _chains(live).isEmpty():
                break
        if live.isEmpty() or (got := _compress(live)) is None:
            break
        live = got[0]
        chains.append(got[1])
    edges = live.count()
    if edges and edges <= min(task_edges, 2 * task_nodes):
        placed = live.select("ns", F.col("src").alias("a"), F.col("dst").alias("b")).repartition(shuffle_parts(links.sparkSession), "ns").sortWithinPartitions("ns")
        reps = stored(placed.mapInArrow(_core_parts, "ns string, node string, rep string"))
    else:
        reps = _colour_parts(live)
    for chain in reversed(chains):  # back to the nodes on chains, last compressed first
        closed = chain.filter("first = last").select("ns", F.col("first").alias("node")).distinct().join(reps, ["ns", "node"], "left_anti").withColumn("rep", F.col("node"))
        reps = stored(reps.unionByName(closed))
        end = lambda c: reps.select("ns", F.col("node").alias(c), F.col("rep").alias(f"rep_{c}"))
        held = chain.filter("ring is null").join(end("first"), ["ns", "first"]).join(end("last"), ["ns", "last"]).filter("rep_first = rep_last").select("ns", "node", F.col("rep_first").alias("rep"))
        reps = stored(reps.unionByName(held).unionByName(chain.filter("ring is not null").select("ns", "node", F.col("ring").alias("rep"))))
    least = reps.groupBy("ns", "rep").agg(F.min("node").alias("part"))
    return stored(reps.join(least, ["ns", "rep"]).select("ns", "node", "part"))


def _core_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (ns,), found, ends in _groups(batches, 1):
        names, children = in_order(found, ends)
        part = strong_parts(children)
        many = [0] * len(names)
        for p in part:
            many[p] += 1
        rows = [(names[u], names[p]) for u, p in enumerate(part) if many[p] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([ns] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["ns", "node", "rep"])


def _colour_parts(live: DataFrame) -> DataFrame:
    """``ns``, ``node``, ``rep`` of the parts of two or more nodes, by rounds of colours."""
    found = live.select("ns", F.col("src").alias("node"), F.col("src").alias("rep")).limit(0)
    while not live.isEmpty():
        nodes = _ends(live, "src").unionByName(_ends(live, "dst")).distinct()
        colour = stored(nodes.withColumn("c", F.struct(F.xxhash64("ns", "node").alias("h"), F.col("node").alias("o"))))
        while True:
            sent = live.join(colour.withColumnRenamed("node", "src"), ["ns", "src"]).groupBy("ns", F.col("dst").alias("node")).agg(F.max("c").alias("m"))
            after = stored(colour.join(sent, ["ns", "node"], "left").select("ns", "node", F.col("c").alias("old"), F.greatest("c", "m").alias("c")))
            colour = after.drop("old")
            if after.filter("old <> c").isEmpty():
                break
        same = stored(live.join(colour.withColumnRenamed("node", "src"), ["ns", "src"]).join(colour.withColumnsRenamed({"node": "dst", "c": "c2"}), ["ns", "dst"]).filter("c = c2").select("ns", "src", "dst", "c"))
        part = stored(colour.filter("c.o = node").select("ns", "node", "c"))
        front = part
        while not front.isEmpty():  # backwards from the origins within a colour
            step = same.join(front.withColumnRenamed("node", "dst"), ["ns", "dst", "c"]).select("ns", F.col("src").alias("node"), "c").distinct()
            front = stored(step.join(part, ["ns", "node", "c"], "left_anti"))
            part = stored(part.unionByName(front).coalesce(shuffle_parts(live.sparkSession)))
        sizes = part.groupBy("ns", "c").count().filter("count > 1").select("ns", "c")
        found = stored(found.unionByName(part.join(sizes, ["ns", "c"], "left_semi").select("ns", "node", F.col("c.o").alias("rep"))))
        gone = part.select("ns", "node")
        live = stored(live.join(gone.withColumnRenamed("node", "src"), ["ns", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["ns", "dst"], "left_anti"))
    return found


def _levels_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents within the parts that fit a task: sorted batches of (ns, part, entry, a, b)."""
    for (ns, _, entry), found, ends in _groups(batches, 3):
        names, children = in_order(found, ends)
        parent = [-1] * len(names)
        spread_levels(names.index(entry), children, [0] * len(names), 0, parent)
        rows = [(names[v], names[p]) for v, p in enumerate(parent) if p >= 0]
        yield pa.RecordBatch.from_arrays([pa.array([ns] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["ns", "node", "parent"])


def _parents(nodes: DataFrame, links: DataFrame, parts: DataFrame, task_nodes: int, task_edges: int) -> DataFrame:
    """``component``, ``ns``, ``node``, ``parent`` by the rule of ``choose_parents``."""
    proper = links.filter("src <> dst").select("ns", "src", "dst")
    end = lambda c: parts.select("ns", F.col("node").alias(c), F.col("part").alias(f"part_{c}"))
    both = stored(proper.join(end("src"), ["ns", "src"], "left").join(end("dst"), ["ns", "dst"], "left"))
    outer = both.filter("part_dst is null or not part_src <=> part_dst")
    single = outer.filter("part_dst is null").groupBy("ns", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    doors = outer.filter("part_dst is not null").groupBy("ns", F.col("part_dst").alias("part")).agg(F.min(F.struct("src", "dst")).alias("m"))
    entry = stored(parts.groupBy("ns", "part").agg(F.count(F.lit(1)).alias("n")).join(doors, ["ns", "part"], "left").select("ns", "part", "n", F.coalesce("m.dst", "part").alias("entry"), F.col("m.src").alias("parent")))
    inner = both.filter("part_src = part_dst").select("ns", F.col("part_src").alias("part"), "src", "dst")
    weight = inner.groupBy("ns", "part").agg(F.count(F.lit(1)).alias("e"))
    entry = stored(entry.join(weight, ["ns", "part"]))
    fits = (F.col("n") <= task_nodes) & (F.col("e") <= task_edges)
    small = inner.join(entry.filter(fits).select("ns", "part", "entry"), ["ns", "part"]).select("ns", "part", "entry", F.col("src").alias("a"), F.col("dst").alias("b"))
    placed = small.repartition(shuffle_parts(links.sparkSession), "ns", "part").sortWithinPartitions("ns", "part", "entry")
    found = [single, entry.filter("parent is not null").select("ns", F.col("entry").alias("node"), "parent"), placed.mapInArrow(_levels_within, "ns string, node string, parent string")]
    big = entry.filter(~fits).select("ns", "part", F.col("entry").alias("node"))
    if not big.isEmpty():
        inner = stored(inner.join(big.select("ns", "part"), ["ns", "part"], "left_semi"))
        front = stored(big.select("ns", "node"))
        seen = front
        while not front.isEmpty():
            step = inner.join(front.withColumnRenamed("node", "src"), ["ns", "src"]).groupBy("ns", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
            level = stored(step.join(seen, ["ns", "node"], "left_anti"))
            front = level.select("ns", "node")
            found.append(level)
            seen = seen.unionByName(front)
            if len(found) % 8 == 0:  # one table instead of eight
                seen = stored(seen.coalesce(shuffle_parts(links.sparkSession)))
                found[3:] = [stored(_union(found[3:]).coalesce(shuffle_parts(links.sparkSession)))]
    return nodes.join(_union(found), ["ns", "node"], "left").select("component", "ns", "node", "parent")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _step_up(open_: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """``open_`` joined with ``above`` on (ns, anc). Ancestors of more than ``most`` rows are looked up by broadcast."""
    hot = stored(open_.groupBy("ns", "anc").count().filter(F.col("count") > most).select("ns", "anc"))
    if hot.isEmpty():
        return open_.join(above, ["ns", "anc"])
    hot = F.broadcast(hot)  # at most (all rows) / most rows
    heavy = F.broadcast(above.join(hot, ["ns", "anc"], "left_semi"))  # as many
    return open_.join(heavy, ["ns", "anc"]).unionByName(open_.join(hot, ["ns", "anc"], "left_anti").join(above, ["ns", "anc"]))


def _large(nodes: DataFrame, links: DataFrame, paths: bool, task_nodes: int, task_edges: int) -> DataFrame:
    """Rows of ``hierarchy`` for whole components, by pointer doubling over the chosen parents."""
    parts = _parts(links, task_nodes, task_edges)
    forest = stored(_parents(nodes, links, parts, task_nodes, task_edges))
    no_path = F.lit(None).cast("array<string>")
    # After k rounds ``anc`` is the node 2^k above (null once beyond the root), and ``below`` counts the node and what is
    # less than 2^k below it.
    state = stored(forest.select("component", "ns", "node", "parent", F.col("parent").alias("anc"), F.col("parent").isNotNull().cast("int").alias("depth"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"), (F.array("node") if paths else no_path).alias("path"), F.lit(1).cast("long").alias("below")))
    while not (open_ := state.filter("anc is not null")).isEmpty():
        more = open_.groupBy("ns", F.col("anc").alias("node")).agg(F.sum("below").alias("more"))
        above = state.select("ns", F.col("node").alias("anc"), F.col("anc").alias("anc_2"), F.col("depth").alias("depth_2"), F.col("root").alias("root_2"), F.col("path").alias("path_2"))
        up = _step_up(open_, above, task_nodes)
        moved = up.select("component", "ns", "node", "parent", F.col("anc_2").alias("anc"), (F.col("depth") + F.col("depth_2")).alias("depth"), F.col("root_2").alias("root"), (F.concat("path_2", "path") if paths else no_path).alias("path"), "below")
        state = moved.unionByName(state.filter("anc is null")).join(more, ["ns", "node"], "left").withColumn("below", F.col("below") + F.coalesce("more", F.lit(0))).drop("more")
        state = stored(state)
    # A node comes after its parent and the trees of the siblings before it; these numbers add up along the path.
    placed = split_key_running(state.select("component", "ns", "parent", "node", "below"), ["component", "ns", "parent"], ["node"], "below", out_total="upto")
    first = F.col("upto") - F.col("below") + F.col("parent").isNotNull().cast("long")
    steps = stored(placed.select("ns", "node", F.col("parent").alias("anc"), first.alias("enter")))
    while not (open_ := steps.filter("anc is not null")).isEmpty():
        above = steps.select("ns", F.col("node").alias("anc"), F.col("anc").alias("anc_2"), F.col("enter").alias("enter_2"))
        up = _step_up(open_, above, task_nodes).select("ns", "node", F.col("anc_2").alias("anc"), (F.col("enter") + F.col("enter_2")).alias("enter"))
        steps = stored(up.unionByName(steps.filter("anc is null")))
    rows = stored(state.drop("anc").join(steps.drop("anc"), ["ns", "node"]).withColumn("leave", F.col("enter") + F.col("below") - 1))
    low = rows.select("ns", F.col("node").alias("src"), F.col("enter").alias("at"))
    high = rows.select("ns", F.col("node").alias("dst"), "enter", "leave")
    back = links.select("ns", "src", "dst").join(low, ["ns", "src"]).join(high, ["ns", "dst"]).filter("at between enter and leave")
    back = back.groupBy("ns", F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("back_to"))
    out = rows.join(parts, ["ns", "node"], "left").join(back, ["ns", "node"], "left")
    back_to = F.coalesce("back_to", F.array().cast("array<string>"))
    cycle = F.coalesce("part", F.when(F.array_contains(back_to, F.col("node")), F.col("node")))
    return out.select("ns", "node", "component", "root", "parent", "depth", "path", (F.col("below") - 1).alias("descendants"), "enter", "leave", cycle.isNotNull().alias("on_cycle"), cycle.alias("cycle"), back_to.alias("back_to"))


def descendant_pairs(rows: DataFrame) -> DataFrame:
    """``ns``, ``ancestor``, ``node``, ``distance`` for every node below another, from the rows of ``hierarchy``."""
    gone = rows.select("ns", "node", "depth", F.posexplode("path").alias("at", "ancestor"))
    return gone.filter("at < depth").select("ns", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
