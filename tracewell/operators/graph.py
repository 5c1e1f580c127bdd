"""Graph operators on call edges: closure, reach, references, call-tree structure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, shuffle_parts, stored
from .hierarchy import cycle_starts

#: Rows that a task of ``per_project`` collects before it hands them on.
HELD_ROWS = 100_000


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Transitive closure of distinct (src, dst). A node reaches itself only along a cycle. Nulls are no nodes.

    Semi-naive doubling: what was new in the last round is extended by all that is known, so paths of length n are found
    in log2(n) rounds. Each round is a table of its own, so nothing known is written again.
    """
    delta = stored(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct())
    reach = delta
    while not delta.isEmpty():
        step = delta.withColumnRenamed("dst", "mid").join(reach.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        delta = stored(step.join(reach, ["src", "dst"], "left_anti"))
        reach = reach.unionByName(delta)
    return reach.withColumnsRenamed({"src": src, "dst": dst})


def reach_from(edges: DataFrame, starts: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(``start``, ``node``) for all nodes reachable from ``starts`` (column ``start``), the start itself among them.

    One round a step; rounds are tables of their own, eight of which are put together at a time.
    """
    links = stored(edges.select(F.col(src).alias("at"), F.col(dst).alias("node")).dropna().distinct())
    front = stored(starts.select("start", F.col("start").alias("node")).dropna().distinct())
    seen, rounds = front, 1
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "at").join(links, "at").select("start", "node").distinct()
        front = stored(step.join(seen, ["start", "node"], "left_anti"))
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % 8 == 0:
            seen = stored(seen.coalesce(shuffle_parts(edges.sparkSession)))
    return seen


def first_names(links: DataFrame, node: str, base: str, name: str) -> DataFrame:
    """Chains followed from each ``node`` over ``base`` to the first one that has a ``name``: ``node``, ``name``, ``hops``.

    Pointer doubling, so a chain of n links takes log2(n) rounds, and what has no name after as many rounds as all nodes
    could need runs round a cycle. Chains without a name give no row; a node given twice takes its greatest (name, base).
    """
    one = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.max(F.struct(F.col(name).alias("name"), F.col(base).alias("base"))).alias("m"))
    state = stored(one.select("node", "m.name", F.when(F.col("m.name").isNull(), F.col("m.base")).alias("at"), F.when(F.col("m.name").isNull(), 1).otherwise(0).cast("long").alias("hops")))
    for _ in range(state.count().bit_length() + 1):
        if (open_ := state.filter("at is not null")).isEmpty():
            break
        far = state.select(F.col("node").alias("at"), F.col("name").alias("name_2"), F.col("at").alias("at_2"), F.col("hops").alias("hops_2"))
        moved = open_.join(far, "at").select("node", F.col("name_2").alias("name"), F.col("at_2").alias("at"), (F.col("hops") + F.col("hops_2")).alias("hops"))
        state = stored(moved.unionByName(state.filter("at is null")))
    return state.filter("name is not null").select(F.col("node").alias(node), F.col("name").alias(name), F.col("hops").cast("int").alias("hops"))


def parents_from_depth(nodes: DataFrame, tree: str, idx: str, depth: str) -> DataFrame:
    """``nodes`` of pre-order trees with ``parent_idx``: the last earlier node one level up (null at level 0).

    Expressed by equi-join and maximum on (tree, level), so no tree has to fit into a task.
    """
    levels = nodes.withColumn("__at", F.col(idx))
    open_at = F.last(F.when(F.col("__is"), F.col("__at")), ignorenulls=True).over(Window.partitionBy(tree, "__level").orderBy(idx, "__is"))
    asked = levels.select("*", (F.col(depth) - 1).alias("__level"), F.lit(False).alias("__is")).unionByName(levels.select("*", F.col(depth).alias("__level"), F.lit(True).alias("__is")))
    return asked.withColumn("parent_idx", open_at).filter(~F.col("__is")).drop("__at", "__level", "__is")


class DepthRule:
    """Depths of functions by the order-dependent rule of the survey (Q1).

    Functions take their turn in a given order. A turn looks at the callees, last one first, one level down, and goes on below
    those that had no turn yet; of one that had, the depth it got then is added and all it reaches is known from then on.
    Every callee met counts with its level, met before or not. The result is the deepest level counted in the turn.
    """

    def __init__(self, calls: dict[str, list[str]]):
        self.calls, self.depth, self.below = calls, {}, {}

    def _meet(self, level: int, names: list[str], known: set[str]) -> Iterator[int]:
        """Levels counted at the callees ``names`` and below them; explicit iterators, so depth is not bounded."""
        walk = [(level, reversed(names))]
        while walk:
            level, rest = walk[-1]
            name = next(rest, None)
            if name is None:
                walk.pop()
                continue
            yield level
            if name in known:
                continue
            known.add(name)
            if name in self.depth:
                known |= self.below[name]
                yield level + self.depth[name]
            else:
                walk.append((level + 1, reversed(self.calls.get(name, ()))))

    def turn(self, name: str) -> int:
        known: set[str] = set()
        self.depth[name] = max(self._meet(1, list(self.calls.get(name, ())), known), default=0)
        self.below[name] = known
        return self.depth[name]


def function_depths(order: list[str], calls: dict[str, list[str]]) -> dict[str, int]:
    """Depth of each function by ``DepthRule``, turns in the given order."""
    rule = DepthRule(calls)
    return {name: rule.turn(name) for name in order}


def call_tree_lines(entry: str, calls: dict[str, list[tuple[str, int]]]) -> list[tuple[int, str, int]]:
    """Pre-order call tree (depth, name, line) from ``entry``: each function is expanded once, repeats are leaves."""
    out, expanded, stack = [], set(), [(0, entry, -1)]
    while stack:
        depth, name, line = stack.pop()
        out.append((depth, name, line))
        if name in expanded:
            continue
        expanded.add(name)
        stack += [(depth + 1, c, n) for c, n in reversed(calls.get(name, []))]
    return out


def call_tree_entries(calls: dict[str, list[tuple[str, int]]]) -> list[str]:
    """Functions that every call tree can be found from: callers that no other function calls, in name order, then the
    first name of each cycle that nothing outside calls."""
    called = {c for f, found in calls.items() for c, _ in found if c != f}
    entries = sorted(f for f in calls if f not in called)
    seen, stack = set(entries), list(entries)
    while stack:
        for c, _ in calls.get(stack.pop(), ()):
            if c not in seen:
                seen.add(c)
                stack.append(c)
    rest = sorted(f for f in calls if f not in seen)
    at = {f: i for i, f in enumerate(rest)}
    children = {at[f]: [at[c] for c, _ in calls[f] if c in at] for f in rest}
    return entries + [rest[i] for i in cycle_starts(rest, children, list(range(len(rest))))]


def call_paths(target: str, callers: dict[str, list[str]]) -> list[list[str]]:
    """Paths from outermost callers down to ``target``; each function is used once over all paths."""
    used, out, stack = {target}, [], [[target]]
    while stack:
        path = stack.pop()
        above = [c for c in callers.get(path[0], ()) if c not in used]
        if not callers.get(path[0]):
            out.append(path)
        for c in above:
            used.add(c)
            stack.append([c, *path])
    return sorted(out)


def per_project(fn, schema: str):
    """Grouped map in Arrow batches for order-dependent rules of a project's call graph: rows (ns, node, pos, callees)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[c.strip().split(" ")[1]] for c in schema.split(",")]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for ns, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in fn(rows):
                    out.append((ns, *r))
                    if len(out) >= HELD_ROWS:
                        yield pack(out)
                        out = []
        yield pack(out)

    return run


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct ``node`` reachable from any of ``starts`` (column ``node``), these among them; one row a node, whatever the
    number of starts."""
    links = stored(edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).dropna().distinct())
    front = stored(starts.select("node").dropna().distinct())
    seen, rounds = front, 1
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "at").join(links, "at").select("node").distinct()
        front = stored(step.join(seen, "node", "left_anti"))
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % 8 == 0:
            seen = stored(seen.coalesce(shuffle_parts(edges.sparkSession)))
    return seen


def merge_polymorphic(edges: DataFrame) -> DataFrame:
    """Calls (``src``, ``line``, ``callee``, ``class``, ``goes_on``) of one name at one line of a caller to methods that call
    nothing further as one row, ``classes`` being their classes in order, joined by colons. Constructors and methods that call
    on stay as they are."""
    alone = F.col("goes_on") | F.col("callee").isin("<init>", "<cinit>")
    kept = edges.filter(alone).select("src", "line", "callee", F.col("class").alias("classes"))
    merged = edges.filter(~alone).groupBy("src", "line", "callee").agg(F.array_join(F.sort_array(F.collect_set("class")), ":").alias("classes"))
    return kept.unionByName(merged)


def calltree_by_place(calls: DataFrame, entry: str) -> DataFrame:
    """Call tree below ``entry`` of one module's calls (``src``, ``dst``, ``file``, ``line``), in pre-order: ``idx``,
    ``depth``, ``name``, ``file``, ``line``. A node is a name at a place; each is entered once."""
    packed = calls.groupBy(F.lit(entry).alias("entry")).agg(F.sort_array(F.collect_list(F.struct("src", "line", "dst", "file"))).alias("rows"))

    def walk(rows):
        at: dict[str, list[tuple]] = {}
        for r in rows:
            at.setdefault(r["src"], []).append((r["dst"], r["file"], r["line"]))
        seen, stack, n = set(), [(0, (entry, "", -1))], 0
        while stack:
            depth, node = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            yield (n, depth, *node)
            n += 1
            stack += [(depth + 1, c) for c in reversed(at.get(node[0], []))]

    schema = "entry string, idx int, depth int, name string, file string, line int"
    return packed.mapInArrow(per_project(walk, schema), schema)
