"""Queries composed of several operators, and the registry of analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..operators import graph
from ..operators.joins import percentage
from . import reference as base
from . import selection
from .reference import harness_reach, query


@query("ff", "select project_name, function_name from ff where not (contains(function_name, 'FuzzEntry') and not contains(function_source_file, 'entry')) and function_name not like '%<init>%'")
def f3_entry_dedup(t):
    """Functions without entry points of other files and without constructors."""
    n = F.col("function_name")
    return t.ff.filter(~(n.contains("FuzzEntry") & ~F.col("function_source_file").contains("entry")) & ~n.contains("<init>")).select("project_name", "function_name")


@query("", f"""with {selection._LAST} select project_name, function_name, function_source_file from l where cyclomatic_complexity > 10 and coalesce(line_cov, 0) < 50 and fuzzers_reaching = 0 and trim(return_type) not in ('', 'N/A', 'void')
qualify row_number() over (partition by project_name order by cyclomatic_complexity desc, function_name, function_source_file) <= 8""")
def f17_target_oracle(t):
    """Unreached complex functions with a result, eight of each project."""
    w = Window.partitionBy("project_name").orderBy(F.desc("cyclomatic_complexity"), "function_name", "function_source_file")
    rows = selection.last_functions(t).filter("cyclomatic_complexity > 10 and coalesce(line_cov, 0) < 50 and fuzzers_reaching = 0").filter(~F.trim("return_type").isin("", "N/A", "void"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 8").select("project_name", "function_name", "function_source_file")


@query("fn ct", """, p as (select c.h, c.idx, c.depth, c.k, max(p.idx) pi from ct c join ct p on p.h = c.h and p.idx < c.idx and p.depth = c.depth - 1 group by all),
r as (select h, f.file root_file from ct join fn f using (k) where idx = 0)
select p.h, count(distinct p.k) targets, min(f.name) first_target from p join ct q on q.h = p.h and q.idx = p.pi join fn f on f.k = p.k join fn g on g.k = q.k join r on r.h = p.h
where ((g.file = r.root_file and f.file <> r.root_file) or p.depth = 1) and f.cc >= 5 group by 1""")
def f32_harness_targets(t):
    """Complex functions that each harness calls directly."""
    rows = base.g20_top_level_targets(t).select("h", "k").distinct().join(t.fn.filter("cc >= 5").select("k", "name"), "k")
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("targets"), F.min("name").alias("first_target"))


@query()
def g11_frontend_depth(t):
    """Longest chain of calls below each function; on cycles each function counts once (from the hierarchy's walk)."""
    from .problems import call_forest

    rows = call_forest(t.spark, t.dir)
    below = rows.select("ns", F.posexplode("path").alias("at", "node"), "depth").groupBy("ns", "node").agg(F.max(F.col("depth") - F.col("at")).alias("depth_below"))
    return below.select(F.col("ns").alias("project_name"), F.col("node").alias("function_name"), "depth_below")


@query("", """with recursive e as (select p_partkey src, p_partkey // 2 dst from part where p_partkey > 0 and p_partkey % 7 <> 0 union select p_partkey, p_partkey // 3 from part where p_partkey > 0 and p_partkey % 5 = 0),
r(src, dst) as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src addr, count(*) types, min(dst) least from r group by 1""")
def g18_struct_closure(t):
    """All types that a struct is made of, by base and member links."""
    p = t.raw("part").select(F.col("p_partkey").alias("src")).filter("src > 0")
    edges = p.filter("src % 7 <> 0").select("src", F.floor(F.col("src") / 2).alias("dst")).unionByName(p.filter("src % 5 = 0").select("src", F.floor(F.col("src") / 3).alias("dst")))
    return graph.closure(edges).groupBy(F.col("src").alias("addr")).agg(F.count(F.lit(1)).alias("types"), F.min("dst").alias("least"))


@query("", """with recursive s as (select p_partkey c, p_partkey // 4 parent from part where p_partkey > 0), r(root, c) as (select parent, c from s union select r.root, s.c from r join s on s.parent = r.c)
select r.root, count(*) concrete, min(c) first_class from r where c % 3 <> 0 group by 1""")
def g22_concrete_subclasses(t):
    """Concrete classes below each class, through all levels."""
    s = t.raw("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("dst"), F.floor(F.col("p_partkey") / 4).alias("src"))
    roots = s.select(F.col("src").alias("start")).distinct()
    below = graph.reach_from(s, roots).filter("start <> node and node % 3 <> 0")
    return below.groupBy(F.col("start").alias("root")).agg(F.count(F.lit(1)).alias("concrete"), F.min("node").alias("first_class"))


@query("", """with recursive f as (select p_partkey src, p_partkey // 2 dst from part where p_partkey > 0 and p_partkey % 7 <> 0 union select p_partkey, p_partkey // 3 from part where p_partkey > 0 and p_partkey % 5 = 0),
a as (select s_suppkey code, s_suppkey * 17 + 3 type from supplier), r(code, type) as (select code, type from a union select r.code, f.dst from r join f on f.src = r.type) select code, type from r""")
def g23_argument_structs(t):
    """Types that the argument of each command is made of: its own and, through the fields of structs, all below it."""
    p = t.raw("part").select(F.col("p_partkey").alias("src")).filter("src > 0")
    fields = p.filter("src % 7 <> 0").select("src", F.floor(F.col("src") / 2).alias("dst")).unionByName(p.filter("src % 5 = 0").select("src", F.floor(F.col("src") / 3).alias("dst")))
    asked = t.raw("supplier").select(F.col("s_suppkey").alias("code"), (F.col("s_suppkey") * 17 + 3).alias("start"))
    return asked.join(graph.reach_from(fields, asked.select("start")), "start").select("code", F.col("node").alias("type"))


@query("cs af", """, lc as (select project_name, function_name, max(line_cov) cov from af group by 1, 2)
select c.project_name, c.site_dst sink, c.src_func, coalesce(any_value(lc.cov), 0) > 0 covered, count(*) sites from cs c left join lc on lc.project_name = c.project_name and lc.function_name = c.src_func where c.site_dst in ('xp_alloc', 'xp_open', 'xp_log') group by 1, 2, 3""")
def j14_sink_callers(t):
    """Callers of sinks, and whether they ever ran."""
    cov = t.af.groupBy("project_name", F.col("function_name").alias("src_func")).agg(F.max("line_cov").alias("cov"))
    calls = t.cs.filter(F.col("site_dst").isin("xp_alloc", "xp_open", "xp_log")).groupBy("project_name", F.col("site_dst").alias("sink"), "src_func").agg(F.count(F.lit(1)).alias("sites"))
    return calls.join(cov, ["project_name", "src_func"], "left").select("project_name", "sink", "src_func", (F.coalesce("cov", F.lit(0.0)) > 0).alias("covered"), "sites")


@query("ff af", """, a as (select project_name, replace(function_name, ' ', '') n, function_name, arg_count from ff qualify row_number() over (partition by project_name, replace(function_name, ' ', '') order by function_name) = 1),
b as (select distinct project_name, replace(function_name, ' ', '') n from af where fuzzers_reaching = 0) select a.project_name, a.function_name, a.arg_count from a join b using (project_name, n)""")
def j16_named_targets(t):
    """Facts of functions named as targets, blanks left out of account, the first match kept."""
    key = F.replace("function_name", F.lit(" "), F.lit(""))
    a = t.ff.groupBy("project_name", key.alias("n")).agg(F.min(F.struct("function_name", "arg_count")).alias("m"))
    b = t.af.filter("fuzzers_reaching = 0").select("project_name", key.alias("n")).distinct()
    return a.join(b, ["project_name", "n"]).select("project_name", "m.function_name", "m.arg_count")


@query("ff", r"""select f.project_name, f.function_name, count(distinct x.x) words from (select project_name, function_name, unnest(string_split_regex(function_name, '[^A-Za-z]+')) x from ff) x join ff f using (project_name, function_name) where x.x <> '' and contains(f.function_source_file, x.x) group by 1, 2""")
def j20_name_in_path(t):
    """Words of a function's name that its path contains: exploded words instead of a nested loop."""
    w = t.ff.select("project_name", "function_name", "function_source_file", F.explode(F.split("function_name", "[^A-Za-z]+")).alias("w")).filter("w <> '' and contains(function_source_file, w)")
    return w.select("project_name", "function_name", "w").distinct().groupBy("project_name", "function_name").agg(F.count(F.lit(1)).alias("words"))


@query("ct", """, f as (select h, k, min(idx) i from ct group by 1, 2), e as (select f.h, f.k, f.i, n.depth d, coalesce((select min(x.idx) from ct x where x.h = f.h and x.idx > f.i and x.depth <= n.depth), 1000000000) stop from f join ct n on n.h = f.h and n.idx = f.i)
select e.h, e.k, max(c.idx) child_idx from e join ct c on c.h = e.h and c.idx > e.i and c.idx < e.stop and c.depth = e.d + 1 and c.line <= 25 group by 1, 2""")
def j21_blocker_node(t):
    """Of the first node of each function the last direct child at or before a line."""
    tree = graph.parents_from_depth(t.ct, "h", "idx", "depth")
    first = t.ct.groupBy("h", "k").agg(F.min("idx").alias("parent_idx"))
    child = tree.filter("line <= 25 and parent_idx is not null").select("h", "parent_idx", F.col("idx").alias("child"))
    return first.join(child, ["h", "parent_idx"]).groupBy("h", "k").agg(F.max("child").alias("child_idx"))


@query("cs", "select project_name, site_dst last_function, count(distinct src_func) paths, min(src_func) first_path from cs where site_dst is not null group by 1, 2")
def a20_paths_by_end(t):
    """Call steps grouped by the function they end in."""
    steps = t.cs.filter("site_dst is not null").select("project_name", F.array("src_func", "site_dst").alias("path")).distinct()
    return steps.groupBy("project_name", F.element_at("path", -1).alias("last_function")).agg(F.count(F.lit(1)).alias("paths"), F.min(F.get("path", F.lit(0))).alias("first_path"))


@query("ff", "select project_name, function_name, greatest(1, edge_count - bb_count + 2)::int complexity, trunc((edge_count + 1) * 1.4::double)::bigint estimated from ff where edge_count is not null and bb_count is not null")
def a26_complexity_forms(t):
    """Complexity from edges and nodes, at least 1, and edges estimated from the number of conditions, cut to a whole number."""
    rows = t.ff.filter("edge_count is not null and bb_count is not null")
    return rows.select("project_name", "function_name", F.greatest(F.lit(1), F.col("edge_count") - F.col("bb_count") + 2).alias("complexity"), ((F.col("edge_count") + 1) * F.lit(1.4).cast("double")).cast("long").alias("estimated"))


@query("cs", "select project_name, site_dst sink, src_func, row_number() over (partition by project_name, site_dst order by length(src_func), src_func) path_no from (select distinct project_name, site_dst, src_func from cs where site_dst is not null) qualify row_number() over (partition by project_name, site_dst order by length(src_func), src_func) <= 2")
def t6_two_paths(t):
    """At most two calls to each function, the shortest names first."""
    w = Window.partitionBy("project_name", "sink").orderBy(F.length("src_func"), "src_func")
    rows = t.cs.filter("site_dst is not null").select("project_name", F.col("site_dst").alias("sink"), "src_func").distinct()
    return rows.withColumn("path_no", F.row_number().over(w)).filter("path_no <= 2")


def _sink_paths(t):
    """Call paths to every function that a call site names, whether the project defines it or not."""
    return base.path_lists(t.cs.filter("site_dst is not null and src_func is not null")).withColumnRenamed("function_name", "sink")


@query()
def t6_shortest_paths(t):
    """At most two call paths to each function, the shortest first (T6 over whole paths)."""
    w = Window.partitionBy("project_name", "sink").orderBy(F.size("path"), "path")
    rows = _sink_paths(t).withColumn("path_no", F.row_number().over(w)).filter("path_no <= 2")
    return rows.select("project_name", "sink", "path_no", F.size("path").alias("functions"), F.array_join("path", " > ").alias("call_path"))


@query()
def a20_call_paths_by_end(t):
    """Call paths to each function grouped by their last element, its direct caller (A20 over whole paths)."""
    rows = _sink_paths(t).withColumn("path", F.slice("path", 1, F.size("path") - 1))
    return rows.groupBy("project_name", "sink", F.element_at("path", -1).alias("last_caller")).agg(F.count(F.lit(1)).alias("paths"), F.array_join(F.min("path"), " > ").alias("first_path"))


@query()
def j14_sink_blockers(t):
    """Call paths to sinks with the number of direct callers that ran, and, if none did, the blocker of the path: the
    function before the first one that never ran (J14 over whole paths; callers by function, as call sites have no hits)."""
    ran = t.af.filter("line_cov > 0").select("project_name", F.col("function_name").alias("f")).distinct().withColumn("ran", F.lit(True))
    sinks = F.col("sink").isin("xp_alloc", "xp_open", "xp_log")
    calls = t.cs.select("project_name", F.col("site_dst").alias("sink"), F.col("src_func").alias("f")).filter(sinks).distinct()
    hit = calls.join(ran, ["project_name", "f"], "left").groupBy("project_name", "sink").agg(F.count("ran").alias("callers_hit"))
    paths = _sink_paths(t).filter(sinks).withColumn("path", F.slice("path", 1, F.size("path") - 1))
    steps = paths.select("project_name", "sink", "path_no", "path", F.posexplode("path").alias("at", "f")).join(ran, ["project_name", "f"], "left")
    stop = steps.groupBy("project_name", "sink", "path_no", "path").agg(F.min(F.when(F.col("ran").isNull() & (F.col("at") > 0), F.col("at"))).alias("stop"))
    before = F.element_at("path", F.coalesce(F.col("stop"), F.size("path")))
    return stop.join(hit, ["project_name", "sink"]).select("project_name", "sink", "path_no", "callers_hit", F.when(F.col("callers_hit") == 0, before).alias("blocker"), F.array_join("path", " > ").alias("call_path"))


@query("ed hs hr cl", """, r as (select h, count(*) n from hr group by 1), c as (select h, count(distinct k) n from cl where hits > 0 group by 1), x as (select r.h, 100.0::double * coalesce(c.n, 0) / r.n share from r left join c using (h))
select h, case when share < 30 then 1 when share < 100 then 5 else 10 end severity, row_number() over (order by case when share < 30 then 1 when share < 100 then 5 else 10 end, h) place from x""")
def t7_conclusions(t):
    """Conclusions about each harness in the order of severity."""
    ran = t.cl.filter("hits > 0").select("h", "k").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    rows = harness_reach(t).groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(ran, "h", "left")
    share = percentage(F.col("c"), F.col("n"))
    rows = rows.select("h", F.when(share < 30, 1).when(share < 100, 5).otherwise(10).alias("severity"))
    return selection.numbered(rows, [F.asc("severity"), F.asc("h")])


@query("ct", """select concat('tree', h) tree, idx, depth, concat('fn_', k) dst_func, concat('/src/f', k % 5, '.c') dst_file, line src_line from ct""")
def s1_call_tree_text(t):
    """Call trees written as text and read back."""
    from ..sources.reports import call_trees

    line = F.concat(F.repeat(F.lit(" "), (F.col("depth") * 2).cast("int")), F.lit("fn_"), "k", F.lit(" /src/f"), F.col("k") % 5, F.lit(".c linenumber="), "line")
    texts = t.ct.groupBy("h").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    files = texts.select(F.concat(F.lit("tree"), "h").alias("path"), F.concat(F.lit("head\nCall tree\n"), "body", F.lit("\n====\n")).alias("value"))
    return call_trees(files).select(F.col("path").alias("tree"), F.col("idx").cast("long").alias("idx"), F.col("depth").cast("long").alias("depth"), "dst_func", "dst_file", F.col("src_line").cast("long").alias("src_line"))


@query("ff", "select project_name, function_source_file, string_agg(concat(function_name, '(', array_to_string(list_transform(arg_types, lambda x: case when contains(x, 'char') then 'text' when contains(x, '*') then 'data' else 'number' end), ', '), ')'), '; ' order by function_name) driver from ff group by 1, 2")
def u5_driver_lines(t):
    """Call templates of the functions of a file, each argument by its kind of type."""
    kind = F.transform("arg_types", lambda x: F.when(x.contains("char"), "text").when(x.contains("*"), "data").otherwise("number"))
    call = F.concat("function_name", F.lit("("), F.array_join(kind, ", "), F.lit(")"))
    rows = t.ff.groupBy("project_name", "function_source_file").agg(F.sort_array(F.collect_list(F.struct("function_name", call.alias("c")))).alias("r"))
    return rows.select("project_name", "function_source_file", F.array_join(F.transform("r", lambda x: x["c"]), "; ").alias("driver"))


@query("cs ff", """, x as (select distinct project_name, regexp_extract(file, '([^/]*)$', 1) b, src_func from cs where file is not null) select x.project_name, x.b base, x.src_func, f.function_linenumber - 2 line_from, f.function_linenumber + 2 line_to from x join ff f on f.project_name = x.project_name and f.function_name = x.src_func""")
def j27_reference_places(t):
    """Callers with two lines around their definition."""
    rows = t.cs.filter("file is not null").select("project_name", basename(F.col("file")).alias("base"), "src_func").distinct()
    at = t.ff.select("project_name", F.col("function_name").alias("src_func"), F.col("function_linenumber").alias("n"))
    return rows.join(at, ["project_name", "src_func"]).select("project_name", "base", "src_func", (F.col("n") - 2).alias("line_from"), (F.col("n") + 2).alias("line_to"))


#: Analyses by name, in order: (tables) -> DataFrame. Those of the tables' own files are in ``literals`` and found by name.
ANALYSES = {
    "optimal_targets": selection.t5_greedy_targets,
    "engine_input": selection.w9_dictionary,
    "runtime_coverage": selection.f9_low_coverage,
    "driver_synthesis": u5_driver_lines,
    "bug_digest": "u8_bug_digest",
    "file_paths": base.j19_file_reach,
    "third_party_calls": base.j13_third_party_calls,
    "metadata": selection.f25_harness_overview,
    "sink_coverage": j14_sink_blockers,
    "annotated_cfg": base.g20_top_level_targets,
    "source_lines": base.j7_line_to_function,
    "far_reach_low_coverage": selection.t4_far_reach,
    "public_candidates": selection.t3_public_order,
    "frontend_references": selection.j23_file_to_functions,
    "calltree": selection.t2_top_blockers,
    "test_files": selection.f28_files_by_word,
}
#: Analyses that answer on their own, without a report around them.
STANDALONE = ("source_lines", "far_reach_low_coverage", "public_candidates", "frontend_references")


def run_analysis(tables, name: str) -> DataFrame:
    """The registered analysis ``name`` over ``tables``."""
    if name not in ANALYSES:
        raise KeyError(f"no analysis {name!r}; there are {', '.join(ANALYSES)}")
    found = ANALYSES[name]
    if isinstance(found, str):
        from . import literals

        found = getattr(literals, found)
    return found(tables)
