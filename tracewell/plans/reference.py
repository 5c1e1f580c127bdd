"""Reachability, complexity, coverage and call-tree queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..operators import graph
from ..operators.joins import asof_backward, latest_by, merge_positional, overlapping, percentage, resolve_by_priority, within_range
from .domain import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Register a function of ``Tables`` as a query, with its SQL over the named views."""
    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(views, sql) if views else sql
        return f

    return add


# Shared steps ---------------------------------------------------------------------------------------------------------
def harness_reach(t: Tables) -> DataFrame:
    """(h, k): functions reached from each harness's entry point, the entry among them."""
    got = graph.reach_from(t.ed, t.hs.select(F.col("entry").alias("start")))
    return got.join(t.hs.withColumnRenamed("entry", "start"), "start").select("h", F.col("node").alias("k"))


def merged_lines(t: Tables) -> DataFrame:
    return t.cl.groupBy("k", "line").agg(F.max("hits").alias("hits"))


def hit_lines(t: Tables) -> DataFrame:
    """(k, n, hit): lines and lines hit of each function over all harnesses."""
    return merged_lines(t).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hits") > 0).alias("hit"))


def hit_counts(t: Tables) -> DataFrame:
    return harness_reach(t).groupBy("k").agg(F.count(F.lit(1)).alias("hc"))


def path_lists(calls: DataFrame) -> DataFrame:
    """(project_name, function_name, path_no, path): call paths from outermost callers to each called function."""
    packed = calls.select("project_name", "src_func", "site_dst").distinct().groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("site_dst", "src_func"))).alias("rows"))

    def paths(rows):
        callers: dict[str, list[str]] = {}
        for r in rows:
            callers.setdefault(r["site_dst"], []).append(r["src_func"])
        for target in sorted(callers):
            yield from ((target, i, p) for i, p in enumerate(graph.call_paths(target, callers)))

    schema = "project_name string, function_name string, path_no int, path array<string>"
    return packed.mapInArrow(graph.per_project(paths, schema), schema)


# Graph ----------------------------------------------------------------------------------------------------------------
@query("ed re", "select src, dst from re")
def g1_closure(t):
    """All functions reached by each function."""
    return graph.closure(t.ed)


@query()
def g2_function_depth(t):
    """Depth by the order-dependent worklist rule, per project in name order (tested against a restatement)."""
    calls = t.cs.filter("site_dst is not null").groupBy("project_name", "src_func").agg(F.sort_array(F.collect_set("site_dst")).alias("callees"))
    packed = calls.groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("src_func", "callees"))).alias("rows"))

    def depths(rows):
        got = graph.function_depths([r["src_func"] for r in rows], {r["src_func"]: r["callees"] for r in rows})
        return got.items()

    return packed.mapInArrow(graph.per_project(depths, "project_name string, function_name string, depth int"), "project_name string, function_name string, depth int")


@query("ed hs hr", "select h, k from hr")
def g3_harness_reach(t):
    """Functions reached by each harness from its entry point."""
    return harness_reach(t)


@query("ct", """select c.h, c.idx, max(p.idx) parent_idx from ct c left join ct p on p.h = c.h and p.idx < c.idx and p.depth = c.depth - 1 group by c.h, c.idx""")
def g4_calltree_parents(t):
    """Parent of each call-tree node from depths in pre-order."""
    return graph.parents_from_depth(t.ct, "h", "idx", "depth").select("h", "idx", "parent_idx")


@query("ct", "select h, idx, depth, row_number() over (partition by h order by idx) - 1 cov_ct_idx from ct")
def g5_preorder(t):
    """Pre-order numbering of the nodes of each tree."""
    return t.ct.select("h", "idx", "depth", (F.row_number().over(Window.partitionBy("h").orderBy("idx")).cast("long") - 1).alias("cov_ct_idx"))


@query("ct", """select c.h, c.idx, c.k, p.k parent_k from (select c.h, c.idx, c.k, max(p.idx) pi from ct c join ct p on p.h = c.h and p.idx < c.idx and p.depth = c.depth - 1 group by all) c
join ct p on p.h = c.h and p.idx = c.pi""")
def g6_parent_function(t):
    """Function that each call-tree node is called from."""
    nodes = graph.parents_from_depth(t.ct, "h", "idx", "depth").filter("parent_idx is not null")
    return nodes.select("h", "idx", "k", "parent_idx").join(t.ct.select("h", F.col("idx").alias("parent_idx"), F.col("k").alias("parent_k")), ["h", "parent_idx"]).select("h", "idx", "k", "parent_k")


@query()
def g7_call_paths(t):
    """Call paths from outermost callers to each called function, each function used once per target."""
    calls = t.cs.join(t.ff.select("project_name", F.col("function_name").alias("site_dst")), ["project_name", "site_dst"], "left_semi")
    return path_lists(calls).select("project_name", "function_name", "path_no", F.array_join("path", " > ").alias("call_path"))


@query("ed re", "select ed.dst k, count(*) parents, min(ed.src) first_parent from ed where exists (select 1 from re where re.src = ed.src and re.dst = ed.dst) group by 1")
def g8_direct_parents(t):
    """Direct callers of each function. A caller reaches what it calls, so being among the callers is the whole condition."""
    return t.ed.groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("parents"), F.min("src").alias("first_parent"))


@query("ed re", "select dst k, count(*) incoming, min(src) least, max(src) greatest from re group by 1")
def g9_incoming(t):
    """Incoming references: functions that reach each function."""
    return graph.closure(t.ed).groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("incoming"), F.min("src").alias("least"), F.max("src").alias("greatest"))


@query("ed hs hr", "select h, count(*) reached, sum(k)::bigint check_sum from hr group by 1")
def g10_frontend_reach(t):
    """Size of what each entry point reaches, visited once."""
    return harness_reach(t).groupBy("h").agg(F.count(F.lit(1)).alias("reached"), F.sum("k").alias("check_sum"))


@query("cs", "select project_name, site_dst function_name, count(distinct src_func) function_uses from cs where site_dst is not null group by 1, 2")
def g12_function_uses(t):
    """Number of functions that call each function."""
    pairs = t.cs.filter("site_dst is not null").select("project_name", "site_dst", "src_func").distinct()
    return pairs.groupBy("project_name", F.col("site_dst").alias("function_name")).agg(F.count("src_func").alias("function_uses"))


@query()
def g13_calltree_text(t):
    """Call tree of every entry function of each project (and one of each cycle without entry), in pre-order, each function
    expanded once a tree."""
    calls = t.cs.filter("site_dst is not null and src_func is not null")
    packed = calls.select("project_name", "src_func", "site_dst", F.coalesce("line", F.lit(0)).alias("line")).distinct().groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("src_func", "line", "site_dst"))).alias("rows"))

    def tree(rows):
        calls: dict[str, list[tuple[str, int]]] = {}
        for r in rows:
            calls.setdefault(r["src_func"], []).append((r["site_dst"], r["line"]))
        for entry in graph.call_tree_entries(calls):
            for i, (depth, name, line) in enumerate(graph.call_tree_lines(entry, calls)):
                yield entry, i, depth, name, line

    schema = "project_name string, entry_function string, idx int, depth int, function_name string, line long"
    return packed.mapInArrow(graph.per_project(tree, schema), schema)


@query("ed re", "select dst k, count(*) uses from re where src <> dst group by 1")
def g16_uses_by_reach(t):
    """Uses of a function counted over everything that reaches it."""
    return graph.closure(t.ed).filter("src <> dst").groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("uses"))


@query("", """with recursive l as (select p_partkey addr, case when p_partkey % 7 = 0 then null else p_partkey // 2 end base, case when p_partkey % 7 = 0 then p_brand end name from part
union all select -p_partkey - 1, -p_partkey - 2, case when p_partkey % 300 = 299 then p_brand end from part),
w as (select addr, base, name, 0 hops from l union select w.addr, l.base, l.name, w.hops + 1 from w join l on l.addr = w.base where w.name is null)
select addr, name, hops from w where name is not null""")
def g17_type_chain(t):
    """Type chains followed to the first name, of any length; chains that run into a cycle or end without a name give no row."""
    k = F.col("p_partkey")
    part = t.raw("part")
    short = part.select(k.alias("addr"), F.when(k % 7 != 0, F.floor(k / 2)).alias("base"), F.when(k % 7 == 0, F.col("p_brand")).alias("name"))
    long = part.select((-k - 1).alias("addr"), (-k - 2).alias("base"), F.when(k % 300 == 299, F.col("p_brand")).alias("name"))
    return graph.first_names(short.unionByName(long), "addr", "base", "name")


@query("fn ed re", """select re.src k, count(distinct f.file) files, min(f.file) first_file from re join fn f on f.k = re.dst and f.argc = 0 group by 1""")
def g19_reachable_attributes(t):
    """Set of an attribute over everything a function reaches."""
    near = graph.closure(t.ed).join(t.fn.filter("argc = 0").select(F.col("k").alias("dst"), "file"), "dst")
    return near.select(F.col("src").alias("k"), "file").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("first_file"))


@query("fn ct", """select c.h, c.idx, c.k, f.file from (select c.h, c.idx, c.depth, c.k, max(p.idx) pi from ct c join ct p on p.h = c.h and p.idx < c.idx and p.depth = c.depth - 1 group by all) c
join ct p on p.h = c.h and p.idx = c.pi join fn f on f.k = c.k join fn g on g.k = p.k join (select h, f.file root_file from ct join fn f using (k) where idx = 0) r on r.h = c.h
where (g.file = r.root_file and f.file <> r.root_file) or c.depth = 1""")
def g20_top_level_targets(t):
    """Call-tree edges that leave the harness's own file, or start at the root."""
    files = t.fn.select("k", "file")
    tree = graph.parents_from_depth(t.ct, "h", "idx", "depth").join(files, "k")
    parent = t.ct.join(files, "k").select("h", F.col("idx").alias("parent_idx"), F.col("file").alias("parent_file"))
    root = t.ct.filter("idx = 0").join(files, "k").select("h", F.col("file").alias("root_file"))
    met = tree.join(parent, ["h", "parent_idx"]).join(F.broadcast(root), "h")  # one row a harness
    return met.filter("(parent_file = root_file and file <> root_file) or depth = 1").select("h", "idx", "k", "file")


@query("ed re", """select k, count(*) roots from (select distinct re.dst k, re.src from re where re.src not in (select dst from ed)) group by 1""")
def g21_uncalled_callers(t):
    """Number of uncalled functions that reach each function."""
    roots = t.ed.select("src").distinct().join(t.ed.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    return graph.closure(t.ed).join(roots, "src", "left_semi").groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("roots"))


# Joins ----------------------------------------------------------------------------------------------------------------
@query("ed hs hr cl", """, ru as (select distinct h, k from cl where hits > 0)
select coalesce(a.k, b.k) k, count(a.h) static_reach, count(b.h) runtime_reach, count(*) combined_reach from hr a full join ru b on a.h = b.h and a.k = b.k group by 1""")
def j1_reach_by_harness(t):
    """Harnesses that reach each function: by calls, at run time, by either."""
    static = harness_reach(t).withColumn("s", F.lit(1))
    runtime = t.cl.filter("hits > 0").select("h", "k").distinct().withColumn("r", F.lit(1))
    return static.join(runtime, ["h", "k"], "full").groupBy("k").agg(F.count("s").alias("static_reach"), F.count("r").alias("runtime_reach"), F.count(F.lit(1)).alias("combined_reach"))


@query("cl", """, p as (select h, k, line, hits, row_number() over (partition by h, k order by line) pos from cl),
f as (select k, min(h) h from p group by 1), b as (select p.k, p.pos, p.line from p join f on f.k = p.k and f.h = p.h)
select b.k, b.pos, b.line, max(p.hits) hits from b join p on p.k = b.k and p.pos = b.pos group by all having max((p.line <> b.line)::int) = 0""")
def j2_coverage_merge(t):
    """Line coverage of all harnesses merged by place onto the first one, unequal lines dropped."""
    rows = t.cl.withColumn("pos", F.row_number().over(Window.partitionBy("h", "k").orderBy("line")).cast("long"))
    return merge_positional(rows, "h", "k", "pos", "line", "hits")


@query("", """with c as (select distinct function_source_file f from function_facts), r as (select distinct function_source_file f from all_functions_db)
select c.f, coalesce(a.f, b.f) resolved from c left join r a on a.f = c.f left join r b on b.f = lower(c.f)""")
def j3_key_resolution(t):
    """Keys resolved by the first of several forms that exists."""
    asked = t.raw("function_facts").select(F.col("function_source_file").alias("f")).distinct()
    return resolve_by_priority(asked, "f", t.raw("all_functions_db"), "function_source_file", [lambda c: c, F.lower])


@query("ct cl", """, n as (select c.h, c.idx, c.line, max(p.idx) pi from ct c join ct p on p.h = c.h and p.idx < c.idx and p.depth = c.depth - 1 group by all),
m as (select n.*, p.k pk from n join ct p on p.h = n.h and p.idx = n.pi)
select m.h, m.idx, coalesce(max(cl.hits), 0) hits from m left join cl on cl.h = m.h and cl.k = m.pk and cl.line = m.line group by all""")
def j4_node_hits(t):
    """Hits of the line of the calling function that each call-tree node is called from."""
    tree = graph.parents_from_depth(t.ct, "h", "idx", "depth").filter("parent_idx is not null").select("h", "idx", "line", "parent_idx")
    called = tree.join(t.ct.select("h", F.col("idx").alias("parent_idx"), F.col("k").alias("pk")), ["h", "parent_idx"])
    lines = t.cl.select("h", F.col("k").alias("pk"), "line", "hits")
    return called.join(lines, ["h", "pk", "line"], "left").select("h", "idx", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("ff cs", """select f.project_name, f.function_name, (select max(c.line) from cs c where c.project_name = f.project_name and c.file = f.function_source_file and c.line <= f.function_linenumber_end) nearest
from ff f""")
def j6_asof_site(t):
    """Nearest call site of the same file at or before the end of each function (as-of, backwards)."""
    key = lambda c: F.concat_ws("\t", "project_name", c)
    left = t.ff.select("project_name", "function_name", key("function_source_file").alias("by"), F.col("function_linenumber_end").cast("long").alias("at"))
    right = t.cs.filter("line is not null").select(key("file").alias("by"), F.col("line").alias("nearest"))
    return asof_backward(left, right, "by", "at", "nearest", ["nearest"]).select("project_name", "function_name", "nearest")


@query("ff cs", """select c.site_id, f.function_name from cs c join ff f on f.project_name = c.project_name and f.function_source_file = c.file
where c.line between f.function_linenumber and f.function_linenumber_end""")
def j7_line_to_function(t):
    """Functions whose lines hold each call site."""
    key = lambda c: F.concat_ws("\t", "project_name", c).alias("by")
    ranges = t.ff.select(key("function_source_file"), "function_name", "function_linenumber", "function_linenumber_end")
    return within_range(t.cs.select("site_id", key("file"), "line"), ranges, "by", "line", "function_linenumber", "function_linenumber_end").select("site_id", "function_name")


@query("fn", "select a.k, b.k other from fn a join fn b on a.file = b.file and a.b <= b.e and b.b <= a.e and a.k < b.k")
def j8_overlapping_spans(t):
    """Functions of one file whose line spans overlap."""
    left = t.fn.select("k", "file", "b", "e")
    right = t.fn.select(F.col("k").alias("other"), "file", F.col("b").alias("ob"), F.col("e").alias("oe"))
    return overlapping(left, right, "file", ("b", "e"), ("ob", "oe")).filter("k < other").select("k", "other")


@query("ct cl", """select ct.h, ct.idx, case when exists (select 1 from cl where cl.h = ct.h and cl.k = ct.k and cl.hits > 0 and cl.line between ct.line and ct.line + 9) then 100 else 0 end hits from ct""")
def j9_window_hit(t):
    """100 for nodes with a covered line among the ten from theirs, else 0."""
    asked = t.ct.select("h", "idx", "k", F.explode(F.sequence("line", F.col("line") + 9)).alias("line"))
    hit = t.cl.filter("hits > 0").select("h", "k", "line").distinct()
    found = asked.join(hit, ["h", "k", "line"]).select("h", "idx").distinct().withColumn("hits", F.lit(100))
    return t.ct.select("h", "idx").join(found, ["h", "idx"], "left").select("h", "idx", F.coalesce("hits", F.lit(0)).alias("hits"))


@query("ff cs", """, s as (select project_name, function_source_file f, function_name, function_linenumber b, lead(function_linenumber) over (partition by project_name, function_source_file order by function_linenumber, function_name) nb from ff)
select s.project_name, s.function_name, count(*) sites from s join cs on cs.project_name = s.project_name and cs.file = s.f where cs.line > s.b and (s.nb is null or cs.line < s.nb - 1) group by 1, 2""")
def j10_between_starts(t):
    """Call sites strictly between a function's first line and the line before the next function's."""
    key = lambda c: F.concat_ws("\t", "project_name", c).alias("by")
    starts = t.ff.select("project_name", key("function_source_file"), "function_name", F.col("function_linenumber").alias("b"))
    w = Window.partitionBy("by").orderBy("b", "function_name")
    ranges = starts.withColumn("nb", F.lead("b").over(w))
    sites = t.cs.filter("line is not null").select(key("file"), "line")
    met = asof_ranges(ranges, sites)
    return met.groupBy("project_name", "function_name").agg(F.count(F.lit(1)).alias("sites"))


def asof_ranges(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """Points strictly inside consecutive ranges of one key; an open last range takes all beyond its start."""
    closed = ranges.filter("nb is not null").withColumn("lo", F.col("b") + 1).withColumn("hi", F.col("nb") - 2).filter("lo <= hi")
    inner = within_range(points, closed.select("project_name", "function_name", "by", "lo", "hi"), "by", "line", "lo", "hi").select("project_name", "function_name")
    tail = ranges.filter("nb is null").join(points, "by").filter("line > b").select("project_name", "function_name")
    return inner.unionByName(tail)


@query("cs", "select project_name, site_dst function_name, src_func, count(*) sites, min(line) first_line from cs where site_dst is not null group by 1, 2, 3")
def j12_cross_references(t):
    """Functions whose call sites name each target, with their number and first line."""
    return t.cs.filter("site_dst is not null").groupBy("project_name", F.col("site_dst").alias("function_name"), "src_func").agg(F.count(F.lit(1)).alias("sites"), F.min("line").alias("first_line"))


@query("ff cs", "select c.project_name, c.site_dst function_name, count(*) sites from cs c where c.site_dst is not null and not exists (select 1 from ff f where f.project_name = c.project_name and f.function_name = c.site_dst) group by 1, 2")
def j13_third_party_calls(t):
    """Call sites of functions that the project does not define."""
    known = t.ff.select("project_name", F.col("function_name").alias("site_dst"))
    return t.cs.filter("site_dst is not null").join(known, ["project_name", "site_dst"], "left_anti").groupBy("project_name", F.col("site_dst").alias("function_name")).agg(F.count(F.lit(1)).alias("sites"))


@query("", """with d as (select project_name, min(snap_date) a, max(snap_date) b from all_functions_db group by 1),
af as (select * from all_functions_db qualify row_number() over (partition by project_name, snap_date, function_name, function_source_file order by load_ts desc) = 1),
v as (select project_name, snap_date, function_name, max(coalesce(line_cov, -1)) cov, max(coalesce(fuzzers_reaching, -1)) reach from af group by 1, 2, 3),
x as (select v.* from v join d on d.project_name = v.project_name and d.a = v.snap_date), y as (select v.* from v join d on d.project_name = v.project_name and d.b = v.snap_date)
select coalesce(x.project_name, y.project_name) project_name, coalesce(x.function_name, y.function_name) function_name,
case when x.function_name is null then 'only second' when y.function_name is null then 'only first' when x.cov < y.cov then 'better' when x.cov > y.cov then 'worse' else 'same' end verdict,
case when x.function_name is null or y.function_name is null then 'none' when x.reach < y.reach then 'more' when x.reach > y.reach then 'fewer' else 'same' end reach_verdict
from x full join y on x.project_name = y.project_name and x.function_name = y.function_name""")
def j15_report_diff(t):
    """First and last report of each project compared function by function, by coverage and by the harnesses that reach."""
    rows = t.raw("all_functions_db")
    ends = graph.stored(rows.groupBy("project_name").agg(F.min("snap_date").alias("a"), F.max("snap_date").alias("b")))
    dates = ends.select("project_name", F.explode(F.array_distinct(F.array("a", "b"))).alias("snap_date"))
    two = latest_by(rows.join(dates, ["project_name", "snap_date"], "left_semi"), ["project_name", "snap_date", "function_name", "function_source_file"], "load_ts", ["line_cov", "fuzzers_reaching"])
    best = two.groupBy("project_name", "snap_date", "function_name").agg(F.max(F.coalesce("line_cov", F.lit(-1.0))).alias("cov"), F.max(F.coalesce("fuzzers_reaching", F.lit(-1))).alias("reach"))
    # One row a function: of the first and of the last snapshot, without a join of the two.
    at = lambda c, end: F.max(F.when(F.col("snap_date") == F.col(end), F.col(c)))
    both = best.join(ends, "project_name").groupBy("project_name", "function_name").agg(at("cov", "a").alias("x"), at("cov", "b").alias("y"), at("reach", "a").alias("rx"), at("reach", "b").alias("ry"))
    verdict = F.when(F.col("x").isNull(), "only second").when(F.col("y").isNull(), "only first").when(F.col("x") < F.col("y"), "better").when(F.col("x") > F.col("y"), "worse").otherwise("same")
    reach = F.when(F.col("x").isNull() | F.col("y").isNull(), "none").when(F.col("rx") < F.col("ry"), "more").when(F.col("rx") > F.col("ry"), "fewer").otherwise("same")
    return both.select("project_name", "function_name", verdict.alias("verdict"), reach.alias("reach_verdict"))


@query("ps", """, a as (select distinct project_name p, 'ok' s from ps where fuzzer_count > 5), b as (select distinct project_name p, 'ok' s from ps where coverage_data is null), c as (select distinct project_name p, 'ok' s from ps where introspector_data is not null)
select coalesce(a.p, b.p, c.p) project_name, coalesce(a.s, 'N/A') fuzz_build, coalesce(b.s, 'N/A') cov_build, coalesce(c.s, 'N/A') intro_build from a full join b on a.p = b.p full join c on c.p = coalesce(a.p, b.p)""")
def j17_build_feeds(t):
    """Three feeds merged on the project; what a feed lacks is N/A."""
    feed = lambda cond, out: t.ps.filter(cond).select("project_name").distinct().withColumn(out, F.lit("ok"))
    rows = feed("fuzzer_count > 5", "fuzz_build").join(feed("coverage_data is null", "cov_build"), "project_name", "full").join(feed("introspector_data is not null", "intro_build"), "project_name", "full")
    return rows.fillna("N/A", ["fuzz_build", "cov_build", "intro_build"])


@query("ff", """, n as (select project_name, regexp_extract(function_source_file, '([^/]*)$', 1) base, function_source_file f from ff group by all)
select project_name, base, min(f) file from n group by 1, 2 having count(*) = 1""")
def j18_unique_basename(t):
    """Files of a project whose base name is theirs alone."""
    names = t.ff.select("project_name", basename(F.col("function_source_file")).alias("base"), F.col("function_source_file").alias("f")).distinct()
    return names.groupBy("project_name", "base").agg(F.min("f").alias("file"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


@query("fn ed hs hr cl", """, r as (select distinct f.file, hr.h from hr join fn f using (k)), c as (select distinct f.file, cl.h from cl join fn f using (k) where hits > 0)
select f.file, (select count(*) from r where r.file = f.file) reached_by, (select count(*) from c where c.file = f.file) covered_by from (select distinct file from fn) f""")
def j19_file_reach(t):
    """Harnesses that reach and that cover each file."""
    files = t.fn.select("k", "file")
    per = lambda d, out: d.join(files, "k").select("file", "h").distinct().groupBy("file").agg(F.count(F.lit(1)).alias(out))
    rows = t.fn.select("file").distinct().join(per(harness_reach(t), "reached_by"), "file", "left").join(per(t.cl.filter("hits > 0"), "covered_by"), "file", "left")
    return rows.fillna(0, ["reached_by", "covered_by"])


@query("ff", "select function_name, count(distinct project_name) projects from ff group by 1 having count(distinct project_name) > 1 union all select function_name, count(distinct project_name) from all_functions_db group by 1 having count(distinct project_name) > 1")
def j22_same_function(t):
    """Functions of one name in several projects."""
    def shared(d):
        return d.select("function_name", "project_name").distinct().groupBy("function_name").agg(F.count("project_name").alias("projects")).filter("projects > 1")

    return shared(t.ff).unionByName(shared(t.raw("all_functions_db")))


# Aggregations ---------------------------------------------------------------------------------------------------------
@query("fn ed re hs hr hc", """select f.k, (f.cc + coalesce(sum(g.cc), 0))::bigint total_cc,
(case when h.hc is null then f.cc else 0 end + coalesce(sum(g.cc) filter (hg.hc is null), 0))::bigint undiscovered_cc
from fn f left join re on re.src = f.k left join fn g on g.k = re.dst and not (g.file = f.file and g.b = f.b and g.e = f.e) left join hc h on h.k = f.k left join hc hg on hg.k = g.k group by f.k, f.cc, h.hc""")
def a2_complexity(t):
    """Accumulated complexity, and what of it no harness reaches; callees at the function's own place are skipped."""
    hc = hit_counts(t)
    fn = t.fn.join(hc, "k", "left").select("k", "file", "b", "e", "cc", F.when(F.col("hc").isNull(), F.col("cc")).otherwise(0).alias("un"))
    fn = graph.cut(fn)
    own, callee = fn, fn.select(F.col("k").alias("dst"), F.struct("file", "b", "e").alias("dplace"), F.col("cc").alias("dcc"), F.col("un").alias("dun"))
    pairs = graph.closure(t.ed).join(callee, "dst").join(own.select(F.col("k").alias("src"), F.struct("file", "b", "e").alias("place")), "src").filter("place <> dplace")
    below = pairs.groupBy(F.col("src").alias("k")).agg(F.sum("dcc").alias("scc"), F.sum("dun").alias("sun"))
    return own.join(below, "k", "left").select("k", (F.col("cc") + F.coalesce("scc", F.lit(0))).alias("total_cc"), (F.col("un") + F.coalesce("sun", F.lit(0))).alias("undiscovered_cc"))


@query("fn ed hs hr", "select h, count(*) functions, sum(bb)::bigint basic_blocks, sum(cc)::bigint complexity from hr join fn using (k) group by 1")
def a3_harness_totals(t):
    """Basic blocks and complexity over what each harness reaches."""
    return harness_reach(t).join(t.fn.select("k", "bb", "cc"), "k").groupBy("h").agg(F.count(F.lit(1)).alias("functions"), F.sum("bb").alias("basic_blocks"), F.sum("cc").alias("complexity"))


@query("fn ct", "select h, file, count(distinct k) functions from ct join fn using (k) group by 1, 2")
def a4_file_targets(t):
    """Files that each call tree touches, with the number of functions."""
    return t.ct.select("h", "k").distinct().join(t.fn.select("k", "file"), "k").groupBy("h", "file").agg(F.count(F.lit(1)).alias("functions"))


@query("fn ed hs hr hc", """select count(*) total, count(hc.k) reached, count(*) - count(hc.k) unreached, 100.0::double * count(hc.k) / count(*) reached_percent from fn left join hc using (k) where trim(file) <> '' and b <> -1""")
def a5_reach_summary(t):
    """Functions with source that are reached and not."""
    rows = t.fn.filter("trim(file) <> '' and b <> -1").join(hit_counts(t), "k", "left")
    r = rows.agg(F.count(F.lit(1)).alias("total"), F.count("hc").alias("reached"))
    return r.select("total", "reached", (F.col("total") - F.col("reached")).alias("unreached"), percentage(F.col("reached"), F.col("total")).alias("reached_percent"))


@query("fn ed hs hr hc", "select sum(cc)::bigint total_cc, coalesce(sum(cc) filter (hc.k is not null), 0)::bigint reached_cc, 100.0::double * coalesce(sum(cc) filter (hc.k is not null), 0) / sum(cc) reached_percent from fn left join hc using (k)")
def a6_complexity_summary(t):
    """Complexity that is reached and in all."""
    rows = t.fn.join(hit_counts(t), "k", "left").agg(F.sum("cc").alias("total_cc"), F.coalesce(F.sum(F.when(F.col("hc").isNotNull(), F.col("cc"))), F.lit(0)).alias("reached_cc"))
    return rows.withColumn("reached_percent", percentage(F.col("reached_cc"), F.col("total_cc")))


@query("fn cl cm cf", "select f.k, coalesce(n, 0) lines_total, coalesce(hit, 0) lines_hit, coalesce(100.0::double * hit / n, 0) hit_percent from fn f left join cf using (k)")
def a7_hit_summary(t):
    """Lines and lines hit of each function."""
    rows = t.fn.select("k").join(hit_lines(t), "k", "left")
    return rows.select("k", F.coalesce("n", F.lit(0)).alias("lines_total"), F.coalesce("hit", F.lit(0)).alias("lines_hit"), percentage(F.col("hit"), F.col("n")).alias("hit_percent"))


@query("fn cl cm cf", "select k from fn join cf using (k) where hit > 0 and trim(file) <> ''")
def a8_covered_functions(t):
    """Functions with source that run at least once."""
    return t.fn.filter("trim(file) <> ''").join(hit_lines(t).filter("hit > 0"), "k", "left_semi").select("k")


@query("fn ed hs hr hc cl cm cf", """select (select count(*) from hs) harnesses, x.*, complexity - complexity_reached complexity_unreached, functions - reached unreached,
100.0::double * complexity_reached / complexity complexity_reached_percent, 100.0::double * (complexity - complexity_reached) / complexity complexity_unreached_percent,
100.0::double * reached / functions reached_percent, 100.0::double * (functions - reached) / functions unreached_percent, round(covered::double / functions, 2) * 100 covered_percent
from (select count(*) functions, count(hc.k) reached, sum(cc)::bigint complexity, coalesce(sum(cc) filter (hc.k is not null), 0)::bigint complexity_reached,
count(*) filter (cf.hit > 0) covered from fn left join hc using (k) left join cf using (k) where trim(file) <> '' and b <> -1) x""")
def a9_project_stats(t):
    """One-row record of the project; the share of covered functions is rounded before it is scaled."""
    rows = t.fn.filter("trim(file) <> '' and b <> -1").join(hit_counts(t), "k", "left").join(hit_lines(t).select("k", "hit"), "k", "left")
    r = rows.agg(F.count(F.lit(1)).alias("functions"), F.count("hc").alias("reached"), F.sum("cc").alias("complexity"), F.coalesce(F.sum(F.when(F.col("hc").isNotNull(), F.col("cc"))), F.lit(0)).alias("complexity_reached"), F.count_if(F.col("hit") > 0).alias("covered"))
    one = t.hs.agg(F.count(F.lit(1)).alias("harnesses")).crossJoin(r)  # one row each
    rest, left = F.col("complexity") - F.col("complexity_reached"), F.col("functions") - F.col("reached")
    shares = [percentage(F.col("complexity_reached"), F.col("complexity")).alias("complexity_reached_percent"), percentage(rest, F.col("complexity")).alias("complexity_unreached_percent"), percentage(F.col("reached"), F.col("functions")).alias("reached_percent"), percentage(left, F.col("functions")).alias("unreached_percent")]
    share = F.round(F.coalesce(F.try_divide(F.col("covered").cast("double"), F.col("functions")), F.lit(0.0)), 2) * 100
    return one.select("harnesses", "functions", "reached", "complexity", "complexity_reached", "covered", rest.alias("complexity_unreached"), left.alias("unreached"), *shares, share.alias("covered_percent"))


@query("ed hs hr cl", """, r as (select h, count(*) n from hr group by 1), c as (select h, count(distinct hr.k) n from hr join (select distinct h, k from cl where hits > 0) using (h, k) group by 1)
select r.h, r.n reached, coalesce(c.n, 0) covered, 100.0::double * coalesce(c.n, 0) / r.n proportion, 100.0::double * coalesce(c.n, 0) / r.n < 30 low from r left join c using (h)""")
def a10_coverage_of_reach(t):
    """Share of what a harness reaches that it also runs; low below 30 percent."""
    run = t.cl.filter("hits > 0").select("h", "k").distinct().withColumn("c", F.lit(1))
    rows = harness_reach(t).join(run, ["h", "k"], "left").groupBy("h").agg(F.count(F.lit(1)).alias("reached"), F.count("c").alias("covered"))
    share = percentage(F.col("covered"), F.col("reached"))
    return rows.select("h", "reached", "covered", share.alias("proportion"), (share < 30).alias("low"))


def branch_sides(t: Tables) -> DataFrame:
    """(project, function, branch, side number, side, callee): one row per callee of a branch side."""
    b = t.ff.select("project_name", "function_name", F.explode("branch_profiles").alias("b"))
    s = b.select("project_name", "function_name", basename(F.col("b.branch_string")).alias("branch"), F.posexplode("b.branch_sides").alias("side_no", "s"))
    return s.select("project_name", "function_name", "branch", "side_no", F.col("s.branch_side").alias("side"), F.col("s.branch_side_funcs").alias("callees"))


def totals(t: Tables) -> DataFrame:
    """(project, function, total): own complexity and that of the functions reached, without those at the function's place."""
    place = lambda p: F.struct("function_source_file", "function_linenumber", "function_linenumber_end").alias(p)
    own = t.ff.select("project_name", "function_name", "functions_reached", place("p"), F.col("cyclomatic_complexity").alias("cc"))
    below = own.select("project_name", "function_name", "p", F.explode(F.array_distinct("functions_reached")).alias("callee"))
    callee = t.ff.select("project_name", F.col("function_name").alias("callee"), place("q"), F.col("cyclomatic_complexity").alias("ccc"))
    summed = below.join(callee, ["project_name", "callee"]).filter("not p <=> q").groupBy("project_name", "function_name").agg(F.sum("ccc").alias("s"))
    return own.select("project_name", "function_name", "cc").join(summed, ["project_name", "function_name"], "left").select("project_name", "function_name", (F.coalesce("cc", F.lit(0)) + F.coalesce("s", F.lit(0))).alias("total"))


def hit_functions(t: Tables) -> DataFrame:
    """(project, function) with coverage in the project's last snapshot."""
    last = t.raw("all_functions_db").groupBy("project_name").agg(F.max("snap_date").alias("snap_date"))
    return t.af.join(last, ["project_name", "snap_date"], "left_semi").filter("line_cov > 0").select("project_name", "function_name").distinct()


_SIDES = """, bp as (select project_name, function_name, unnest(branch_profiles) b from ff),
bs as (select project_name, function_name, regexp_extract(b.branch_string, '([^/]*)$', 1) branch, b.branch_sides sides, unnest(range(len(b.branch_sides))) side_no from bp),
sd as (select project_name, function_name, branch, side_no, sides[side_no + 1].branch_side side, sides[side_no + 1].branch_side_funcs callees from bs)"""


_SIDE_CC = _SIDES + """, rc as (select distinct project_name, function_name, unnest(functions_reached) callee from ff),
tc as (select f.project_name, f.function_name, (coalesce(f.cyclomatic_complexity, 0) + coalesce(sum(g.cyclomatic_complexity), 0))::bigint total from ff f left join rc on rc.project_name = f.project_name and rc.function_name = f.function_name
 left join ff g on g.project_name = rc.project_name and g.function_name = rc.callee and (g.function_source_file is distinct from f.function_source_file or g.function_linenumber is distinct from f.function_linenumber or g.function_linenumber_end is distinct from f.function_linenumber_end)
 group by f.project_name, f.function_name, f.cyclomatic_complexity),
hf as (select distinct project_name, function_name from af where (project_name, snap_date) in (select project_name, max(snap_date) from all_functions_db group by 1) and line_cov > 0),
ex as (select project_name, function_name, branch, side_no, unnest(callees) callee from sd),
nm as (select project_name, function_name, branch, callee, count(distinct side_no) n from ex group by all),
ec as (select e.*, tc.total, nm.n = 1 only_here, hf.function_name is null not_hit from ex e join nm using (project_name, function_name, branch, callee)
 join tc on tc.project_name = e.project_name and tc.function_name = e.callee left join hf on hf.project_name = e.project_name and hf.function_name = e.callee),
sc as (select s.project_name, s.function_name, s.branch, s.side_no::int side_no, s.side, coalesce(sum(total), 0)::bigint reachable_cc, coalesce(sum(total) filter (not_hit), 0)::bigint not_covered_cc,
 coalesce(sum(total) filter (only_here), 0)::bigint unique_reachable_cc, coalesce(sum(total) filter (only_here and not_hit), 0)::bigint unique_not_covered_cc
 from sd s left join ec on ec.project_name = s.project_name and ec.function_name = s.function_name and ec.branch = s.branch and ec.side_no = s.side_no group by s.project_name, s.function_name, s.branch, s.side_no, s.side)"""


@query("ff af", _SIDE_CC + " select * from sc")
def a11_side_complexity(t):
    """Accumulated complexity behind each branch side, callees counted as often as they are named: in all, of functions not
    hit, and both of callees that no other side of the branch names."""
    key = ["project_name", "function_name", "branch"]
    sides = branch_sides(t)
    each = sides.select(*key, "side_no", F.explode("callees").alias("callee"))
    sole = each.distinct().groupBy(*key, "callee").agg((F.count(F.lit(1)) == 1).alias("only_here"))
    total = totals(t).select("project_name", F.col("function_name").alias("callee"), "total")
    hit = hit_functions(t).select("project_name", F.col("function_name").alias("callee"), F.lit(True).alias("ran"))
    rows = each.join(sole, [*key, "callee"]).join(total, ["project_name", "callee"]).join(hit, ["project_name", "callee"], "left")
    part = lambda out, *conds: F.coalesce(F.sum(F.when(conds[0] & conds[-1], F.col("total")) if conds else F.col("total")), F.lit(0)).alias(out)
    cold, only = F.col("ran").isNull(), F.col("only_here")
    sums = rows.groupBy(*key, "side_no").agg(part("reachable_cc"), part("not_covered_cc", cold), part("unique_reachable_cc", only), part("unique_not_covered_cc", only, cold))
    names = ["reachable_cc", "not_covered_cc", "unique_reachable_cc", "unique_not_covered_cc"]
    return sides.select(*key, "side_no", "side").join(sums, [*key, "side_no"], "left").fillna(0, names)


@query("ct", """select b.colour, count(ct.h) nodes from (values ('red'), ('gold'), ('yellow'), ('greenyellow'), ('lawngreen')) b(colour)
left join ct on b.colour = case when hits between 1 and 9 then 'gold' when hits between 10 and 29 then 'yellow' when hits between 30 and 49 then 'greenyellow' when hits between 50 and 99999999 then 'lawngreen' else 'red' end group by 1""")
def a12_colours(t):
    """Call-tree nodes in five fixed classes of hits."""
    h = F.col("hits")
    colour = F.when(h.between(1, 9), "gold").when(h.between(10, 29), "yellow").when(h.between(30, 49), "greenyellow").when(h.between(50, 99999999), "lawngreen").otherwise("red")
    counts = t.ct.groupBy(colour.alias("colour")).agg(F.count(F.lit(1)).alias("n"))
    every = t.spark.createDataFrame([(c,) for c in ("red", "gold", "yellow", "greenyellow", "lawngreen")], "colour string")
    return every.join(counts, "colour", "left").select("colour", F.coalesce("n", F.lit(0)).alias("nodes"))


@query("cs", "select project_name, site_dst function_name, count(*) call_sites, count(distinct src_func) callers from cs where site_dst is not null group by 1, 2")
def a13_reference_counts(t):
    """Call sites and callers of each function."""
    per = t.cs.filter("site_dst is not null").groupBy("project_name", "site_dst", "src_func").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("project_name", F.col("site_dst").alias("function_name")).agg(F.sum("n").alias("call_sites"), F.count("src_func").alias("callers"))


_LANGS = "(values ('c', 0), ('cc', 1), ('cpp', 1), ('java', 2), ('py', 3), ('rs', 4), ('go', 5)) l(ext, ord)"


@query("ff", f""", x as (select project_name, ord, count(distinct function_source_file) n from ff join {_LANGS} on ext = regexp_extract(function_source_file, '\\.([a-z]+)$', 1) group by 1, 2)
select project_name, ord::int lang_no from x qualify row_number() over (partition by project_name order by n desc, ord desc) = 1""")
def a14_language(t):
    """Language with most files; of equal ones the later."""
    langs = t.spark.createDataFrame([("c", 0), ("cc", 1), ("cpp", 1), ("java", 2), ("py", 3), ("rs", 4), ("go", 5)], "ext string, ord int")
    files = t.ff.select("project_name", "function_source_file").distinct().withColumn("ext", F.regexp_extract("function_source_file", r"\.([a-z]+)$", 1))
    counts = files.join(F.broadcast(langs), "ext").groupBy("project_name", "ord").agg(F.count(F.lit(1)).alias("n"))  # seven rows
    return counts.groupBy("project_name").agg(F.max(F.struct("n", "ord")).alias("m")).select("project_name", F.col("m.ord").alias("lang_no"))


@query("ps", """, l as (select * from ps qualify row_number() over (partition by project_name order by snap_date desc) = 1),
x as (select lower(coalesce(proj_lang, 'n/a')) lang, coverage_data.line_coverage v from l), y as (select * from x union all select 'jvm', v from x where lang = 'java')
select lang, count(*) projects, sum(v.count)::bigint lines_total, sum(v.covered)::bigint lines_covered from y group by 1""")
def a15_coverage_by_language(t):
    """Line coverage of each language over the latest day of its projects; what is java counts for jvm as well."""
    last = t.ps.groupBy("project_name").agg(F.max_by(F.struct("proj_lang", "coverage_data.line_coverage"), "snap_date").alias("m"))
    lang = F.lower(F.coalesce("m.proj_lang", F.lit("n/a")))
    rows = last.select(F.explode(F.when(lang == "java", F.array(lang, F.lit("jvm"))).otherwise(F.array(lang))).alias("lang"), F.col("m.line_coverage").alias("v"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("projects"), F.sum("v.count").alias("lines_total"), F.sum("v.covered").alias("lines_covered"))


@query("ps", """select lower(coalesce(proj_lang, 'n/a')) lang, count(*) total, count(*) filter (coverage_data is not null) with_coverage, count(*) filter (introspector_data is not null) with_report, count(*) filter (fuzzer_count > 0) with_fuzzers from ps group by 1""")
def a16_status_by_language(t):
    """Days with and without results by language."""
    return t.ps.groupBy(F.lower(F.coalesce("proj_lang", F.lit("n/a"))).alias("lang")).agg(F.count(F.lit(1)).alias("total"), F.count("coverage_data").alias("with_coverage"), F.count("introspector_data").alias("with_report"), F.count_if(F.col("fuzzer_count") > 0).alias("with_fuzzers"))


@query("ps", """select snap_date, count(*) - 1 project_count, sum(fuzzer_count)::bigint fuzzers, sum(introspector_data.function_count)::bigint functions, sum(coverage_data.line_coverage.count)::bigint lines_total, sum(coverage_data.line_coverage.covered)::bigint lines_covered from ps group by 1""")
def a17_daily_totals(t):
    """Totals of each day over all projects; the number of projects starts at -1, as it always has."""
    return t.ps.groupBy("snap_date").agg((F.count(F.lit(1)) - 1).alias("project_count"), F.sum("fuzzer_count").alias("fuzzers"), F.sum("introspector_data.function_count").alias("functions"), F.sum("coverage_data.line_coverage.count").alias("lines_total"), F.sum("coverage_data.line_coverage.covered").alias("lines_covered"))


@query("db", """select floor(max(project_count) * 1.2::double)::bigint max_projects, floor(max(fuzzer_count) * 1.2::double)::bigint max_fuzzers, floor(max(function_count) * 1.2::double)::bigint max_functions, floor(max(accummulated_lines_total) * 1.2::double)::bigint max_lines from db""")
def a18_front_page(t):
    """Greatest value of each measure, with a fifth on top, cut to whole numbers."""
    top = lambda c, out: F.floor(F.max(c).cast("double") * F.lit(1.2).cast("double")).cast("long").alias(out)
    return t.db.agg(top("project_count", "max_projects"), top("fuzzer_count", "max_fuzzers"), top("function_count", "max_functions"), top("accummulated_lines_total", "max_lines"))


@query("ps", """, s as (select project_name, snap_date, coverage_data.line_coverage.percent p, row_number() over (partition by project_name order by snap_date desc) r from ps where coverage_data.line_coverage.percent is not null),
g as (select project_name, coalesce(max(p) filter (r > 1), 0) max_past, round(avg(p::decimal(28, 9)), 2)::double mean_cov, max(p) filter (r = 1) as now_cov, max(snap_date) last_date from s group by 1)
select project_name, max_past, mean_cov, now_cov, max_past - now_cov > 5 degraded, last_date < (select max(snap_date) from ps) lost from g""")
def a19_degradation(t):
    """Best past, mean and current coverage of each series, whether it fell by more than 5 points below its best, and whether
    the series has no value on the last day of all."""
    s = t.ps.select("project_name", "snap_date", F.col("coverage_data.line_coverage.percent").alias("p")).filter("p is not null")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("project_name").orderBy(F.desc("snap_date"))))
    mean = F.round(F.sum(F.col("p").cast("decimal(28,9)")).cast("double") / F.count("p"), 2)
    g = r.groupBy("project_name").agg(F.coalesce(F.max(F.when(F.col("r") > 1, F.col("p"))), F.lit(0.0)).alias("max_past"), mean.alias("mean_cov"), F.max(F.when(F.col("r") == 1, F.col("p"))).alias("now_cov"), F.max("snap_date").alias("last_date"))
    end = t.raw("project_snapshots").agg(F.max("snap_date").alias("end_date"))
    return g.crossJoin(F.broadcast(end)).select("project_name", "max_past", "mean_cov", "now_cov", (F.col("max_past") - F.col("now_cov") > 5).alias("degraded"), (F.col("last_date") < F.col("end_date")).alias("lost"))  # one row


@query("ct", "select h, max(depth) max_depth from ct group by 1")
def a21_max_depth(t):
    """Greatest depth of each call tree."""
    return t.ct.groupBy("h").agg(F.max("depth").alias("max_depth"))


@query("ff", r"select distinct project_name, regexp_extract(function_name, '\[(.*?)\]\.', 1) class_name from ff where regexp_extract(function_name, '\[(.*?)\]\.', 1) <> ''")
def a22_public_classes(t):
    """Classes named in bracketed function names."""
    name = F.regexp_extract("function_name", r"\[(.*?)\]\.", 1)
    return t.ff.select("project_name", name.alias("class_name")).filter("class_name <> ''").distinct()


@query("ff", """, x as (select project_name, function_name, coalesce(edge_count, 0)::bigint e, coalesce(bb_count, 0)::bigint n from ff union all select 'fixture', 'many_edges', 1000010, 3 union all select 'fixture', 'switch', 2, 9),
y as (select *, case when e < n then e + n else e end - n + 2 c from x) select project_name, function_name, case when c > 999999 then 1 else c end complexity from y""")
def a24_cyclomatic(t):
    """Complexity E - N + 2 from edges and blocks (null counts as 0). Fewer edges than blocks means unhandled switches, and
    the blocks are added to the edges; above 999999 it is 1. Two rows of literals meet these rules."""
    e, n = F.coalesce("edge_count", F.lit(0)).cast("long"), F.coalesce("bb_count", F.lit(0)).cast("long")
    more = t.spark.createDataFrame([("fixture", "many_edges", 1000010, 3), ("fixture", "switch", 2, 9)], "project_name string, function_name string, e long, n long")
    rows = t.ff.select("project_name", "function_name", e.alias("e"), n.alias("n")).unionByName(more)
    c = F.when(F.col("e") < F.col("n"), F.col("e")).otherwise(F.col("e") - F.col("n")) + 2
    return rows.select("project_name", "function_name", F.when(c > 999999, 1).otherwise(c).cast("long").alias("complexity"))


@query("ff", """select project_name, return_type, regexp_extract(function_name, '([A-Za-z_]+)', 1) stem, function_name, arg_count from ff
qualify row_number() over (partition by project_name, return_type, regexp_extract(function_name, '([A-Za-z_]+)', 1) order by arg_count desc nulls last, function_name) = 1""")
def a27_overloads(t):
    """Of overloads with one return type and stem, the one with most arguments."""
    rows = t.ff.select("project_name", "return_type", F.regexp_extract("function_name", "([A-Za-z_]+)", 1).alias("stem"), "function_name", "arg_count")
    w = Window.partitionBy("project_name", "return_type", "stem").orderBy(F.desc_nulls_last("arg_count"), "function_name")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


@query("af", """select project_name, snap_date, sum(cyclomatic_complexity) filter (fuzzers_reaching > 0)::bigint reached_cc, sum(cyclomatic_complexity)::bigint total_cc, count(*) filter (line_cov > 0) covered
from af group by 1, 2""")
def a28_reach_over_time(t):
    """Reached complexity and covered functions of each snapshot, of each function its latest delivery."""
    return t.af.groupBy("project_name", "snap_date").agg(F.sum(F.when(F.col("fuzzers_reaching") > 0, F.col("cyclomatic_complexity"))).alias("reached_cc"), F.sum("cyclomatic_complexity").alias("total_cc"), F.count_if(F.col("line_cov") > 0).alias("covered"))
