"""Filters, windows, rankings, set operations and sinks as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.paths import basename, dirname
from ..operators import graph, series
from ..operators.joins import percentage
from . import reference as base
from .reference import branch_sides, harness_reach, hit_counts, hit_lines, query


# Filters --------------------------------------------------------------------------------------------------------------
@query("ff", r"""select project_name, function_name, regexp_replace(function_name, '[ \t\r\n]', '', 'g') normal_name, regexp_replace(function_name, '<[\s.,a-zA-Z0-9]+>', '', 'g') plain_name,
case when starts_with(function_name, '[') then function_name else concat('[', function_source_file, '].', function_name) end full_name
from (select project_name, function_name, function_source_file from ff union all values ('fixture', '[pkg.Map<K, V>].put(java.lang.String,T)', 'Map.java'), ('fixture', E'a\tb c', 'x.c'))""")
def f1_normalised_names(t):
    """Names without blanks, without generics, and with their package. Mangled names stay as they are: no demangler is here."""
    more = t.spark.createDataFrame([("fixture", "[pkg.Map<K, V>].put(java.lang.String,T)", "Map.java"), ("fixture", "a\tb c", "x.c")], "project_name string, function_name string, function_source_file string")
    rows = t.ff.select("project_name", "function_name", "function_source_file").unionByName(more)
    n = F.col("function_name")
    return rows.select("project_name", "function_name", P.without_blanks(n).alias("normal_name"), P.without_generics(n).alias("plain_name"), P.with_package(F.col("function_source_file"), n).alias("full_name"))


@query("ff", base._SIDES + r" select project_name, function_name, branch, side_no::int side_no, array_to_string(list_transform(list_filter(callees, lambda x: not regexp_matches(x, '^__sanitizer|^llvm\.|^__assert|.*printf$')), lambda x: replace(x, ' ', '')), ',') callees from sd")
def f2_visible_callees(t):
    """Callees of branch sides without runtime and output functions."""
    return branch_sides(t).select("project_name", "function_name", "branch", "side_no", F.array_join(F.transform(P.visible_callees(F.col("callees")), lambda x: F.replace(x, F.lit(" "), F.lit(""))), ",").alias("callees"))


@query("ff", "select project_name, function_name from ff where not regexp_matches(function_name, 'sanitizer|llvm|LLVMFuzzerTestOneInput')")
def f4_mergeable(t):
    """Functions that take part in the merge."""
    return t.ff.filter(P.mergeable(F.col("function_name"))).select("project_name", "function_name")


@query("ff", "select project_name, function_name from ff where trim(function_source_file) <> '' and function_linenumber <> -1")
def f5_with_source(t):
    """Functions with a source file and line."""
    return t.ff.filter(P.with_source(F.col("function_source_file"), F.col("function_linenumber"))).select("project_name", "function_name")


_PREFIX = """, src as (select project_name, function_source_file f from ff where function_source_file <> '' and not contains(function_source_file, '/usr/include/')),
p as (select project_name, min(f) a, max(f) b from src group by 1), i as (select project_name, a, b, unnest(range(1, length(a) + 1)) i from p),
px as (select project_name, coalesce(max(substr(a, 1, i)) filter (a[i] = '/' and substr(a, 1, i) = substr(b, 1, i)), '/') prefix from i group by 1)"""


@query("ff", _PREFIX + " select project_name, prefix from px")
def f6_common_prefix(t):
    """Common folder of all files of a project, system headers left out: that of the least and the greatest path."""
    files = t.ff.filter("function_source_file <> '' and not contains(function_source_file, '/usr/include/')")
    ends = files.groupBy("project_name").agg(F.min("function_source_file").alias("a"), F.max("function_source_file").alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    shared = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b)) - 1), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)), lambda i: F.element_at(a, i)), "/")
    return ends.select("project_name", F.concat(shared, F.lit("/")).alias("prefix"))


@query("ff", _PREFIX + " select ff.project_name, function_name, replace(function_source_file, prefix, '') path from ff join px using (project_name)")
def f6_relative_paths(t):
    """Files without the common folder of their project, wherever in the path it stands."""
    rows = t.ff.join(f6_common_prefix(t), "project_name")
    return rows.select("project_name", "function_name", F.replace("function_source_file", F.col("prefix"), F.lit("")).alias("path"))


@query("fn ed re hs hr hc", """, x as (select f.k, f.argc, f.bb, f.cc + coalesce(sum(g.cc), 0) total, case when h.hc is null then f.cc else 0 end + coalesce(sum(g.cc) filter (hg.hc is null), 0) un, h.hc
from fn f left join re on re.src = f.k left join fn g on g.k = re.dst and not (g.file = f.file and g.b = f.b and g.e = f.e) left join hc h on h.k = f.k left join hc hg on hg.k = g.k group by f.k, f.argc, f.bb, f.cc, h.hc)
select k, total::bigint total_cc, un::bigint undiscovered_cc from x where hc is null and argc <> 0 and bb > 1 and total >= 20 and un >= 35 and k in (select src from ed) and k in (select k from fn where not contains(name, 'main2') and name <> 'main')""")
def f8_optimal_candidates(t):
    """Unreached functions with arguments, blocks and enough complexity behind them."""
    named = t.fn.filter("not contains(name, 'main2') and name <> 'main'").select("k", "argc", "bb")
    calling = t.ed.select(F.col("src").alias("k")).distinct()
    rows = base.a2_complexity(t).join(named, "k").join(calling, "k", "left_semi").join(hit_counts(t).select("k"), "k", "left_anti")
    return rows.filter("argc <> 0 and bb > 1 and total_cc >= 20 and undiscovered_cc >= 35").select("k", "total_cc", "undiscovered_cc")


@query("cl cm cf", """select k, n, hit from (select * from cf union all select -1, 40, 10 union all select -2, 40, 30 union all select -3, 30, 1) where n > 30 and 100.0::double * hit / n < 55""")
def f9_low_coverage(t):
    """Functions of more than 30 lines of which less than 55 percent are hit. Three rows of literals lie about the bounds."""
    more = t.spark.createDataFrame([(-1, 40, 10), (-2, 40, 30), (-3, 30, 1)], "k long, n long, hit long")
    return hit_lines(t).unionByName(more).filter((F.col("n") > 30) & (percentage(F.col("hit"), F.col("n")) < 55))


@query("fn cl cm cf", "select f.k, f.cc, coalesce(100.0::double * hit / n, 0) hit_percent from fn f left join cf using (k) where coalesce(100.0::double * hit / n, 0) <= 20 and f.cc >= 5")
def f10_functions_of_interest(t):
    """Functions of some complexity that are hardly covered."""
    rows = base.a7_hit_summary(t).join(t.fn.select("k", "cc"), "k")
    return rows.filter("hit_percent <= 20 and cc >= 5").select("k", "cc", "hit_percent")


_KEYS = "|".join(sorted({f for w in P.KEYWORDS for f in (w, w.replace("_", ""))}))


@query("ff", f"select project_name, function_name from (select project_name, function_name from ff union all values ('fixture', 'DeSerializeAll'), ('fixture', 'myReadJsonDoc'), ('fixture', 'pack_all')) where regexp_matches(lower(function_name), '{_KEYS}')")
def f11_keyword_names(t):
    """Functions whose names hold one of the thirteen keywords, with or without its underscores."""
    more = t.spark.createDataFrame([("fixture", "DeSerializeAll"), ("fixture", "myReadJsonDoc"), ("fixture", "pack_all")], "project_name string, function_name string")
    return t.ff.select("project_name", "function_name").unionByName(more).filter(P.keyword_name(F.col("function_name")))


@query("ff", "select project_name, function_name from ff where (len(arg_types) = 1 and (contains(arg_types[1], 'char *') or contains(arg_types[1], 'string'))) or (len(arg_types) = 2 and contains(arg_types[1], 'char *') and contains(arg_types[2], 'int'))")
def f12_easy_parameters(t):
    """Functions that take a text, or a text and a number."""
    return t.ff.filter(P.easy_parameters(F.col("arg_types"))).select("project_name", "function_name")


_EXCL = "|".join(P.PUBLIC_EXCLUDED)


@query("ff", f"select project_name, function_name from ff where linkage_type = 'externalLinkage' and arg_count > 0 and not regexp_matches(lower(function_name), '{_EXCL}')")
def f13_public_candidates(t):
    """Visible functions with arguments and none of the excluded words."""
    return t.ff.filter((F.col("linkage_type") == "externalLinkage") & P.public_candidate(F.col("function_name"), F.col("arg_count"))).select("project_name", "function_name")


@query("cs", "select site_id, site_dst from cs where site_dst in ('xp_alloc', 'xp_open', 'xp_log')")
def f14_sink_calls(t):
    """Call sites of a catalogue of sinks."""
    sinks = t.spark.createDataFrame([("xp_alloc",), ("xp_open",), ("xp_log",)], "site_dst string")
    return t.cs.join(F.broadcast(sinks), "site_dst", "left_semi").select("site_id", "site_dst")  # a fixed catalogue


@query("cs", r"select site_id from cs where not regexp_matches(src_func, '^xp_') and not regexp_matches(coalesce(file, ''), '^extern') and (site_dst is null or not regexp_matches(site_dst, '^xp_'))")
def f15_excluded_by_pattern(t):
    """Call sites left after exclusion by function, file and target."""
    return t.cs.filter(~F.col("src_func").rlike("^xp_") & ~F.coalesce("file", F.lit("")).rlike("^extern") & (F.col("site_dst").isNull() | ~F.col("site_dst").rlike("^xp_"))).select("site_id")


@query("ff", "select project_name, function_name from (select project_name, function_name, function_source_file from ff union all values ('fixture', 'malloc', ''), ('fixture', 'own', 'a.c'), ('fixture', 'free', null)) where coalesce(function_source_file, '') = ''")
def f16_without_file(t):
    """Functions of third parties: those without a source file. The facts have none, so literals stand for them."""
    more = t.spark.createDataFrame([("fixture", "malloc", ""), ("fixture", "own", "a.c"), ("fixture", "free", None)], "project_name string, function_name string, function_source_file string")
    rows = t.ff.select("project_name", "function_name", "function_source_file").unionByName(more)
    return rows.filter(F.coalesce("function_source_file", F.lit("")) == "").select("project_name", "function_name")


_LAST = "l as (select * from all_functions_db where (project_name, snap_date) in (select project_name, max(snap_date) from all_functions_db group by 1) qualify row_number() over (partition by project_name, function_name, function_source_file order by load_ts desc) = 1)"


def last_functions(t) -> DataFrame:
    """Functions of each project's last snapshot, latest delivery of each."""
    rows = t.raw("all_functions_db")
    last = rows.groupBy("project_name").agg(F.max("snap_date").alias("snap_date"))
    cols = [c for c in rows.columns if c not in ("project_name", "function_name", "function_source_file", "load_ts")]
    return base_latest(rows.join(last, ["project_name", "snap_date"], "left_semi"), cols)


def base_latest(rows: DataFrame, cols: list[str]) -> DataFrame:
    from ..operators.joins import latest_by

    return latest_by(rows, ["project_name", "function_name", "function_source_file"], "load_ts", cols)


@query("", f"with {_LAST} select project_name, function_name, function_source_file, cyclomatic_complexity, line_cov from l where line_cov < 20.0 and fuzzers_reaching > 0")
def f18_web_interest(t):
    """Reached functions covered below 20 percent in the last snapshot."""
    return last_functions(t).filter("line_cov < 20.0 and fuzzers_reaching > 0").select("project_name", "function_name", "function_source_file", "cyclomatic_complexity", "line_cov")


@query("", f"with {_LAST} select project_name, function_name, function_source_file, return_type from l where return_type = string_split('int<T>', '<')[1] and contains(lower(function_name), 'table') order by project_name, function_name, function_source_file limit 180")
def f20_search(t):
    """Functions by return type (asked for with generics, which are cut off) and part of the name, the first 180."""
    rows = last_functions(t).filter((F.col("return_type") == F.substring_index(F.lit("int<T>"), "<", 1)) & F.lower("function_name").contains("table"))
    return rows.select("project_name", "function_name", "function_source_file", "return_type").orderBy("project_name", "function_name", "function_source_file").limit(180)


_BAN = "|".join(P.BANNED_PATHS)


@query("", f"select distinct project_name, function_source_file from (select project_name, function_source_file from all_functions_db union all values ('my-lib', '/work/x.c'), ('my-lib', '/src/libfuzzer/x.c'), ('mylib', '/work/x.c'), ('MyLib', '/src/MYLIB/a.c')) where not regexp_matches(function_source_file, '{_BAN}') and (contains(lower(function_source_file), concat('/src/', lower(project_name))) or contains(project_name, '-'))")
def f21_allowed_paths(t):
    """Source files outside ignored folders that lie in the project's own folder, or any of a project with a hyphen."""
    more = t.spark.createDataFrame([("my-lib", "/work/x.c"), ("my-lib", "/src/libfuzzer/x.c"), ("mylib", "/work/x.c"), ("MyLib", "/src/MYLIB/a.c")], "project_name string, function_source_file string")
    rows = t.raw("all_functions_db").select("project_name", "function_source_file").unionByName(more)
    own = F.lower("function_source_file").contains(F.concat(F.lit("/src/"), F.lower("project_name"))) | F.col("project_name").contains("-")
    return rows.filter(P.allowed_path(F.col("function_source_file")) & own).distinct()


@query("ff af", base._SIDE_CC + " select project_name, function_name, branch, side_no, unique_not_covered_cc cc from sc where unique_not_covered_cc >= 5")
def f22_worthwhile_sides(t):
    """Branch sides that alone lead to uncovered complexity of 5 or more."""
    return base.a11_side_complexity(t).filter("unique_not_covered_cc >= 5").select("project_name", "function_name", "branch", "side_no", F.col("unique_not_covered_cc").alias("cc"))


@query("ff", "select project_name, function_name name, regexp_extract(function_source_file, '([^/]*)$', 1) file, function_linenumber line_from, function_linenumber_end line_to, arg_count argc, array_to_string(arg_types, ', ') args, len(functions_reached) reached, cyclomatic_complexity cc from ff")
def f23_refined_functions(t):
    """Short projection of function facts."""
    n = F.when(F.col("functions_reached").isNotNull(), F.size("functions_reached"))
    return t.ff.select("project_name", F.col("function_name").alias("name"), basename(F.col("function_source_file")).alias("file"), F.col("function_linenumber").alias("line_from"), F.col("function_linenumber_end").alias("line_to"), F.col("arg_count").alias("argc"), F.array_join("arg_types", ", ").alias("args"), n.alias("reached"), F.col("cyclomatic_complexity").alias("cc"))


@query("fn ed hs hr hc cl cm cf", "select f.name, f.file, f.argc, f.bb, f.cc, coalesce(hc.hc, 0) reached_by, coalesce(cf.n, 0) lines_total, coalesce(cf.hit, 0) lines_hit from fn f left join hc using (k) left join cf using (k)")
def f24_function_table(t):
    """Table of all functions with reach and coverage."""
    rows = t.fn.join(hit_counts(t), "k", "left").join(hit_lines(t), "k", "left")
    return rows.select("name", "file", "argc", "bb", "cc", F.coalesce("hc", F.lit(0)).alias("reached_by"), F.coalesce("n", F.lit(0)).alias("lines_total"), F.coalesce("hit", F.lit(0)).alias("lines_hit"))


@query("fn ed hs hr ct", "select hs.h, (select count(*) from hr where hr.h = hs.h) reached, (select count(*) from fn) - (select count(*) from hr where hr.h = hs.h) unreached, (select max(depth) from ct where ct.h = hs.h) depth, (select count(distinct file) from ct join fn using (k) where ct.h = hs.h) files from hs")
def f25_harness_overview(t):
    """Overview of each harness."""
    reached = harness_reach(t).groupBy("h").agg(F.count(F.lit(1)).alias("reached"))
    files = t.ct.join(t.fn.select("k", "file"), "k").select("h", "file").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("files"))
    total = t.fn.agg(F.count(F.lit(1)).alias("total"))
    return t.hs.select("h").join(reached, "h", "left").join(base.a21_max_depth(t), "h", "left").join(files, "h", "left").crossJoin(total).select("h", F.coalesce("reached", F.lit(0)).alias("reached"), (F.col("total") - F.coalesce("reached", F.lit(0))).alias("unreached"), F.col("max_depth").alias("depth"), F.coalesce("files", F.lit(0)).alias("files"))  # one row


@query("cl", "select distinct h, k from cl where hits > 0")
def f26_runtime_reached(t):
    """Functions each harness runs."""
    return t.cl.groupBy("h", "k").agg(F.max("hits").alias("m")).filter("m > 0").select("h", "k")


@query("ed hs hr cl", "select h, k from hr where not exists (select 1 from cl where cl.h = hr.h and cl.k = hr.k and hits > 0)")
def f27_reached_uncovered(t):
    """Functions that a harness reaches by calls but never runs."""
    return harness_reach(t).join(f26_runtime_reached(t), ["h", "k"], "left_anti")


@query("", "select distinct function_source_file from (select function_source_file from all_functions_db union all values ('/src/a/unittests/b.c'), ('/src/a/b.c')) where contains(function_source_file, 'test')")
def f28_files_by_word(t):
    """Source files of tests, by the word in their path."""
    more = t.spark.createDataFrame([("/src/a/unittests/b.c",), ("/src/a/b.c",)], "function_source_file string")
    return t.raw("all_functions_db").select("function_source_file").unionByName(more).filter(F.col("function_source_file").contains("test")).distinct()


@query("ff", r"select project_name, function_name from ff where not regexp_matches(function_name, '(^|[.:])(get|set|is|has)[A-Z_]') and not regexp_matches(lower(function_name), 'test|tostring|hashcode|equals') and arg_count > 0")
def f29_method_groups(t):
    """Functions that are neither accessors nor tests nor inherited basics, with arguments."""
    n = F.col("function_name")
    return t.ff.filter(~n.rlike(r"(^|[.:])(get|set|is|has)[A-Z_]") & ~F.lower(n).rlike("test|tostring|hashcode|equals") & (F.col("arg_count") > 0)).select("project_name", "function_name")


@query("ff", "select project_name, function_name from ff where function_linenumber <> -1 and arg_count = 1 and not list_contains(arg_names, 'self') and not contains(function_name, 'test')")
def f30_single_argument(t):
    """Functions of one argument other than self, outside tests."""
    return t.ff.filter((F.col("function_linenumber") != -1) & (F.col("arg_count") == 1) & ~F.array_contains("arg_names", "self") & ~F.col("function_name").contains("test")).select("project_name", "function_name")


@query("", f"with {_LAST} select project_name, function_name, function_source_file, cyclomatic_complexity from l where line_cov = 0 or line_cov is null qualify row_number() over (partition by project_name order by cyclomatic_complexity desc nulls last, function_name, function_source_file) <= 5")
def f31_zero_coverage_top(t):
    """The five most complex uncovered functions of each project."""
    w = Window.partitionBy("project_name").orderBy(F.desc_nulls_last("cyclomatic_complexity"), "function_name", "function_source_file")
    return last_functions(t).filter("line_cov = 0 or line_cov is null").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("project_name", "function_name", "function_source_file", "cyclomatic_complexity")


@query("fn ed hs hr hc cl cm cf", "select f.name, coalesce(hc.hc, 0) reached_by, coalesce(100.0::double * cf.hit / cf.n, 0) hit_percent from fn f left join hc using (k) left join cf using (k) where f.name in ('fn_0', 'fn_1', 'fn_7', 'fn_99')")
def f34_inspect(t):
    """Reach and coverage of named functions."""
    rows = t.fn.filter(F.col("name").isin("fn_0", "fn_1", "fn_7", "fn_99")).join(hit_counts(t), "k", "left").join(hit_lines(t), "k", "left")
    return rows.select("name", F.coalesce("hc", F.lit(0)).alias("reached_by"), percentage(F.col("hit"), F.col("n")).alias("hit_percent"))


# Branches and blockers --------------------------------------------------------------------------------------------------
@query("ff", base._SIDES + """, o as (select a.project_name, a.function_name, a.branch, a.side_no, a.callees, flatten(list(b.callees)) others from sd a join sd b on b.project_name = a.project_name and b.function_name = a.function_name and b.branch = a.branch and b.side_no <> a.side_no group by all)
select project_name, function_name, branch, side_no::int side_no, len(list_distinct(list_filter(callees, lambda x: not list_contains(others, x))))::int unique_callees from o""")
def h3_unique_callees(t):
    """Callees of a branch side that no other side of the branch names."""
    sides = branch_sides(t)
    key = ["project_name", "function_name", "branch"]
    each = sides.select(*key, "side_no", F.explode("callees").alias("callee")).distinct()
    once = each.groupBy(*key, "callee").agg(F.count(F.lit(1)).alias("n"), F.min("side_no").alias("side_no")).filter("n = 1")
    counts = once.groupBy(*key, "side_no").agg(F.count(F.lit(1)).cast("int").alias("unique_callees"))
    several = sides.select(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("s")).filter("s > 1").drop("s")
    return sides.select(*key, "side_no").join(several, key).join(counts, [*key, "side_no"], "left").fillna(0, ["unique_callees"])


_BLOCKERS = base._SIDE_CC + """, bl as (select project_name, function_name, branch, string_split(string_split(branch, ':')[2], ',')[1]::int bline, count(*) sides from sd group by all),
cv as (select *, ((bline + side_no) % 3) * 10 hits, bline % 5 = 0 switched from (select bl.*, unnest(range(case when bline % 11 = 0 then sides + 1 else sides end)) side_no from bl)),
ag as (select project_name, function_name, branch, sides, count(*) n, count(*) filter (hits = 0) cold, greatest(max(hits), max(case when switched then bline % 7 else -1 end)) diff from cv group by project_name, function_name, branch, sides)
select cv.project_name, cv.function_name, cv.branch, cv.side_no::int side_no, string_split(sc.side, ',')[1]::int side_line, sc.unique_not_covered_cc, sc.unique_reachable_cc, sc.not_covered_cc, sc.reachable_cc, ag.diff::int hit_difference
from cv join ag using (project_name, function_name, branch) join sc on sc.project_name = cv.project_name and sc.function_name = cv.function_name and sc.branch = cv.branch and sc.side_no = cv.side_no
where cv.hits = 0 and ag.cold < ag.n and ag.n = ag.sides and string_split(sc.side, ',')[1]::int >= cv.bline and string_split(sc.side, ',')[1]::int % 4 <> 1"""


#: The same rows as a view ``b``: the last select of the text becomes one more step.
_BLOCKERS_AS_B = _BLOCKERS[: _BLOCKERS.rindex("\nselect ")] + ",\nb as (" + _BLOCKERS[_BLOCKERS.rindex("\nselect ") + 1 :] + ")"


@query("ff af", _BLOCKERS)
def j5_branch_coverage(t):
    """Branch blockers: sides never taken of branches of which another side is taken, with what lies behind them.

    Run-time counts of branches and lines are made of the branch's line (the tables have none): a count a side, two more
    in front for switches. See ``joins.branch_blockers`` for the rules."""
    from ..operators.joins import branch_blockers

    key = ["project_name", "function_name", "branch"]
    sides = base.a11_side_complexity(t).withColumn("side_line", F.split("side", ",")[0].cast("int"))
    line = F.split(F.split("branch", ":")[1], ",")[0].cast("int")
    each = sides.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("line", line)
    size = F.when(F.col("line") % 11 == 0, F.col("n") + 1).otherwise(F.col("n"))
    counts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: (F.col("line") + i) % 3 * 10)
    switch = F.when((F.col("line") % 5 == 0), F.array(F.lit(0), F.col("line") % 7)).otherwise(F.array().cast("array<int>"))
    coverage = each.select(*key, "line", F.concat(switch, counts).alias("hits"), (F.col("line") % 5 == 0).alias("switched"))
    hit = sides.select("project_name", "function_name", "side_line").filter("side_line % 4 = 1").distinct()
    return branch_blockers(coverage, sides, hit, key)


_FOUR = "unique_not_covered_cc desc, unique_reachable_cc desc, not_covered_cc desc, reachable_cc desc, project_name, function_name, branch, side_no"


@query("ff af", _BLOCKERS_AS_B + f" select project_name, function_name, branch, side_no, row_number() over (order by {_FOUR}) place from b")
def t1_blocker_order(t):
    """Blockers by four complexities, greatest first, equal ones in the order of their places; numbers by range partitions and
    offsets."""
    keys = [F.desc(c) for c in ("unique_not_covered_cc", "unique_reachable_cc", "not_covered_cc", "reachable_cc")]
    rows = j5_branch_coverage(t).drop("side_line", "hit_difference")
    return numbered(rows, [*keys, F.asc("project_name"), F.asc("function_name"), F.asc("branch"), F.asc("side_no")]).select("project_name", "function_name", "branch", "side_no", "place")


@query("ff af", _BLOCKERS_AS_B + f" select project_name, function_name, branch, side_no, not_covered_cc from b qualify row_number() over (partition by project_name order by {_FOUR}) <= 6")
def f33_top_blockers(t):
    """The first blockers of each project in that order, five and one more as they are printed."""
    w = Window.partitionBy("project_name").orderBy(*[F.desc(c) for c in ("unique_not_covered_cc", "unique_reachable_cc", "not_covered_cc", "reachable_cc")], "function_name", "branch", "side_no")
    return j5_branch_coverage(t).withColumn("r", F.row_number().over(w)).filter("r <= 6").select("project_name", "function_name", "branch", "side_no", "not_covered_cc")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with their ``place`` in a total order: sorted by ranges, numbered within each, offset by those before."""
    parts = graph.shuffle_parts(rows.sparkSession)
    ranged = graph.cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__i0")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return ranged.join(F.broadcast(starts), "__p").withColumn("place", F.col("__i") - F.col("__i0") + F.col("__before") + 1).drop("__p", "__i", "__i0", "__n", "__before")


# Windows --------------------------------------------------------------------------------------------------------------
@query("db", """, s as (select db_name, snap_date, project_count::double v, row_number() over (partition by db_name order by snap_date) n from db),
st as (select db_name, snap_date, n, v, case when v > 0 then [v] else []::double[] end kept, coalesce(v, 0) <= 0 down, coalesce(v > 0, false) keep from s where n = 1
union all select s.db_name, s.snap_date, s.n, s.v, case when x.keep then list_append(st.kept, s.v) else st.kept end, case when coalesce(s.v, 0) <= 0 then true when len(st.kept) = 0 then st.down else not x.keep end, x.keep
from st join s on s.db_name = st.db_name and s.n = st.n + 1, lateral (select coalesce(s.v > 0 and (len(st.kept) = 0 or s.v >= case when st.down then 0.95 else 0.85 end::double * list_aggregate(st.kept[-15:], 'median')), false) keep) x)
select db_name, snap_date, v project_count from st where keep""")
def w1_outage_filter(t):
    """Days of each database outside outages of its number of projects."""
    return series.without_outages(t.db, "db_name", "snap_date", "project_count")


@query("ps", "select project_name, snap_date from (select project_name, snap_date, coverage_data.line_coverage.percent p, lag(coverage_data.line_coverage.percent) over (partition by project_name order by snap_date) q from ps) where q - p > 5")
def w2_day_over_day(t):
    """Days on which coverage fell by more than 5 points."""
    p = F.col("coverage_data.line_coverage.percent")
    return t.ps.select("project_name", "snap_date", p.alias("p"), F.lag(p).over(Window.partitionBy("project_name").orderBy("snap_date")).alias("q")).filter("q - p > 5").select("project_name", "snap_date")


@query("ps", "select project_name, snap_date, max(coverage_data.line_coverage.percent) over (partition by project_name order by snap_date rows between unbounded preceding and 1 preceding) best_before from ps")
def w3_best_before(t):
    """Best coverage before each day."""
    w = Window.partitionBy("project_name").orderBy("snap_date").rowsBetween(Window.unboundedPreceding, -1)
    return t.ps.select("project_name", "snap_date", F.max("coverage_data.line_coverage.percent").over(w).alias("best_before"))


@query("ff", "select project_name, function_name, coalesce(lead(function_linenumber) over (partition by project_name, function_source_file order by function_linenumber, function_name) - 1, -1)::int line_to from ff where function_linenumber is not null")
def w4_range_ends(t):
    """End of each function's range: the line before the next start, -1 for the last. Functions without a line have none."""
    w = Window.partitionBy("project_name", "function_source_file").orderBy("function_linenumber", "function_name")
    return t.ff.filter("function_linenumber is not null").select("project_name", "function_name", F.coalesce(F.lead("function_linenumber").over(w) - 1, F.lit(-1)).alias("line_to"))


_REDS = """, n as (select ct.h, ct.idx, ct.depth, ct.k, hits, f.cc from ct join fn f using (k)),
g as (select *, sum(case when hits <> 0 or idx = 0 then 1 else 0 end) over (partition by h order by idx) isl from n),
a as (select h, isl, count(*) filter (hits = 0 and idx <> 0) f, arg_max(idx, (cc * 1000000 - idx)) filter (hits = 0 and idx <> 0 and cc > 0) li from g group by 1, 2),
rd as (select g.h, g.idx, g.k, case when hits <> 0 or idx = 0 then a.f else 0 end forward_reds, case when hits <> 0 or idx = 0 then a.li end largest_idx from g join a using (h, isl))"""


def reds(t) -> DataFrame:
    nodes = t.ct.join(t.fn.select("k", "cc"), "k").select("h", "idx", "depth", "k", "hits", "cc")
    return series.forward_reds(nodes, "h", "idx", "hits", "cc")


@query("fn ct", _REDS + " select h, idx, forward_reds, largest_idx from rd")
def w5_forward_reds(t):
    """Length of the run of nodes without hits after each node, and the largest function in it."""
    return reds(t).select("h", "idx", "forward_reds", "largest_idx")


@query("ps", "select project_name, snap_date, fuzzer_count from ps qualify row_number() over (partition by project_name order by snap_date desc) = 1")
def w6_latest(t):
    """Latest day of each project."""
    return t.ps.groupBy("project_name").agg(F.max(F.struct("snap_date", "fuzzer_count")).alias("m")).select("project_name", "m.snap_date", "m.fuzzer_count")


@query("ff", "select project_name, function_name from ff qualify row_number() over (partition by project_name order by function_name) <= 5")
def w7_first_five(t):
    """First five functions of each project by name."""
    return t.ff.select("project_name", "function_name").withColumn("r", F.row_number().over(Window.partitionBy("project_name").orderBy("function_name"))).filter("r <= 5").drop("r")


@query()
def w7_replace_smaller(t):
    """Five of each project, later functions replacing the first smaller entry (order-dependent, tested by hand)."""
    packed = t.ff.groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("function_name", F.coalesce("cyclomatic_complexity", F.lit(0)).alias("cc")))).alias("rows"))

    def top(rows):
        return [(i, r["function_name"], r["cc"]) for i, r in enumerate(series.fold_top(rows, 5, lambda r: r["cc"]))]

    schema = "project_name string, place int, function_name string, cc int"
    return packed.mapInArrow(graph.per_project(top, schema), schema)


@query("ct", """, c as (select h, idx, hits > 0 hit from ct), d as (select *, case when lag(hit) over (partition by h order by idx) is not distinct from hit then 0 else 1 end x from c), e as (select *, sum(x) over (partition by h order by idx) r from d)
select h, hit, min(idx) first_at, max(idx) last_at, count(*) length from e group by h, hit, r""")
def w8_colour_runs(t):
    """Neighbouring nodes of one colour merged to runs."""
    return series.runs_of(t.ct.select("h", "idx", (F.col("hits") > 0).alias("hit")), "h", "idx", "hit")


@query("ff", """, c as (select project_name, function_name, unnest(constants_touched) v, generate_subscripts(constants_touched, 1) p from ff)
select project_name, concat('k', row_number() over (partition by project_name order by function_name, p) - 1, '="', v, '"') entry from c""")
def w9_dictionary(t):
    """Dictionary entries k0, k1, ... over the constants of a project's functions in order."""
    c = t.ff.select("project_name", "function_name", F.posexplode("constants_touched").alias("p", "v"))
    n = F.row_number().over(Window.partitionBy("project_name").orderBy("function_name", "p")) - 1
    return c.select("project_name", F.concat(F.lit("k"), n, F.lit('="'), "v", F.lit('"')).alias("entry"))


@query("", """with s as (select distinct project_name, snap_date, function_name from all_functions_db), l as (select project_name, max(snap_date) d from s group by 1)
select distinct s.project_name, s.function_name from s join l using (project_name) where s.snap_date < l.d and not exists (select 1 from s x where x.project_name = s.project_name and x.snap_date = l.d and x.function_name = s.function_name)""")
def w10_lost(t):
    """Functions seen before but not in the last snapshot."""
    last = t.raw("all_functions_db").groupBy("project_name").agg(F.max("snap_date").alias("last_date"))
    seen = t.raw("all_functions_db").groupBy("project_name", "function_name").agg(F.max("snap_date").alias("d"))
    return seen.join(last, "project_name").filter("d < last_date").select("project_name", "function_name")


# Order and limits -------------------------------------------------------------------------------------------------------
@query("fn ct", _REDS + " select h, idx, forward_reds from rd where forward_reds > 0 qualify row_number() over (partition by h order by forward_reds desc, idx) <= 12")
def t2_top_blockers(t):
    """Twelve nodes of each tree before the longest runs without hits."""
    w = Window.partitionBy("h").orderBy(F.desc("forward_reds"), "idx")
    return reds(t).filter("forward_reds > 0").withColumn("r", F.row_number().over(w)).filter("r <= 12").select("h", "idx", "forward_reds")


@query("ff af", base._SIDE_CC + """, lf as (select project_name, function_name, max(coalesce(line_cov, 0)) cov, max(coalesce(fuzzers_reaching, 0)) reaching from af where (project_name, snap_date) in (select project_name, max(snap_date) from all_functions_db group by 1) group by 1, 2)
select ff.project_name, ff.function_name, row_number() over (partition by ff.project_name order by coalesce(reaching, 0) > 0, coalesce(cov, 0), coalesce(function_depth, 0) desc, coalesce(cyclomatic_complexity, 0) desc, case when coalesce(reaching, 0) > 0 then 0 else total end,
coalesce(arg_count, 0) desc, coalesce(function_linenumber_end - function_linenumber, 0) desc, coalesce(reaching, 0), ff.function_name) place from ff join tc using (project_name, function_name) left join lf on lf.project_name = ff.project_name and lf.function_name = ff.function_name""")
def t3_public_order(t):
    """Functions of each project in the order of the candidates' keys: not reached first, coverage, depth, complexity,
    undiscovered complexity (all of it behind what nothing reaches), arguments, lines, reaching harnesses; null counts as 0."""
    rows = t.raw("all_functions_db")
    last = rows.groupBy("project_name").agg(F.max("snap_date").alias("snap_date"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    seen = t.af.join(last, ["project_name", "snap_date"], "left_semi").groupBy("project_name", "function_name").agg(F.max(zero("line_cov")).alias("cov"), F.max(zero("fuzzers_reaching")).alias("reaching"))
    key = ["project_name", "function_name"]
    both = t.ff.join(base.totals(t), key).join(seen, key, "left").fillna(0, ["cov", "reaching"])
    reached = F.col("reaching") > 0
    w = Window.partitionBy("project_name").orderBy(reached, "cov", F.desc(zero("function_depth")), F.desc(zero("cyclomatic_complexity")), F.when(reached, 0).otherwise(F.col("total")), F.desc(zero("arg_count")), F.desc(zero(F.col("function_linenumber_end") - F.col("function_linenumber"))), "reaching", "function_name")
    return both.withColumn("place", F.row_number().over(w).cast("long")).select("project_name", "function_name", "place")


@query("fn ed re cl cm cf", """, i as (select f.k, f.cc from fn f left join cf using (k) where coalesce(100.0::double * hit / n, 0) <= 20 order by f.cc desc, f.k limit 10)
select i.k, (i.cc + coalesce(sum(g.cc), 0))::bigint total_cc from i left join re on re.src = i.k left join fn s on s.k = i.k left join fn g on g.k = re.dst and not (g.file = s.file and g.b = s.b and g.e = s.e) group by i.k, i.cc""")
def t4_far_reach(t):
    """The ten most complex hardly covered functions, with the complexity they reach: only these ten are walked from."""
    place = lambda p: F.struct("file", "b", "e").alias(p)
    interest = graph.stored(base.a7_hit_summary(t).filter("hit_percent <= 20").join(t.fn.select("k", "cc", place("p")), "k").orderBy(F.desc("cc"), "k").limit(10).select("k", "cc", "p"))
    reached = graph.reach_from(t.ed, interest.select(F.col("k").alias("start"))).filter("start <> node")
    below = reached.join(t.fn.select(F.col("k").alias("node"), place("q"), F.col("cc").alias("ccc")), "node").join(F.broadcast(interest.select(F.col("k").alias("start"), "p")), "start").filter("p <> q")  # ten rows
    sums = below.groupBy(F.col("start").alias("k")).agg(F.sum("ccc").alias("s"))
    return interest.join(sums, "k", "left").select("k", (F.col("cc") + F.coalesce("s", F.lit(0))).alias("total_cc"))


@query()
def t5_greedy_targets(t):
    """Targets picked one after the other by what they newly reach (tested against brute force)."""
    rows = t.fn.join(hit_counts(t), "k", "left").select("k", "cc", "argc", "bb", F.col("hc").isNotNull().alias("hit"))
    n = t.fn.count()
    return series.greedy_targets(rows, t.ed, 1 if n > 10000 else 3 if n > 5000 else 7 if n > 2000 else 10)


@query("ff", "select cap, project_name, function_name from (values (10), (30), (100), (150), (180), (400), (4000)) c(cap) join (select project_name, function_name, row_number() over (order by cyclomatic_complexity desc nulls last, project_name, function_name) place from ff) on place <= cap")
def t8_capped(t):
    """The most complex functions under each of the seven limits of results; limits are small, so no more than the greatest of
    them is ever ordered."""
    top = t.ff.select("project_name", "function_name", "cyclomatic_complexity").orderBy(F.desc_nulls_last("cyclomatic_complexity"), "project_name", "function_name").limit(4000)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("cyclomatic_complexity"), "project_name", "function_name")))  # 4000 rows
    caps = F.filter(F.array(*[F.lit(c) for c in (10, 30, 100, 150, 180, 400, 4000)]), lambda c: c >= F.col("place"))
    return placed.select(F.explode(caps).alias("cap"), "project_name", "function_name")


@query("ff", "select project_name, function_name, function_depth from ff order by function_depth desc nulls last, project_name, function_name limit 50")
def t9_deepest(t):
    """Fifty functions of greatest stated depth."""
    return t.ff.select("project_name", "function_name", "function_depth").orderBy(F.desc_nulls_last("function_depth"), "project_name", "function_name").limit(50)


# Sets -------------------------------------------------------------------------------------------------------------------
@query("ed hs hr", "select distinct k from hr")
def h1_reached(t):
    """Functions that any harness reaches."""
    return harness_reach(t).select("k").distinct()


@query("fn ed hs hr", "select k from fn where k not in (select k from hr)")
def h2_unreached(t):
    """Functions that no harness reaches."""
    return t.fn.select("k").join(harness_reach(t).select("k"), "k", "left_anti")


@query("cl", "select k, min(h) h from cl group by 1")
def h4_first_wins(t):
    """Each function from the first harness that has it."""
    return t.cl.groupBy("k").agg(F.min("h").alias("h"))


@query("cl", "select k, case when max(case when h = 1 then 1 end) is null then 'second' else 'first' end side from cl where h in (1, 2) and hits > 0 group by k having count(distinct h) = 1")
def h5_only_one(t):
    """Functions run in one of two reports only."""
    side = lambda h: t.cl.filter(f"h = {h} and hits > 0").select("k").distinct()
    a, b = side(1), side(2)
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("first")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("second")))


@query("ff", "select project_name, function_source_file f from ff union select project_name, function_source_file from all_functions_db")
def h6_combined_files(t):
    """Files named in either table."""
    side = lambda d: d.select("project_name", F.col("function_source_file").alias("f"))
    return side(t.ff).unionByName(side(t.raw("all_functions_db"))).distinct()


@query("ff", "select project_name, function_name, list_has_any(arg_types, ['char *', 'uint8_t *']) takes_bytes from ff")
def h7_overlap(t):
    """Functions whose argument types meet a set."""
    return t.ff.select("project_name", "function_name", F.arrays_overlap("arg_types", F.array(F.lit("char *"), F.lit("uint8_t *"))).alias("takes_bytes"))


@query("cs ff", "select project_name, site_dst function_name, 'called only' side from (select project_name, site_dst from cs where site_dst is not null except select project_name, function_name from ff) union all select project_name, function_name, 'defined only' from (select project_name, function_name from ff except select project_name, site_dst from cs)")
def h8_differences(t):
    """Functions that are called but not defined, and the other way round."""
    called = t.cs.filter("site_dst is not null").select("project_name", F.col("site_dst").alias("function_name"))
    known = t.ff.select("project_name", "function_name")
    return called.subtract(known).withColumn("side", F.lit("called only")).unionByName(known.subtract(called).withColumn("side", F.lit("defined only")))


@query("ff", "select project_name, function_name, 'new' origin from ff union all select distinct project_name, function_name, 'old' from all_functions_db a where not exists (select 1 from ff where ff.project_name = a.project_name and ff.function_name = a.function_name)")
def h9_upsert(t):
    """Function facts over what the snapshots hold: new rows replace old ones of the same name."""
    new = t.ff.select("project_name", "function_name", F.lit("new").alias("origin"))
    old = t.raw("all_functions_db").select("project_name", "function_name", F.lit("old").alias("origin")).distinct()
    return series.upsert(old, new, ["project_name", "function_name"])


@query("ps db", "select project_name, snap_date, 'stored' origin from ps where snap_date < '2025-03-01' union all select project_name, snap_date, 'appended' from ps where snap_date >= '2025-03-01'")
def k7_append(t):
    """Daily rows appended to what is stored; days already there stay as they are."""
    old = t.ps.filter("snap_date < '2025-03-01'").select("project_name", "snap_date", F.lit("stored").alias("origin"))
    new = t.ps.filter("snap_date >= '2025-02-01'").select("project_name", "snap_date", F.lit("appended").alias("origin"))
    return series.append_new(old, new, ["project_name", "snap_date"])


@query("ff", "select project_name, regexp_replace(function_source_file, '/[^/]*$', '') folder, count(*) functions from ff where contains(function_source_file, '/') group by 1, 2")
def j19_folders(t):
    """Functions of each source folder."""
    return t.ff.filter(F.col("function_source_file").contains("/")).groupBy("project_name", dirname(F.col("function_source_file")).alias("folder")).agg(F.count(F.lit(1)).alias("functions"))


@query("ps", """, s as (select project_name, snap_date, coverage_data.line_coverage.percent p from ps where coverage_data.line_coverage.percent is not null)
select project_name, min(p) low, max(p) high, arg_max(snap_date, (p * 100000000)::bigint - (replace(snap_date, '-', ''))::bigint % 1000000) best_date from s group by 1""")
def a23_run_extremes(t):
    """Least and greatest coverage of each series and the first day of the greatest."""
    s = t.ps.select("project_name", "snap_date", F.col("coverage_data.line_coverage.percent").alias("p")).filter("p is not null")
    m = s.groupBy("project_name").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    first = s.join(m, "project_name").filter("p = high").groupBy("project_name").agg(F.min("snap_date").alias("best_date"))
    return m.join(first, "project_name")


@query("ff cs", """, x as (select distinct project_name, regexp_extract(file, '([^/]*)$', 1) base, src_func, site_dst from cs where site_dst is not null and file is not null)
select x.project_name, x.base, count(distinct x.site_dst) functions, min(x.site_dst) first_function from x join ff f on f.project_name = x.project_name and f.function_name = x.site_dst group by 1, 2""")
def j23_file_to_functions(t):
    """Defined functions that each file calls."""
    known = t.ff.select("project_name", F.col("function_name").alias("site_dst"))
    calls = t.cs.filter("site_dst is not null").join(known, ["project_name", "site_dst"], "left_semi")
    pairs = calls.select("project_name", basename(F.coalesce("file", F.lit(""))).alias("base"), F.when(F.col("file").isNotNull(), F.lit(1)).alias("has"), "site_dst").filter("has = 1").drop("has").distinct()
    return pairs.groupBy("project_name", "base").agg(F.count(F.lit(1)).alias("functions"), F.min("site_dst").alias("first_function"))


@query("cs ff", """, c as (select cs.project_name, cs.site_id, cs.line, f.function_name, f.function_linenumber b from cs join ff f on f.project_name = cs.project_name and f.function_source_file = cs.file and f.function_linenumber <= cs.line)
select project_name, site_id, function_name from c qualify row_number() over (partition by site_id order by b desc, function_name desc) = 1""")
def j26_enclosing_function(t):
    """Function with the nearest start line at or before each call site of its file."""
    from ..operators.joins import asof_backward

    key = lambda c: F.concat_ws("\t", "project_name", c).alias("by")
    left = t.cs.filter("line is not null").select("project_name", "site_id", key("file"), "line")
    right = t.ff.select(key("function_source_file"), F.col("function_linenumber").cast("long").alias("b"), "function_name")
    return asof_backward(left, right, "by", "line", "b", ["function_name"]).filter("function_name is not null").select("project_name", "site_id", "function_name")
