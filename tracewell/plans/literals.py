"""Readers, writers and text expressions over small literal inputs, each with the rows that have to come out as SQL, and
queries whose rule needs values that the tables do not hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import texts as X
from ..operators import graph
from ..operators.joins import latest_by, resolve_by_priority, suffix_join
from ..runtime import shared_dir
from ..sources import debug, reports, sinks
from . import reference as base
from . import selection
from .reference import query


def files(t, *texts: tuple[str, str]) -> DataFrame:
    return t.spark.createDataFrame(list(texts), "path string, value string")


def folder(t) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_dir(t.spark)}/literal-{uuid.uuid4().hex}"


# Readers ----------------------------------------------------------------------------------------------------------------
_FACTS = """Fuzzer filename: /src/h.cc
All functions:
  Function list name: All functions
  Elements:
  - functionName: parse_one
    functionSourceFile: /src/p.c
    linkageType: externalLinkage
    functionLinenumber: 10
    returnType: int
    argCount: 1
    argTypes: ['char *']
    functionsReached: [next_one, last_one]
    Callsites:
    - {Src: '/src/p.c:12,5', Dst: next_one}
    - {Src: 'nowhere', Dst: last_one}
  - functionName: next_one
    functionSourceFile: /src/p.c
    functionLinenumber: 30
    functionLinenumberEnd: 44
    CyclomaticComplexity: 7
"""


@query("", "from (values ('parse_one', '/src/h.cc', 10, -1, 0, 2), ('next_one', '/src/h.cc', 30, 44, 7, -1)) t(function_name, harness, line_from, line_to, cc, reached)")
def s2_fact_files(t):
    """Function facts of a YAML file; a missing end is -1, a missing complexity 0."""
    rows = reports.function_facts(files(t, ("a.yaml", _FACTS), ("b.yaml", "not: [valid")))
    return rows.select(F.col("functionName").alias("function_name"), "harness", F.col("functionLinenumber").alias("line_from"), F.col("functionLinenumberEnd").alias("line_to"), F.col("CyclomaticComplexity").alias("cc"), F.coalesce(F.size("functionsReached"), F.lit(-1)).alias("reached"))


@query("", "from (values ('parse_one', 'next_one', '/src/p.c', 12)) t(src_func, dst_func, src_file, line)")
def s2_callsite_map(t):
    """Call sites of facts; what is no file, line and column is left out."""
    return reports.callsite_map(reports.function_facts(files(t, ("a.yaml", _FACTS))))


@query("", "from (values ('/o/fuzzerLogFile-a.data', '/o/fuzzerLogFile-a.data.yaml'), ('/o/j/targetCalltree.txt', '/o/j/report.yaml')) t(tree, facts)")
def s3_profile_pairs(t):
    """Call-tree files with the fact files beside them."""
    names = ("/o/fuzzerLogFile-a.data", "/o/fuzzerLogFile-a.data.yaml", "/o/fuzzerLogFile-b.data", "/o/j/targetCalltree.txt", "/o/j/report.yaml", "/o/readme.txt")
    return reports.pair_profiles(files(t, *((n, "") for n in names)))


_REPORT = """one.c:first:
   10|  4.68k|int first(int x) {
   11|  4.68k|  if (x)
  ------------------
  |  Branch (11:7): [True: 0, False: 4.68k]
  ------------------
   12|      0|    return 1;
   13|       |  // nothing
   14|  36.0M|  switch (x) {
  ------------------
  |  Branch (14:11): [True: 12, False: 0]
  ------------------
   15|      2|    case 1: break;
  ------------------
  |  Branch (15:5): [True: 2, False: 9.3M]
  ------------------
   16|      3|    default: break;
  ------------------
  |  Branch (16:5): [True: 3, False: 2G]
  ------------------
second:
    1|      7|void second() {}
"""


@query("", "select * replace (hits::bigint as hits) from (values ('first', 0, 10, 4680), ('first', 1, 11, 4680), ('first', 2, 12, 0), ('first', 3, 14, 36000000), ('first', 4, 15, 2), ('first', 5, 16, 3), ('second', 0, 1, 7)) t(func, pos, line, hits)")
def s4_coverage_lines(t):
    """Lines with a count of a text coverage report."""
    return reports.coverage_report(files(t, ("/c/a.covreport", _REPORT)))[0].select("func", "pos", "line", "hits")


@query("", "from (values ('first', 11, 7, '0,4680'), ('first', 14, 11, '12,0,2,3')) t(func, line, col, hits)")
def s4_coverage_branches(t):
    """Branches of a text coverage report; cases fold into their switch."""
    rows = reports.coverage_report(files(t, ("/c/a.covreport", _REPORT)))[1]
    return rows.select("func", "line", "col", F.array_join(F.col("hits").cast("array<string>"), ",").alias("hits"))


@query("", "select * replace (hits::bigint as hits) from (values ('one', 'a', 1), ('one', 'b', 0), ('two', 'a', 1), ('two', 'b', 5)) t(target, func, hits)")
def s4_report_of_target(t):
    """Lines of each target's own report, of all reports for a target without one."""
    found = files(t, ("/c/one.covreport", "a:\n  1|  1|x\nb:\n  2|  0|y\n"), ("/c/three.covreport", "b:\n  2|  5|y\n"))
    rows = reports.reports_of_targets(found, t.spark.createDataFrame([("one",), ("two",)], "target string"))
    return rows.select("target", "func", "hits")


@query("", "from (values ('/src/m.py', 1, true), ('/src/m.py', 2, false)) t(file, line, executed)")
def s5_python_coverage(t):
    """Lines run and not run of JSON coverage, without the folders it was taken in."""
    return reports.python_coverage(files(t, ("/c/all_cov.json", '{"files": {"/pythoncovmergedfiles/medio/src/m.py": {"executed_lines": [1], "missing_lines": [2]}}}'), ("/c/bad.json", "{")))


_GO = "mode: set\npkg/t.go:18.67,20.27 2 1\npkg/t.go:20.28,21.32 2 0\n"


@query("", "select * replace (hits::bigint as hits) from (values ('pkg/t.go', 18, 1), ('pkg/t.go', 19, 1), ('pkg/t.go', 20, 1), ('pkg/t.go', 21, 0)) t(file, line, hits)")
def s6_go_lines(t):
    """Ranges of statements spread over their lines, the greatest count kept."""
    return reports.go_coverage(files(t, ("/c/fuzz.cov", _GO)))


@query("", "select * replace (hits::bigint as hits) from (values ('F', 19, 1), ('F', 20, 1), ('F', 21, 0), ('F', 22, 0), ('G', 1, 0)) t(func, line, hits)")
def s6_go_functions(t):
    """Lines of functions from the coverage files whose path ends with theirs; lines without a count have none."""
    functions = t.spark.createDataFrame([("F", "/t.go", 19, 22), ("G", "t.go", 1, 1), ("H", "other.go", 1, 3), ("N", "t.go", -1, 2)], "func string, file string, b int, e int")
    return reports.go_functions(reports.go_coverage(files(t, ("/c/fuzz.cov", _GO))), functions)


_JACOCO = '<report name="r"><package name="p"><class name="p/K" sourcefilename="K.java"><method name="run" desc="(Ljava/lang/String;[I)V" line="3"><counter type="LINE" missed="1" covered="1"/></method></class><sourcefile name="K.java"><line nr="3" mi="0" ci="4"/><line nr="5" mi="2" ci="0"/><line nr="9" mi="0" ci="1"/></sourcefile></package></report>'


@query("", "select * replace (hits::bigint as hits) from (values ('[p.K].run(String[],int)', 3, 4), ('[p.K].run(String[],int)', 5, 0)) t(func, line, hits)")
def s7_jacoco(t):
    """Methods of a JaCoCo file with the counts of their lines; array marks stand on the argument before, as in older keys."""
    at = folder(t)
    t.spark.createDataFrame([(_JACOCO,)], "value string").coalesce(1).write.text(at)
    return reports.jacoco(t.spark, at)


@query("", "from (values ('/p/private/k.c', 4), ('/p/private/k.c', 6)) t(file, line)")
def s8_kernel_coverage(t):
    return reports.kernel_coverage(files(t, ("/k.json", '[{"Filename": "/p/private/k.c", "Covered": [4, 6]}, {"Filename": "/p/u.c", "Covered": [1]}]')))


_DEBUG = """Compile unit: DW_LANG_C99 /src//src/p/a.c
Compile unit: DW_LANG_C99 /src/p/b.c
Global variable: table from /src/p/a.c:7
Global variable: lone from /src/p/b.c
## Types defined in module
Type: Name: DW_TAG_structure_type { point } from /src/p/a.h:3 size
 - Elem { x } from /src/p/a.h:4 -
 - Elem { y } from /src/p/a.h:5 -
Type: Name: DW_TAG_typedef { size_t } from /usr/s.h:9
Type: Name: DW_TAG_structure_type { newer } from /src/p/a.h:3 size
"""


@query("", "from (values ('unit', '/src/p/a.c', 'DW_LANG_C99', ''), ('unit', '/src/p/b.c', 'DW_LANG_C99', ''), ('global', '/src/p/a.c:7', 'table', ''), ('global', '/src/p/b.c:-1', 'lone', ''), ('struct', '/src/p/a.h:3', 'newer', ''), ('typedef', '/usr/s.h:9', 'size_t', '')) t(kind, place, name, elements)")
def s9_debug_texts(t):
    """Compile units, global variables and types of debug texts."""
    f = files(t, ("d1", _DEBUG))
    at = lambda: F.concat_ws(":", "source_file", "source_line").alias("place")
    units = debug.compile_units(f).select(F.lit("unit").alias("kind"), F.col("source_file").alias("place"), F.col("language").alias("name"), F.lit("").alias("elements"))
    variables = debug.global_variables(f).select(F.lit("global").alias("kind"), at(), "name", F.lit("").alias("elements"))
    types = debug.debug_types(f).select("kind", at(), "name", F.array_join("elements", ",").alias("elements"))
    return units.unionByName(variables).unionByName(types)


@query("", "from (values ('struct', 'point', 'x,y'), ('typedef', 'size_t', '')) t(kind, name, elements)")
def s9_struct_elements(t):
    f = files(t, ("d1", "\n".join(_DEBUG.split("\n")[:-2])))
    return debug.debug_types(f).select("kind", "name", F.array_join("elements", ",").alias("elements"))


@query("", "from (values (1, 'a', ''), (3, 'c', '/x:1'), (4, 'bool', ' ')) t(pos, name, file_location)")
def s10_debug_functions(t):
    """Debug functions once a location, the last one held, with the plain name of the boolean type."""
    rows = t.spark.createDataFrame([(1, "a", ""), (2, "b", "/x:1"), (3, "c", "/x:1"), (4, "_Bool", " ")], "pos int, name string, file_location string")
    return debug.debug_functions(rows).select("pos", debug.plain_type_name(F.col("name")).alias("name"), "file_location")


_BUGS = '{"bugs": [{"source_file": "a.c", "source_line": "3", "function_name": "f", "fuzzer_name": "h", "description": "d", "bug_type": "overflow"}, {"source_file": "b.c"}]}'


@query("", "from (values ('a.c', '3', 'f', 'h', 'd', 'overflow')) t(source_file, source_line, function_name, fuzzer_name, description, bug_type)")
def s11_input_bugs(t):
    return reports.input_bugs(files(t, ("bugs.json", _BUGS), ("bad.json", "[")))


@query("", "from (values ('overflow', 'f')) t(bug_type, function_name)")
def u8_bug_digest(t):
    """Type and function of each bug found."""
    return reports.input_bugs(files(t, ("bugs.json", _BUGS))).select("bug_type", "function_name")


@query("", "from (values ('/out/one', 'fuzzerLogFile-0-abc')) t(path, log_file)")
def s12_logs_of_executables(t):
    blobs = [("/out/one", bytearray(b"\x7fELF\x00short\x00fuzzerLog\xffFile-0-abc\x00fuzzerLogFile-1\x00")), ("/out/two", bytearray(b"\x00nothing_of_note\x00"))]
    return debug.logs_of_executables(t.spark.createDataFrame(blobs, "path string, content binary"))


@query("", "from (values ('FUNCS_TO_AVOID', '^my_'), ('FILES_TO_AVOID', '^/usr/')) t(section, pattern)")
def s13_exclusions(t):
    return reports.exclusion_lists(files(t, ("conf", "ignored\nFUNCS_TO_AVOID\n^my_\nFILES_TO_AVOID\n^/usr/\n")))


@query("cs", """, x as (select site_id, src_func, site_dst from cs union all values (-1::bigint, 'malloc', 'a'), (-2, 'keep', '_ZNSt3foo'), (-3, '_Znwm', 'b'), (-4, 'keep', 'other'))
select site_id from x where not regexp_matches(src_func, '^_ZNSt3|^_ZSt|^_ZNKSt|^_ZTv0_n24_NSt|^_ZN18FuzzedDataProvider|^_Zd|^_Zn|^free$|^malloc$|llvm[.]|sanitizer_cov|sancov[.]module')
and (site_dst is null or not regexp_matches(site_dst, '^_ZNSt3|^_ZSt|^_ZNKSt|^_ZTv0_n24_NSt|^_ZN18FuzzedDataProvider|^_Zd|^_Zn|^free$|^malloc$|llvm[.]|sanitizer_cov|sancov[.]module'))""")
def f15_default_exclusions(t):
    """Call sites left by the default exclusion patterns, for callers and callees."""
    more = t.spark.createDataFrame([(-1, "malloc", "a"), (-2, "keep", "_ZNSt3foo"), (-3, "_Znwm", "b"), (-4, "keep", "other")], "site_id long, src_func string, site_dst string")
    rows = t.cs.select("site_id", "src_func", "site_dst").unionByName(more)
    return rows.filter(P.not_excluded(F.col("src_func")) & (F.col("site_dst").isNull() | P.not_excluded(F.col("site_dst")))).select("site_id")


_FEED = '{"projects": [%s]}'


@query("", """from (values ('a', 'true', '11', 'false', 'N/A', 'true', '33'), ('b', 'false', '12', 'N/A', 'N/A', 'N/A', 'N/A'), ('c', 'N/A', 'N/A', 'true', '22', 'N/A', 'N/A')) t(project, fuzz, fuzz_log, coverage, coverage_log, report, report_log)""")
def s16_build_status(t):
    """Three status feeds, newest build of each, as one row a project."""
    one = lambda *ps: t.spark.createDataFrame([(_FEED % ", ".join(ps),)], "value string")
    p = lambda name, *h: '{"name": "%s", "history": [%s]}' % (name, ", ".join('{"build_id": "%s", "success": %s}' % x for x in h))
    return debug.build_status(one(p("a", ("11", "true"), ("10", "false")), p("b", ("12", "false"))), one(p("a"), p("c", ("22", "true"))), one(p("a", ("33", "true"))))


@query("", "from (values ('/p/tests/a.c', true), ('/p/src/b.c', false), ('/p/Examples/c.cc', true), ('/p/src/testing.c', true)) t(path, test_file)")
def s17_sources_and_tests(t):
    """Sources of a language outside excluded folders, with those that are tests or samples."""
    paths = files(t, *((x, "") for x in ("/p/tests/a.c", "/p/src/b.c", "/p/Examples/c.cc", "/p/src/testing.c", "/p/build/d.c", "/p/readme.md"))).select("path")
    return debug.of_language(paths, ["c", "cc"], ["build"]).select("path", debug.is_test_path(F.col("path")).alias("test_file"))


@query("", "from (values ('A', 3, 'run', 'X:Y'), ('A', 3, 'deep', 'X'), ('A', 3, 'deep', 'Y'), ('A', 4, 'run', 'X'), ('A', 5, '<init>', 'X'), ('A', 5, '<init>', 'Y')) t(src, line, callee, classes)")
def s18m_polymorphic_edges(t):
    """Calls of one name at one line to leaves of several classes as one edge; constructors and callees that call on stay."""
    rows = [("A", 3, "run", "X", False), ("A", 3, "run", "Y", False), ("A", 3, "deep", "X", True), ("A", 3, "deep", "Y", True), ("A", 4, "run", "X", False), ("A", 5, "<init>", "X", False), ("A", 5, "<init>", "Y", False)]
    return graph.merge_polymorphic(t.spark.createDataFrame(rows, "src string, line int, callee string, class string, goes_on boolean"))


@query("", "from (values ('drv.c', 3, 'SET_MODE', 'W', 'struct mode'), ('drv.c', 4, 'GET_ALL', 'R', 'int')) t(path, line, name, direction, argument)")
def s19_ioctls(t):
    return reports.ioctls(files(t, ("drv.c", "// #define OLD _IO('a', 1)\n\n#define SET_MODE _IOW('m', 1, struct mode)\n#define GET_ALL \\\n  _IOR('m', 2, \\\n int)\n")))


@query("", "from (values ('a.c', concat('two', chr(10), 'three', chr(10), '}'))) t(path, text)")
def s20_source_slice(t):
    """Lines of a source, up to the closing brace after them."""
    return reports.source_slice(files(t, ("a.c", "one\ntwo\nthree\n}\nfive"), ), 2, 3)


@query("", "from (values ('a.c', true), ('b.c', false), ('c.c', false)) t(path, static_function)")
def f19_static_functions(t):
    """Whether the lines before the first one with a brace name a function static."""
    rows = files(t, ("a.c", "static int\nf(void)\n{\n return 1;\n}"), ("b.c", "int f(void)\n{\n static int x;\n}"), ("c.c", "static int f(void) {\n}"))
    lines = F.split("value", "\n")
    open_at = F.array_position(F.transform(lines, lambda x: x.contains("{")), True).cast("int")
    head = F.when(open_at > 0, F.slice(lines, F.lit(1), open_at - 1)).otherwise(lines)
    return rows.select("path", F.array_join(head, "\n").contains("static").alias("static_function"))


# Writers ----------------------------------------------------------------------------------------------------------------
@query("", """from (values ('h1', '{"calls": 3, "stats": {"x": 1}}'), ('project', '{"stats": {"x": 2}}')) t(section, json)""")
def k1_summary_sections(t):
    """Values by section (harness, project or analysis) and key merged into one object a section, later versions on top."""
    rows = t.spark.createDataFrame([("h1", "stats", '{"x": 1}', 1), ("h1", "calls", "2", 1), ("h1", "calls", "3", 2), ("project", "stats", '{"x": 9}', 1), ("project", "stats", '{"x": 2}', 3)], "section string, key string, value string, version int")
    return sinks.merge_sections(latest_by(rows, ["section", "key"], "version", ["value"]))


@query("ff", "select project_name, count(*) functions from ff group by 1")
def k2_functions_as_json(t):
    """Functions written as JSON, one folder a project, and read back."""
    at = folder(t)
    sinks.write_json_by(t.ff.select("project_name", "function_name", "arg_types"), at, "project_name")
    return t.spark.read.schema("function_name string, arg_types array<string>, project_name string").json(at).groupBy("project_name").agg(F.count(F.lit(1)).alias("functions"))


@query("ff af", base._SIDE_CC + " select project_name, count(*) sides, sum(reachable_cc)::bigint reachable_cc from sc group by 1")
def k3_blockers_as_json(t):
    """Branch sides written as JSON by project and read back."""
    at = folder(t)
    sinks.write_json_by(base.a11_side_complexity(t), at, "project_name")
    rows = t.spark.read.schema("function_name string, reachable_cc long, project_name string").json(at)
    return rows.groupBy("project_name").agg(F.count(F.lit(1)).alias("sides"), F.sum("reachable_cc").alias("reachable_cc"))


@query("", """from (values ('h1', '{"dictionary":["k0","k1"],"focus":["f"]}'), ('h2', '{"focus":["g"]}')) t(harness, json)""")
def k5_engine_input(t):
    """Input for engines: lists by harness and key as one object a harness."""
    rows = t.spark.createDataFrame([("h1", "focus", ["f"]), ("h1", "dictionary", ["k0", "k1"]), ("h2", "focus", ["g"]), ("h2", "dictionary", [])], "harness string, key string, values array<string>")
    return sinks.engine_input(rows)


@query("", "from (values ('a', 1), ('b', 2)) t(name, n)")
def k10_csv(t):
    """Rows written as CSV and read back."""
    at = folder(t)
    sinks.write_csv(t.spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int"), at)
    return t.spark.read.option("header", True).schema("name string, n int").csv(at)


# Names, texts and look-ups ----------------------------------------------------------------------------------------------
@query("", """from (values ('pad', '00042'), ('pad', '1234567'), ('cut', '33.33'), ('spaces', 'a|B|f'), ('spaces', ''), ('spaces', '(anonymous namespace)|g'), ('type', 'const struct point *'), ('type', 'int'),
('signature', 'void put(char *, const int)'), ('signature', 'N/A'), ('imports', 'import Top;|import a.*;|import a.b.*;|import a.b.C;'), ('cause', 'timeout after 1 seconds'), ('cause', 'all is well'),
('url', 'https://x/reports-by-target/d/t1/linux'), ('link', 'https://x/src/a.c.html#L12'), ('share', '33.0'), ('share', '0.0'), ('date', '2025-03-31'), ('map', 'a=1,b=3,c=4')) t(kind, value)""")
def x1_texts(t):
    """Text and number expressions over literals."""
    one = t.spark.range(1)
    d = lambda x: F.lit(x)
    tags = lambda *xs: F.array(*[F.lit(x) for x in xs])
    point = tags("DW_TAG_pointer_type", "DW_TAG_const_type", "DW_TAG_structure_type", "point")
    signature = X.c_signature(tags("void"), d("put"), F.array(tags("DW_TAG_pointer_type", "char"), tags("DW_TAG_const_type", "int")))
    old, new = F.create_map(d("a"), d(1), d("b"), d(2)), F.create_map(d("b"), d(3), d("c"), d(4))
    merged = F.array_join(F.transform(F.array_sort(F.map_entries(X.merged_map(old, new))), lambda e: F.concat(e["key"], d("="), e["value"])), ",")
    cells = [("pad", X.zero_padded(d(42))), ("pad", X.zero_padded(d(1234567))), ("cut", X.cut_number(d("33.3333"))), *(("spaces", F.array_join(X.namespaces(d(x)), "|")) for x in ("a::B::f(int)::g", "plain", "(anonymous namespace)::g(x)")), ("type", X.c_type(point)), ("type", X.c_type(tags("DW_TAG_base_type", "int")))]
    cells += [("signature", signature), ("signature", X.c_signature(F.lit(None).cast("array<string>"), d("f"), F.array(tags("int")))), ("imports", F.array_join(X.imports(tags("a.b.C", "Top")), "|")), ("cause", X.first_cause(d("x\n==14== ERROR: libFuzzer: timeout after 1 seconds\nmore"))), ("cause", X.first_cause(d("all is well")))]
    cells += [("url", X.target_url(d("https://x/reports/d/linux"), d("t1"))), ("link", X.coverage_link(d("https://x"), d("/src/a.c"), d(12))), ("share", X.rounded_share(d(1), d(3)).cast("string")), ("share", X.rounded_share(d(1), d(0)).cast("string")), ("date", X.day_month_year(d("31-03-2025")).cast("string")), ("map", merged)]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in cells])))


@query("", """with x as (select file_id, record_no, payload from raw_function_files qualify row_number() over (partition by file_id, record_no order by ingest_ts desc nulls last, payload desc) = 1),
j as (select file_id, record_no, json_extract(payload, '$.JavaMethodInfo') m from x where json_valid(payload)), b as (select file_id, record_no, json_type(m) = 'OBJECT' as obj,
json_extract(m, '$.public') p, json_extract(m, '$.concrete') c, json_extract(m, '$.static') s, json_extract(m, '$.classEnum') e from j)
select file_id, record_no, case when obj then coalesce(case when json_type(p) = 'BOOLEAN' then p::varchar = 'true' end, true) and coalesce(case when json_type(c) = 'BOOLEAN' then c::varchar = 'true' end, true) else true end accessible,
case when obj then coalesce(case when json_type(s) = 'BOOLEAN' then s::varchar = 'true' end, false) else false end static_method, case when obj then coalesce(case when json_type(e) = 'BOOLEAN' then e::varchar = 'true' end, false) else false end of_enum from b""")
def f7_jvm_properties(t):
    """Properties of JVM methods from their records: accessible unless said otherwise, static and of an enumeration if said
    so; only true and false count. Records that are no valid JSON give no row."""
    from ..operators.drift import valid_json

    last = latest_by(t.raw("raw_function_files"), ["file_id", "record_no"], "ingest_ts", ["payload"])
    rows = last.select("file_id", "record_no", valid_json(F.col("payload")).alias("v")).filter("v is not null")
    flag = lambda name, default: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("v", f"$.JavaMethodInfo.{name}", "variant")) == "BOOLEAN", F.try_variant_get("v", f"$.JavaMethodInfo.{name}", "boolean")), F.lit(default))
    return rows.select("file_id", "record_no", (flag("public", True) & flag("concrete", True)).alias("accessible"), flag("static", False).alias("static_method"), flag("classEnum", False).alias("of_enum"))


_NAMES = "('fixture', 'exact'), ('fixture', 'with blank'), ('fixture', E'tab\\tname'), ('fixture', 'pkg.Map<K, V>.put'), ('fixture', 'crate_a::mod_b::rust_fn'), ('fixture', 'nowhere')"
_COVER = "('fixture', 'exact'), ('fixture', 'withblank'), ('fixture', 'tabname'), ('fixture', 'pkg.Map.put'), ('fixture', 'other::mod_b::rust_fn')"


@query("ff", f""", a as (select project_name, function_name from ff union all values {_NAMES}), k as (select distinct project_name, function_name from all_functions_db union all values {_COVER}),
s as (select a.*, unnest(range(1, 1 + len(string_split(function_name, '::')))) i from a), e as (select project_name, function_name, array_to_string(string_split(function_name, '::')[i:], '::') tail, i from s),
r as (select e.project_name, e.function_name, min(struct_pack(i, key := k.function_name)) m from e join k on k.project_name = e.project_name and ends_with(k.function_name, e.tail) and contains(k.function_name, '::') where e.tail <> '' group by 1, 2)
select a.project_name, a.function_name, coalesce(k1.function_name, k2.function_name, k3.function_name, k4.function_name, r.m.key) resolved from a
left join k k1 on k1.project_name = a.project_name and k1.function_name = a.function_name
left join k k2 on k2.project_name = a.project_name and k2.function_name = replace(a.function_name, ' ', '')
left join k k3 on k3.project_name = a.project_name and k3.function_name = regexp_replace(a.function_name, '[ \\t\\r\\n]', '', 'g')
left join k k4 on k4.project_name = a.project_name and k4.function_name = regexp_replace(a.function_name, '<[\\s.,a-zA-Z0-9]+>', '', 'g')
left join r on r.project_name = a.project_name and r.function_name = a.function_name""")
def j3_function_keys(t):
    """Coverage key of each function: its name, the name without blanks, without any white space, without generics, and else
    the first key by name with a namespace that ends with the name or with what is left of it after its first namespaces."""
    more = lambda rows: t.spark.createDataFrame(rows, "project_name string, function_name string")
    asked = t.ff.select("project_name", "function_name").unionByName(more([("fixture", n) for n in ("exact", "with blank", "tab\tname", "pkg.Map<K, V>.put", "crate_a::mod_b::rust_fn", "nowhere")]))
    known = t.raw("all_functions_db").select("project_name", "function_name").distinct().unionByName(more([("fixture", n) for n in ("exact", "withblank", "tabname", "pkg.Map.put", "other::mod_b::rust_fn")]))
    key = F.concat_ws("\x01", "project_name", "function_name").alias("key")
    forms = [lambda c: c, lambda c: F.replace(c, F.lit(" "), F.lit("")), P.without_blanks, P.without_generics]
    got = resolve_by_priority(asked.select("*", key), "key", known.select(F.concat_ws("\x01", "project_name", "function_name").alias("k")), "k", forms)
    direct = got.filter("resolved is not null").select("project_name", "function_name", F.element_at(F.split("resolved", "\x01"), 2).alias("resolved"))
    # Only what is left goes through the endings, and only keys with a namespace can be met.
    left = got.filter("resolved is null").select("project_name", "function_name")
    parts = F.split("function_name", "::")
    tails = left.select("project_name", "function_name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).alias("i", "tail")).filter("tail <> ''")
    long = known.filter(F.col("function_name").contains("::")).select(F.col("function_name").alias("long_key"), F.col("project_name").alias("key_project"))
    met = suffix_join(long, "long_key", tails, "tail").filter("key_project = project_name")
    best = met.groupBy("project_name", "function_name").agg(F.min(F.struct("i", "long_key")).alias("m")).select("project_name", "function_name", F.col("m.long_key").alias("resolved"))
    return direct.unionByName(left.join(best, ["project_name", "function_name"], "left"))


@query("", "from (values ('pkg.mod.fn', '/x/pkg/mod.py'), ('......pkg.sub.fn', '/x/pkg/sub/__init__.py'), ('alone.fn', null)) t(name, file)")
def j11_module_files(t):
    """Coverage file of a Python function: the first by name that ends with one of the paths its name stands for, else the
    longest package file."""
    names = t.spark.createDataFrame([("pkg.mod.fn",), ("......pkg.sub.fn",), ("alone.fn",)], "name string")
    known = t.spark.createDataFrame([("/x/pkg/mod.py",), ("/x/pkg/__init__.py",), ("/x/pkg/sub/__init__.py",)], "file string")
    parts = F.split(F.replace("name", F.lit("......"), F.lit("")), r"\.")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("p")))
    asked = names.select("name", F.explode(F.flatten(F.transform(paths, lambda x: F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("place"), F.concat(x["p"], F.lit(".py")).alias("path")), F.struct(F.lit(1).alias("rank"), (-x["i"]).alias("place"), F.concat(x["p"], F.lit("/__init__.py")).alias("path")))))).alias("c")).select("name", "c.*")
    met = suffix_join(known, "file", asked, "path").groupBy("name").agg(F.min(F.struct("rank", "place", "file")).alias("m"))
    return names.join(met, "name", "left").select("name", F.col("m.file").alias("file"))


@query("", """with d as (select doc_id, text from documents where text is not null), n as (select distinct function_name f from function_facts)
select doc_id, f function_name from d join n on contains(text, concat(f, '('))""")
def j20_texts_that_call(t):
    """Texts that hold a function's name with an opening bracket behind it: what stands before each bracket, in all its
    endings, is joined with the names by equality."""
    names = t.raw("function_facts").select("function_name").distinct()
    words = t.raw("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([^\s(]+)\("), F.lit(1))).alias("word")).distinct()
    return suffix_join(words, "word", names, "function_name").select("doc_id", "function_name").distinct()


@query("cs", """, g as (select distinct project_name, src_func, site_dst from cs where site_dst is not null and src_func is not null),
e as (select distinct project_name, src_func f from g where (project_name, src_func) not in (select (project_name, site_dst) from g)),
r(project_name, f) as (select * from e union select g.project_name, g.site_dst from r join g on g.project_name = r.project_name and g.src_func = r.f)
select cs.project_name, cs.site_dst function_name, cs.site_src, count(*) sites, bool_or(r.f is not null) reachable from cs left join r on r.project_name = cs.project_name and r.f = cs.src_func
where cs.site_dst is not null and cs.site_src is not null and not exists (select 1 from function_facts ff where ff.project_name = cs.project_name and ff.function_name = cs.site_dst) group by 1, 2, 3""")
def j13_third_party_sites(t):
    """Places at which functions are called that the project does not define, and whether the call trees of the project's
    entries come by: a place seen in a tree and in the facts is reachable."""
    calls = t.cs.filter("site_dst is not null and src_func is not null").select("project_name", "src_func", "site_dst").distinct()
    node = lambda c: F.struct("project_name", F.col(c).alias("f"))
    edges = calls.select(node("src_func").alias("src"), node("site_dst").alias("dst"))
    entries = edges.select(F.col("src").alias("n")).distinct().join(edges.select(F.col("dst").alias("n")).distinct(), "n", "left_anti")
    seen = graph.reached(edges, entries.select(F.col("n").alias("node"))).select("node.project_name", F.col("node.f").alias("src_func"), F.lit(True).alias("seen"))
    known = t.raw("function_facts").select("project_name", F.col("function_name").alias("site_dst")).distinct()
    sites = t.cs.filter("site_dst is not null and site_src is not null").join(known, ["project_name", "site_dst"], "left_anti").join(seen, ["project_name", "src_func"], "left")
    return sites.groupBy("project_name", F.col("site_dst").alias("function_name"), "site_src").agg(F.count(F.lit(1)).alias("sites"), F.bool_or(F.coalesce("seen", F.lit(False))).alias("reachable"))


#: Sinks of command injection by language, as (package, function); fixed values. Other catalogues are tables of the same form.
COMMAND_SINKS = {
    "c-cpp": [("", "system"), ("", "execl"), ("", "execlp"), ("", "execle"), ("", "execv"), ("", "execvp"), ("", "execve"), ("", "wordexp"), ("", "popen")],
    "python": [("<builtin>", "exec"), ("<builtin>", "eval"), ("os", "system"), ("os", "popen"), ("subprocess", "run"), ("subprocess", "Popen")],
    "jvm": [("java.lang.Runtime", "exec"), ("java.lang.System", "load")],
}


@query("", "from (values ('c-cpp', 'sys tem', ''), ('python', '<builtin>.eval', 'x.py'), ('python', 'system', 'os'), ('jvm', '[java.lang.Runtime].exec(String)', '')) t(lang, function_name, source_file)")
def f14_sinks_by_package(t):
    """Functions that are sinks, by package and name as each language writes them."""
    sinks_ = t.spark.createDataFrame([("CWE78", lang, p, f) for lang, found in COMMAND_SINKS.items() for p, f in found], "cwe string, lang string, package string, name string")
    rows = [("c-cpp", "sys tem", ""), ("c-cpp", "systems", ""), ("python", "<builtin>.eval", "x.py"), ("python", "system", "os"), ("python", "system", "mine"), ("jvm", "[java.lang.Runtime].exec(String)", ""), ("jvm", "exec", ""), ("go", "system", "")]
    known = t.spark.createDataFrame(rows, "lang string, function_name string, source_file string")
    return P.with_package_and_name(known).join(F.broadcast(sinks_), ["lang", "package", "name"], "left_semi").select("lang", "function_name", "source_file")  # a fixed catalogue


# Target oracles ---------------------------------------------------------------------------------------------------------
_ORACLE = base._SIDE_CC + f""", lv as (select project_name, function_name, max(coalesce(line_cov, 0)) cov from af where (project_name, snap_date) in (select project_name, max(snap_date) from all_functions_db group by 1) group by 1, 2),
pl as (select project_name from (select * from project_snapshots qualify row_number() over (partition by project_name order by snap_date desc, load_ts desc) = 1) where lower(proj_lang) in ('c', 'c++')),
o as (select ff.project_name, ff.function_name, ff.arg_types, ff.arg_names, tc.total, coalesce(lv.cov, 0) cov, pl.project_name is not null c_like from ff join tc using (project_name, function_name)
left join lv on lv.project_name = ff.project_name and lv.function_name = ff.function_name left join pl on pl.project_name = ff.project_name)"""


def oracle_rows(t) -> DataFrame:
    """Functions with accumulated complexity, coverage in the last snapshot and whether the project is C or C++."""
    rows = t.raw("all_functions_db")
    last = rows.groupBy("project_name").agg(F.max("snap_date").alias("snap_date"))
    cov = t.af.join(last, ["project_name", "snap_date"], "left_semi").groupBy("project_name", "function_name").agg(F.max(F.coalesce("line_cov", F.lit(0.0))).alias("cov"))
    lang = t.ps.groupBy("project_name").agg(F.max_by("proj_lang", "snap_date").alias("lang")).select("project_name", F.lower("lang").isin("c", "c++").alias("c_like"))
    key = ["project_name", "function_name"]
    return t.ff.select(*key, "arg_types", "arg_names").join(base.totals(t), key).join(cov, key, "left").join(lang, "project_name", "left").select(*key, "arg_types", "arg_names", "total", F.coalesce("cov", F.lit(0.0)).alias("cov"), F.coalesce("c_like", F.lit(False)).alias("c_like"))


@query("ff af", _ORACLE + f" select project_name, function_name, total from o where regexp_matches(lower(function_name), '{selection._KEYS}') and cov < 60 and total > 30 and c_like qualify row_number() over (partition by project_name order by function_name) <= 5 order by project_name, function_name limit 4000")
def f17_oracle_keywords(t):
    """Functions with a keyword in their name, little covered and with complexity behind them: five a project, 4000 in all."""
    from pyspark.sql import Window

    rows = oracle_rows(t).filter(P.keyword_name(F.col("function_name"))).filter("cov < 60 and total > 30 and c_like")
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("project_name").orderBy("function_name"))).filter("r <= 5")
    return few.select("project_name", "function_name", "total").orderBy("project_name", "function_name").limit(4000)


@query("ff af", _ORACLE + " select project_name, function_name, total from o where total >= 150 and ((len(arg_types) = 1 and (contains(arg_types[1], 'char *') or contains(arg_types[1], 'string'))) or (len(arg_types) = 2 and contains(arg_types[1], 'char *') and contains(arg_types[2], 'int'))) order by project_name, function_name limit 4000")
def f17_oracle_easy_arguments(t):
    """Functions that take a text, or a text and a number, with complexity of 150 or more behind them; 4000 in all."""
    rows = oracle_rows(t).filter(P.easy_parameters(F.col("arg_types")) & (F.col("total") >= 150))
    return rows.select("project_name", "function_name", "total").orderBy("project_name", "function_name").limit(4000)


@query()
def f17_oracle_far_reach(t):
    """Hardly covered functions with two or three arguments and complexity of more than 200 behind them: five a project, later
    ones replacing the first smaller (order-dependent, tested by hand). One argument never passes the rule for its type."""
    from ..operators.series import fold_top

    rows = oracle_rows(t).filter("cov < 20 and total > 200 and size(arg_names) between 2 and 3 and c_like")
    packed = rows.groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("function_name", "total"))).alias("rows"))  # the few candidates of a project

    def top(found):
        return [(i, r["function_name"], r["total"]) for i, r in enumerate(fold_top(found, 5, lambda r: r["total"]))]

    schema = "project_name string, place int, function_name string, total long"
    return packed.mapInArrow(graph.per_project(top, schema), schema)


@query("ff af", """, l as (select project_name, function_name, max(line_cov) cov, max(fuzzers_reaching) reaching from af where (project_name, snap_date) in (select project_name, max(snap_date) from all_functions_db group by 1) group by 1, 2)
select f.project_name, f.function_name, f.function_source_file, f.return_type, array_to_string(f.arg_types, ', ') args, f.arg_count, f.i_count, coalesce(l.cov, 0) cov, coalesce(l.reaching, 0) > 0 is_reached from ff f left join l using (project_name, function_name)""")
def f35_report_functions(t):
    """Functions of a report as the scanner lists them."""
    rows = t.raw("all_functions_db")
    last = rows.groupBy("project_name").agg(F.max("snap_date").alias("snap_date"))
    seen = t.af.join(last, ["project_name", "snap_date"], "left_semi").groupBy("project_name", "function_name").agg(F.max("line_cov").alias("cov"), F.max("fuzzers_reaching").alias("reaching"))
    both = t.ff.join(seen, ["project_name", "function_name"], "left")
    return both.select("project_name", "function_name", "function_source_file", "return_type", F.array_join("arg_types", ", ").alias("args"), "arg_count", "i_count", F.coalesce("cov", F.lit(0.0)).alias("cov"), (F.coalesce("reaching", F.lit(0)) > 0).alias("is_reached"))


@query("ff cs", """, k as (select project_name, function_name, function_source_file f, function_linenumber n from ff), x as (select distinct project_name, site_dst d from cs where site_dst is not null)
select x.project_name, x.d function_name, coalesce('https://cov.example' || a.f || '.html#L' || a.n, 'https://cov.example' || b.f || '.html#L' || b.n, '#') link from x
left join k a on a.project_name = x.project_name and a.function_name = x.d left join k b on b.project_name = x.project_name and b.function_name = regexp_replace(x.d, '[ \\t\\r\\n]', '', 'g')""")
def j24_coverage_links(t):
    """Coverage address of each called function by its name, else by the name without blanks; ``#`` for unknown ones."""
    asked = t.cs.filter("site_dst is not null").select("project_name", F.col("site_dst").alias("function_name")).distinct()
    known = t.ff.select("project_name", F.col("function_name").alias("name"), X.coverage_link(F.lit("https://cov.example"), F.col("function_source_file"), F.col("function_linenumber")).alias("link"))
    forms = asked.select("*", F.posexplode(F.array(F.col("function_name"), P.without_blanks(F.col("function_name")))).alias("rank", "name"))
    best = forms.join(known, ["project_name", "name"]).groupBy("project_name", "function_name").agg(F.min(F.struct("rank", "link")).alias("m"))
    return asked.join(best, ["project_name", "function_name"], "left").select("project_name", "function_name", F.coalesce("m.link", F.lit("#")).alias("link"))


@query("ff", """, s as (select project_name, function_name, arg_types, concat(return_type, ' ', function_name, '(', array_to_string(arg_types, ', '), ')') signature from ff),
q as (select project_name, signature from s qualify row_number() over (partition by project_name order by signature) = 1)
select s.project_name, s.signature, s.function_name, array_to_string(s.arg_types, '|') arg_types from s join q using (project_name, signature)""")
def j25_by_signature(t):
    """Functions looked up by their signature (here the first one of each project), with the types of their arguments."""
    rows = t.ff.select("project_name", "function_name", "arg_types", F.concat("return_type", F.lit(" "), "function_name", F.lit("("), F.array_join("arg_types", ", "), F.lit(")")).alias("signature"))
    asked = rows.groupBy("project_name").agg(F.min("signature").alias("signature"))
    return rows.join(asked, ["project_name", "signature"], "left_semi").select("project_name", "signature", "function_name", F.array_join("arg_types", "|").alias("arg_types"))


@query("", "from (values ('m', 0, 'a'), ('m', 1, 'b'), ('m', 2, 'b'), ('m', 1, 'c')) t(func, depth, name)")
def g14_calltree_by_place(t):
    """Call tree whose nodes are (name, file, line): each is expanded once, other places of the same function are nodes too."""
    rows = t.spark.createDataFrame([("a", "b", "f.c", 3), ("a", "c", "f.c", 4), ("b", "b", "f.c", 9)], "src string, dst string, file string, line int")
    return graph.calltree_by_place(rows, "a").select(F.lit("m").alias("func"), "depth", "name")


@query("", "from (values (1, 'f'), (1, 'g'), (2, 'g')) t(block, callee)")
def g15_block_callees(t):
    """Functions called from a block or from blocks that control flow leads to from it."""
    flow = t.spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src int, dst int")
    calls = t.spark.createDataFrame([(1, "f"), (3, "g"), (4, "h")], "block int, callee string")
    sides = t.spark.createDataFrame([(1,), (2,)], "start int")
    return graph.reach_from(flow, sides).join(calls.withColumnRenamed("block", "node"), "node").select(F.col("start").alias("block"), "callee").distinct()


@query("ff af", """, d as (select project_name, function_name, function_source_file f, src_begin b from af where (project_name, snap_date) in (select project_name, max(snap_date) from all_functions_db group by 1)),
ex as (select project_name, function_name, min(struct_pack(f, b)) x from d group by 1, 2), nr as (select ff.project_name, ff.function_name, max(struct_pack(b := d.b, n := d.function_name)) x from ff join d on d.project_name = ff.project_name and d.f = ff.function_source_file and d.b <= ff.function_linenumber group by 1, 2)
select ff.project_name, ff.function_name, case when ex.x is not null then ff.function_name else nr.x.n end declared_as, ex.x is not null by_name from ff left join ex using (project_name, function_name) left join nr on nr.project_name = ff.project_name and nr.function_name = ff.function_name""")
def j6_declaration(t):
    """Declaration of each function among those of the last snapshot: by its name, else the nearest of its file that begins at
    or before its line."""
    from ..operators.joins import asof_backward

    rows = t.raw("all_functions_db")
    last = rows.groupBy("project_name").agg(F.max("snap_date").alias("snap_date"))
    known = t.af.join(last, ["project_name", "snap_date"], "left_semi")
    named = known.select("project_name", "function_name", F.lit(True).alias("by_name")).distinct()
    asked = t.ff.select("project_name", "function_name", "function_source_file", "function_linenumber").join(named, ["project_name", "function_name"], "left")
    key = F.concat_ws("\t", "project_name", "function_source_file").alias("by")
    left = asked.select("project_name", "function_name", "by_name", key, F.col("function_linenumber").cast("long").alias("at"))
    near = asof_backward(left, known.select(key, F.col("src_begin").cast("long").alias("b"), F.col("function_name").alias("n")), "by", "at", "b", ["n"])
    return near.select("project_name", "function_name", F.when(F.col("by_name"), F.col("function_name")).otherwise(F.col("n")).alias("declared_as"), F.coalesce("by_name", F.lit(False)).alias("by_name"))


@query("ps", """, b as (select project_name, max(coverage_data.line_coverage.percent) best, max_by(lower(coalesce(proj_lang, 'n/a')), snap_date) lang from ps group by 1)
select lang, floor(best / 10)::int decile, count(*) series from b where best is not null group by 1, 2""")
def a23_histogram(t):
    """Series by language and tenth of their best coverage."""
    b = t.ps.groupBy("project_name").agg(F.max("coverage_data.line_coverage.percent").alias("best"), F.max_by(F.lower(F.coalesce("proj_lang", F.lit("n/a"))), "snap_date").alias("lang"))
    return b.filter("best is not null").groupBy("lang", F.floor(F.col("best") / 10).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("series"))


@query("", "from (values (1, 'ptr [in, mode]'), (2, 'array[int8, 16]'), (3, 'int64'), (4, 'ptr [in, ptr [in, int32]]')) t(id, text)")
def u7_command_types(t):
    """Types for command descriptions from debug tags, innermost last."""
    rows = [(1, ["DW_TAG_pointer_type", "DW_TAG_const_type", "DW_TAG_structure_type", "mode"]), (2, ["DW_TAG_array", "ARRAY-SIZE:16", "char"]), (3, ["DW_TAG_typedef", "__u64"]), (4, ["DW_TAG_pointer_type", "DW_TAG_pointer_type", "unsigned int"])]
    return t.spark.createDataFrame(rows, "id int, tags array<string>").select("id", X.command_type(F.col("tags")).alias("text"))
