"""Readers and writers on small literals."""

import json

from pyspark.sql import functions as F

from tracewell.functions.predicates import suffix_count
from tracewell.sources import reports as R
from tracewell.sources import sinks as K

TREE = """Some head
Call tree
LLVMFuzzerTestOneInput /src/fuzz.c linenumber=-1
  abc /src/a.c linenumber=10
    def /src/a.c linenumber=20
    ghi /src/b.c 21
    operator new(unsigned long) /src/c.c linenumber=3
  fuzz......  /src/fuzz.c linenumber=74
====================================
after this nothing
"""

COV = """a.c:first:
    1|      3|int first() {
    2|  4.68k|  if (x) {
  ------------------
  |  Branch (2:7): [True: 0, False: 4.68k]
  ------------------
    3|      0|  }
    4|       |
    5|  36.0M|  switch (y) {
  |  Branch (5:3): [True: 0, False: 9.36k]
    6|      0|    case 1:
  |  Branch (6:5): [True: 0, False: 9.36k]
    7|      2|    default:
  |  Branch (7:5): [True: 4.68k, False: 0]
  |  Branch (8:5): [Folded - Ignored]
second:
   10|      1|void second() {}
second:
   10|      7|void second() {}
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, value string")


def test_call_tree(spark):
    rows = R.call_trees(files(spark, TREE)).orderBy("idx").collect()
    assert [r["depth"] for r in rows] == [0, 1, 2, 2, 2, 1]
    assert [r["parent_idx"] for r in rows] == [None, 0, 1, 1, 1, 0]
    assert (rows[0]["src_line"], rows[3]["src_line"], rows[5]["dst_func"], rows[5]["src_line"]) == (-1, 21, "fuzz", 74)
    assert rows[4]["dst_file"] == "" and rows[4]["src_line"] == 0
    assert R.call_trees(files(spark, "no tree", "", None)).collect() == []


def test_coverage_report(spark):
    lines, branches = R.coverage_report(files(spark, COV))
    got = {(r["func"], r["pos"]): (r["line"], r["hits"]) for r in lines.collect()}
    assert got == {("first", 0): (1, 3), ("first", 1): (2, 4680), ("first", 2): (3, 0), ("first", 3): (5, 36_000_000), ("first", 4): (6, 0), ("first", 5): (7, 2), ("second", 0): (10, 7)}
    assert {(r["func"], r["line"], r["col"]): r["hits"] for r in branches.collect()} == {("first", 2, 7): [0, 4680], ("first", 5, 3): [0, 9360, 0, 4680]}


def test_other_coverage(spark):
    py = json.dumps({"files": {"/pythoncovmergedfiles/medio/x.py": {"executed_lines": [1, 2], "missing_lines": [3]}}})
    assert sorted(map(tuple, R.python_coverage(files(spark, py, "broken")).collect())) == [("/x.py", 1, True), ("/x.py", 2, True), ("/x.py", 3, False)]
    go = "mode: set\ntest.go:18.67,20.27 2 1\ntest.go:20.28,21.32 2 0\nnonsense"
    assert sorted(map(tuple, R.go_coverage(files(spark, go)).collect())) == [("test.go", 18, 1), ("test.go", 19, 1), ("test.go", 20, 1), ("test.go", 21, 0)]
    kernel = json.dumps([{"Filename": "/private/a.c", "Covered": [1, 5]}, {"Filename": "/b.c", "Covered": [2]}])
    assert sorted(map(tuple, R.kernel_coverage(files(spark, kernel)).collect())) == [("/private/a.c", 1), ("/private/a.c", 5)]


def test_jacoco(spark, tmp_path):
    (tmp_path / "j.xml").write_text("""<report><package name="p"><class name="p/F" sourcefilename="F.java"><method name="&lt;init&gt;" desc="()V" line="23"><counter type="LINE" missed="1" covered="0"/></method>
<method name="run" desc="(Lx/Data;)V" line="25"><counter type="INSTRUCTION" missed="0" covered="9"/><counter type="LINE" missed="0" covered="2"/></method></class>
<sourcefile name="F.java"><line nr="23" mi="3" ci="0"/><line nr="25" mi="0" ci="3"/><line nr="27" mi="0" ci="6"/></sourcefile></package></report>""")
    assert sorted(map(tuple, R.jacoco(spark, str(tmp_path)).collect())) == [("[p.F].<init>()", 23, 0), ("[p.F].run(Data)", 25, 3), ("[p.F].run(Data)", 27, 6)]
    assert R.jvm_descriptor("(I[Z)V") == "(int[],boolean)" and R.jvm_descriptor("()V") == "()"


def test_bugs_facts_and_sites(spark):
    bug = {"source_file": "a.c", "source_line": "1", "function_name": "f", "fuzzer_name": "z", "description": "d", "bug_type": "t"}
    assert len(R.input_bugs(files(spark, json.dumps({"bugs": [bug, {"source_file": "b"}]}), "no")).collect()) == 1
    yaml = """Fuzzer filename: /src/fuzz.c
All functions:
  Elements:
    - {functionName: f, functionLinenumber: 3, CyclomaticComplexity: 4, argTypes: [int], Callsites: [{Src: '/a.c:12,4', Dst: g}, {Src: bad, Dst: h}]}
---
All functions:
  Elements:
    - {functionName: g}
"""
    facts = R.function_facts(files(spark, yaml, ": : broken ["))
    got = {r["functionName"]: r for r in facts.collect()}
    assert got["f"]["CyclomaticComplexity"] == 4 and got["g"]["CyclomaticComplexity"] == 0 and got["g"]["functionLinenumberEnd"] == -1 and got["g"]["harness"] == "/src/fuzz.c"
    assert [tuple(r) for r in R.callsite_map(facts).collect()] == [("f", "g", "/a.c", 12)]


def test_text_scans(spark, tmp_path):
    src = "#define A_RUN _IOWR('k', 1, struct arg)\n// #define B _IO('k', 2)\n#define C \\\n  _IOR('k', 3, \\\n  int)\nint f() {\n  x;\n}\n"
    got = {r["name"]: (r["line"], r["direction"], r["argument"]) for r in R.ioctls(files(spark, src)).collect()}
    assert got == {"A_RUN": (1, "WR", "struct arg"), "C": (3, "R", "int")}
    assert R.source_slice(files(spark, src), 6, 7).collect()[0]["text"] == "int f() {\n  x;\n}"
    conf = "FUNCS_TO_AVOID\n^std::\n\nFILES_TO_AVOID\n/usr/\n"
    assert sorted(map(tuple, R.exclusion_lists(files(spark, conf)).collect())) == [("FILES_TO_AVOID", "/usr/"), ("FUNCS_TO_AVOID", "^std::")]
    for name in ("fuzzerLogFile-1.data", "fuzzerLogFile-1.data.yaml", "other.txt"):
        (tmp_path / name).write_text("x")
    found = R.find_files(spark, str(tmp_path))
    assert found.count() == 3 and R.find_files(spark, str(tmp_path), r".*\.txt").count() == 1
    assert [r["facts"].rsplit("/", 1)[1] for r in R.pair_profiles(found).collect()] == ["fuzzerLogFile-1.data.yaml"]
    assert R.whole_files(spark, str(tmp_path), "*.txt").count() == 1


def test_counts(spark):
    cases = {"4.68k": 4680, "36.0M": 36_000_000, "2G": 2_000_000_000, "17": 17, "": None, "x": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want long")
    assert df.withColumn("got", suffix_count(F.col("t"))).filter("not got <=> want").collect() == []


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "p string, d string, v int")
    new = spark.createDataFrame([("a", "1", 9), ("c", "2", 3)], "p string, d string, v int")
    path = str(tmp_path / "t")
    old.write.parquet(path)
    K.append_daily(new, path, ["p", "d"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "1", 1), ("b", "1", 2), ("c", "2", 3)]
    K.upsert_table(new, path, ["p", "d"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "1", 9), ("b", "1", 2), ("c", "2", 3)]
    K.write_json_by(old, str(tmp_path / "j"), "p")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    K.write_csv(old, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    rows = spark.createDataFrame([("s", "k", "1"), ("s", "a", '{"x": 2}')], "section string, key string, value string")
    assert json.loads(K.merge_sections(rows).collect()[0]["json"]) == {"k": 1, "a": {"x": 2}}


def test_stream(spark, tmp_path):
    from tracewell.streaming import daily as D

    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    rows = spark.createDataFrame([("a", "2025-01-01", 1), ("a", "2025-01-01", 2), ("b", "2025-01-01", 3)], "p string, d string, v int").withColumn("at", F.to_timestamp("d"))
    rows.write.parquet(src)
    for _ in range(2):
        stream = D.first_of_each(D.daily_stream(spark, src, rows.schema), ["p", "d"], "at")
        D.append_to(stream, out, check).awaitTermination()
    assert sorted(r["p"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
