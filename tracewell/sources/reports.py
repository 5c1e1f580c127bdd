"""Readers of call trees, coverage reports and fact files.

Whole files are read in parallel (one row a file) and parsed in Arrow batches or by column expressions; each reader gives a
DataFrame with an explicit schema. Bad entries are left out, as each docstring says.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import parents_from_depth
from ..operators.joins import suffix_join

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``value`` (the whole text) of each file whose name matches ``pattern``, folders included."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return files.select(F.input_file_name().alias("path"), "value")


def parsed(files: DataFrame, parse: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``parse(text)`` for each file, with its ``path`` first."""
    fields = [tuple(x.strip().split(" ", 1)) for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *r) for r in parse(text or "")]
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), *(_TYPES[k] for _, k in fields)], strict=True)], ["path", *(n for n, _ in fields)])

    return files.select("path", "value").mapInArrow(run, f"path string, {schema}")


def call_trees(files: DataFrame) -> DataFrame:
    """Call-tree texts: ``path``, ``idx``, ``depth``, ``dst_func``, ``dst_file``, ``src_line``, ``parent_idx``.

    Lines after ``Call tree`` up to ``====``; two blanks a level; three words are function, file and line (with or without
    ``linenumber=``), any other number of words is a function without file at line 0; runs of six points are dropped.
    """
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.max(F.when(F.col("line").startswith("Call tree"), F.col("n"))).over(w)
    ends = F.max(F.when(F.col("line").contains("===="), F.col("n"))).over(w)
    body = lines.withColumn("s", starts).withColumn("e", ends).filter("s is not null and n > s and (e is null or e < s) and trim(line) <> ''")
    line = F.replace("line", F.lit("......"), F.lit(""))
    words = F.split(F.trim(line), " +")
    three = F.size(words) == 3
    rows = body.select(
        "path", (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).alias("idx"), F.floor((F.length(line) - F.length(F.ltrim(line))) / 2).cast("int").alias("depth"),
        F.when(three, F.get(words, 0)).otherwise(F.trim(line)).alias("dst_func"), F.when(three, F.get(words, 1)).otherwise("").alias("dst_file"),
        F.when(three, F.coalesce(F.regexp_extract(F.get(words, 2), r"(?:linenumber=)?(-?\d+)$", 1).try_cast("int"), F.lit(0))).otherwise(0).alias("src_line"),
    )
    return parents_from_depth(rows, "path", "idx", "depth")


_HEADER = re.compile(r"^(\S.*):$")
_ROW = re.compile(r"^\s*(\d+)\|\s*([0-9.]+[kMG]?)?\|(.*)$")
_BRANCH = re.compile(r"Branch \((\d+):(\d+)\): \[(?:True: ([0-9.]+[kMG]?), False: ([0-9.]+[kMG]?)|(Folded[^\]]*))\]")
_CASE = re.compile(r"\bcase\b.*:|\bdefault\s*:")
_SWITCH = re.compile(r"\bswitch\s*\(")


def number(text: str | None) -> int:
    """Counts such as 4.68k, 36.0M or 2G."""
    if not text:
        return 0
    scale = {"k": 10**3, "M": 10**6, "G": 10**9}.get(text[-1])
    return round(float(text[:-1]) * scale) if scale else int(float(text))


def _covreport(text: str) -> Iterator[tuple]:
    """Functions, lines and branches of one report; a repeated function replaces what was read of it."""
    lines: dict[str, list[tuple[int, int]]] = {}
    branches: dict[str, dict[tuple[int, int], list[int]]] = {}
    func, source, switch, at = None, {}, None, 0
    for raw in text.split("\n"):
        raw = raw.rstrip("\r")
        if (m := _BRANCH.search(raw)) and func is not None:
            if m.group(5):
                continue
            line, col, yes, no = int(m.group(1)), int(m.group(2)), number(m.group(3)), number(m.group(4))
            text_at = source.get(line, "")
            if _SWITCH.search(text_at) and not re.search(r"\bif\b", text_at):
                switch = (line, col)
                branches[func][switch] = [yes, no]
            elif switch and _CASE.search(text_at):
                branches[func][switch].append(yes)
            else:
                branches[func][(line, col)] = [yes, no]
        elif m := _ROW.match(raw):
            at = int(m.group(1))
            source[at] = m.group(3)
            if func is not None and m.group(2) is not None:
                lines[func].append((at, number(m.group(2))))
        elif (m := _HEADER.match(raw)) and "|" not in raw:
            func = m.group(1).rsplit(":", 1)[-1] if re.match(r"^[^:]*\.[A-Za-z]+:[^:]", m.group(1)) else m.group(1)
            lines[func], branches[func], source, switch = [], {}, {}, None
    for f, rows in lines.items():
        yield from ((f, "line", i, n, 0, [h]) for i, (n, h) in enumerate(rows))
        yield from ((f, "branch", i, n, c, h) for i, ((n, c), h) in enumerate(branches[f].items()))


def coverage_report(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, branches) of text coverage reports: ``func``, ``pos``, ``line``, ``hits`` and ``func``, ``line``, ``col``,
    ``hits`` (a list: true and false, or the switch and its cases). Of a function in several places the last in file order
    holds; folded branches and rows without a count are left out."""
    rows = parsed(files, _covreport, "func string, kind string, pos int, line int, col int, hits array<long>")
    last = rows.withColumn("keep", F.max("path").over(Window.partitionBy("func"))).filter("path = keep")
    return last.filter("kind = 'line'").select("func", "pos", "line", F.get("hits", 0).alias("hits")), last.filter("kind = 'branch'").select("func", "line", "col", "hits")


def reports_of_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines (as in ``coverage_report``) of each ``target``: of the report that bears its name, of all reports if none does.
    Of a function in several reports the last in file order holds."""
    rows = parsed(files, _covreport, "func string, kind string, pos int, line int, col int, hits array<long>").filter("kind = 'line'")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = files.select("path", stem.alias("target"))
    own = targets.join(named, "target")
    rest = targets.join(named.select("target"), "target", "left_anti").crossJoin(files.select("path"))  # targets without a report of their own read all reports
    read = own.select("target", "path").unionByName(rest.select("target", "path")).join(rows, "path")
    last = read.withColumn("keep", F.max("path").over(Window.partitionBy("target", "func"))).filter("path = keep")
    return last.select("target", "func", "pos", "line", F.get("hits", 0).alias("hits"))


def python_coverage(files: DataFrame) -> DataFrame:
    """JSON coverage: ``file``, ``line``, ``executed``; leading mount folders are cut, broken files give no rows."""
    kind = "struct<files: map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>>"
    got = files.select(F.explode(F.from_json("value", kind)["files"]).alias("file", "v"))
    name = F.regexp_replace(F.replace("file", F.lit("/pythoncovmergedfiles"), F.lit("")), r"/medio", "")
    side = lambda c, flag: F.transform(F.coalesce(F.col(c), F.array().cast("array<int>")), lambda x: F.struct(x.alias("line"), F.lit(flag).alias("executed")))
    return got.select(name.alias("file"), F.inline(F.concat(side("v.executed_lines", True), side("v.missing_lines", False))))


def go_coverage(files: DataFrame) -> DataFrame:
    """``mode:`` coverage: ``file``, ``line``, ``hits``, ranges spread over their lines, the greatest count of a line kept."""
    lines = files.select(F.explode(F.split("value", r"\r?\n")).alias("line"))
    part = lambda n: F.regexp_extract("line", r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)$", n)
    spans = lines.filter(part(1) != "").select(part(1).alias("file"), part(2).cast("int").alias("a"), part(3).cast("int").alias("b"), part(5).cast("long").alias("hits"))
    return spans.filter("a <= b").select("file", F.explode(F.sequence("a", "b")).alias("line"), "hits").groupBy("file", "line").agg(F.max("hits").alias("hits"))


def go_functions(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """``func``, ``line``, ``hits`` of functions (``func``, ``file``, ``b``, ``e``) from coverage files whose path ends with
    theirs; lines without a count have 0, functions without places or files none."""
    placed = functions.filter("b > 0 and e > 0").withColumn("file", F.element_at(F.split("file", "/source-files"), -1))
    paths = lines.select(F.col("file").alias("path")).distinct()
    met = suffix_join(paths, "path", placed.withColumnRenamed("file", "tail"), "tail")
    asked = met.select("func", "path", F.explode(F.sequence("b", "e")).alias("line"))
    return asked.join(lines.withColumnRenamed("file", "path"), ["path", "line"], "left").select("func", "line", F.coalesce("hits", F.lit(0)).alias("hits"))


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """JaCoCo XML: ``func``, ``line``, ``hits`` (covered instructions of the line). A method's lines are as many lines of
    its source file as its LINE counter has, from its first line on."""
    line = "struct<_nr: int, _ci: long>"
    counter = "struct<_type: string, _missed: int, _covered: int>"
    method = f"struct<_name: string, _desc: string, _line: int, counter: array<{counter}>>"
    schema = f"_name string, class array<struct<_name: string, _sourcefilename: string, method: array<{method}>>>, sourcefile array<struct<_name: string, line: array<{line}>>>"
    packages = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path)
    files = packages.select(F.col("_name").alias("package"), F.inline("sourcefile")).select("package", F.col("_name").alias("file"), "line")
    classes = packages.select(F.col("_name").alias("package"), F.explode("class").alias("c")).select("package", F.col("c._sourcefilename").alias("file"), F.replace("c._name", F.lit("/"), F.lit(".")).alias("owner"), F.explode("c.method").alias("m"))
    met = classes.join(files, ["package", "file"])
    count = F.aggregate(F.filter("m.counter", lambda c: c["_type"] == "LINE"), F.lit(0), lambda a, c: a + c["_missed"] + c["_covered"])
    at = F.array_position(F.transform("line", lambda x: x["_nr"]), F.col("m._line"))
    rows = met.withColumn("at", at.cast("int")).withColumn("n", count).filter("at > 0 and n > 0")
    return rows.select(F.concat(F.lit("["), "owner", F.lit("]."), "m._name", jvm_arguments(F.col("m._desc"))).alias("func"), F.inline(F.slice("line", F.col("at"), F.col("n")))).select("func", F.col("_nr").alias("line"), F.col("_ci").alias("hits"))


def jvm_descriptor(desc: str) -> str:
    """Arguments of a JVM descriptor, in brackets: base names of classes, ``[]`` moved onto the argument read before it,
    as keys of older reports have it."""
    base = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}
    args: list[str] = []
    text, i, dims, now = desc[desc.find("(") + 1 : desc.rfind(")")], 0, 0, ""

    def flush():
        nonlocal now, dims
        if now:
            args.append(now + "[]" * dims)
            now, dims = "", 0

    while i < len(text):
        if text[i] == "[":
            dims += 1
            i += 1
            continue
        flush()
        if text[i] == "L":
            end = text.index(";", i)
            now, i = text[i + 1 : end].rsplit("/", 1)[-1], end + 1
        else:
            now, i = base.get(text[i], ""), i + 1
    flush()
    return "(" + ",".join(args) + ")"


def jvm_arguments(desc):
    @F.pandas_udf("string")
    def decode(s):
        return s.map(lambda d: None if d is None else jvm_descriptor(d))

    return decode(desc)


def kernel_coverage(files: DataFrame) -> DataFrame:
    """Kernel coverage JSON (a list of objects): entries of private sources as ``file`` and covered ``line``."""
    kind = "array<struct<Filename: string, Covered: array<int>>>"
    return files.select(F.inline(F.from_json("value", kind))).filter(F.col("Filename").contains("/private/")).select(F.col("Filename").alias("file"), F.explode("Covered").alias("line"))


BUG = "source_file string, source_line string, function_name string, fuzzer_name string, description string, bug_type string"


def input_bugs(files: DataFrame) -> DataFrame:
    """Bug records; entries that lack a field are left out."""
    rows = files.select(F.inline(F.from_json("value", f"struct<bugs: array<struct<{BUG.replace(' string', ': string')}>>>")["bugs"]))
    return rows.dropna()


def _facts(text: str) -> Iterator[tuple]:
    try:
        import yaml
    except ImportError:  # pragma: no cover
        return
    try:
        docs = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
    except yaml.YAMLError:
        return
    for d in docs:
        for e in ((d.get("All functions") or {}).get("Elements") or []) if isinstance(d.get("All functions"), dict) else []:
            if isinstance(e, dict) and e.get("functionName"):
                yield json.dumps(e, default=str), str(docs[0].get("Fuzzer filename") or "")


FACT = (
    "functionName string, functionSourceFile string, linkageType string, functionLinenumber int, functionLinenumberEnd int, returnType string, argCount int, argTypes array<string>, argNames array<string>, "
    "BBCount int, ICount int, EdgeCount int, CyclomaticComplexity int, functionsReached array<string>, functionUses int, functionDepth int, constantsTouched array<string>, "
    "BranchProfiles array<struct<`Branch String`: string, `Branch Sides`: array<struct<BranchSide: string, BranchSideFuncs: array<string>>>>>, Callsites array<struct<Src: string, Dst: string>>"
)


def function_facts(files: DataFrame) -> DataFrame:
    """Function facts of YAML files (elements of several documents are put together): ``path``, ``harness`` and the fields
    of ``FACT``; a missing end line is -1, missing complexity 0."""
    rows = parsed(files, _facts, "fact string, harness string").select("path", "harness", F.from_json("fact", FACT).alias("f")).select("path", "harness", "f.*")
    return rows.withColumn("functionLinenumberEnd", F.coalesce("functionLinenumberEnd", F.lit(-1))).withColumn("CyclomaticComplexity", F.coalesce("CyclomaticComplexity", F.lit(0)))


def callsite_map(facts: DataFrame) -> DataFrame:
    """Call sites of facts: ``src_func``, ``dst_func``, ``src_file``, ``line``; sites that are not ``file:line,col`` are left out."""
    rows = facts.select(F.col("functionName").alias("src_func"), F.inline("Callsites"))
    part = lambda n: F.regexp_extract("Src", r"^(.*):(\d+),(\d+)$", n)
    return rows.filter(part(2) != "").select("src_func", F.col("Dst").alias("dst_func"), part(1).alias("src_file"), part(2).cast("int").alias("line"))


def ioctls(files: DataFrame) -> DataFrame:
    """ioctl definitions in sources: ``path``, ``line``, ``name``, ``direction``, ``argument``; a definition may go over up
    to three lines joined by backslashes; lines within comments do not count."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n")
    full = F.regexp_replace(F.concat_ws(" ", "line", *[F.when(F.lag("line", 0).over(w).endswith("\\"), F.lead("line", 1).over(w)), F.when(F.lead("line", 1).over(w).endswith("\\"), F.lead("line", 2).over(w))]), r"\\", " ")
    part = lambda i: F.regexp_extract("full", r"^\s*#\s*define\s+(\w+)\s+.*?\b_IO(WR|RW|W|R|)\s*\(([^)]*)\)", i)
    rows = lines.withColumn("full", full).filter(part(1) != "").filter(~F.col("line").rlike(r"^\s*(//|/\*|\*)"))
    return rows.select("path", (F.col("n") + 1).alias("line"), part(1).alias("name"), part(2).alias("direction"), F.trim(F.element_at(F.split(part(3), ","), -1)).alias("argument"))


def source_slice(files: DataFrame, first: int, last: int) -> DataFrame:
    """Lines ``first`` to ``last`` (from 1) of each file, up to ten more until a line holds a closing brace: ``path``, ``text``."""
    lines = F.split("value", r"\r?\n")
    more = F.slice(lines, last, 11)
    extra = F.greatest(F.array_position(F.transform(more, lambda x: F.contains(x, F.lit("}"))), True) - 1, F.lit(0))
    return files.select("path", F.array_join(F.slice(lines, F.lit(first), (F.lit(last - first + 1) + extra).cast("int")), "\n").alias("text"))


def exclusion_lists(files: DataFrame) -> DataFrame:
    """Exclusion settings: ``section`` (FUNCS_TO_AVOID, FILES_TO_AVOID) and ``pattern``, one row a line below its section."""
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").isin("FUNCS_TO_AVOID", "FILES_TO_AVOID")
    section = F.last(F.when(head, F.col("line")), ignorenulls=True).over(w)
    return lines.withColumn("section", section).filter(~head & (F.col("line") != "") & F.col("section").isNotNull()).select("section", F.col("line").alias("pattern"))


def find_files(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """Paths below a folder whose names match a pattern; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.filter(F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{pattern})$"))


def pair_profiles(files: DataFrame) -> DataFrame:
    """Call-tree files with their fact files: ``<tree>.yaml`` beside a tree, ``report.yaml`` in the folder of a ``.txt``."""
    trees = files.filter(F.col("path").rlike(r"fuzzerLogFile.*\.data$|fuzzer-calltree-[^/]*$|targetCalltree\.txt$")).select(F.col("path").alias("tree"))
    wanted = trees.withColumn("path", F.when(F.col("tree").endswith(".txt"), F.regexp_replace("tree", r"[^/]+$", "report.yaml")).otherwise(F.concat("tree", F.lit(".yaml"))))
    return wanted.join(files.select("path"), "path").select("tree", F.col("path").alias("facts"))


