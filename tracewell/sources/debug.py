"""Debug information, executables, status feeds and directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def _last_of_place(rows: DataFrame) -> DataFrame:
    """Of rows with one file and line the last in file order."""
    w = Window.partitionBy("source_file", "source_line").orderBy(F.desc("path"), F.desc("n"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def _place(location: Column) -> tuple[Column, Column]:
    """File and line (text, '-1' if there is none) of ``file:line``."""
    parts = F.split(location, ":")
    return F.get(parts, 0).alias("source_file"), F.coalesce(F.get(parts, 1), F.lit("-1")).alias("source_line")


def _within(text: Column) -> Column:
    """What stands between the last opening brace and the first closing one after it."""
    return F.trim(F.regexp_extract(text, r"\{([^{}]*)[^{]*$", 1))


def compile_units(files: DataFrame) -> DataFrame:
    """Compile units of debug texts: ``source_file``, ``language``, one row a file. Of two absolute paths written together the
    second counts."""
    words = F.split("line", " ")
    last = F.element_at(words, -1)
    path = F.when(last.contains("//"), F.regexp_replace(last, r"^.*?//", "/")).otherwise(last)
    rows = _lines(files).filter(F.col("line").contains("Compile unit:")).select(F.regexp_replace(path, "//", "/").alias("source_file"), F.get(words, F.lit(2)).alias("language"), "path", "n")
    w = Window.partitionBy("source_file").orderBy(F.desc("path"), F.desc("n"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("source_file", "language")


def global_variables(files: DataFrame) -> DataFrame:
    """Global variables: ``name``, ``source_file``, ``source_line``; of one place the last holds."""
    parts = F.split(F.replace("line", F.lit("Global variable: "), F.lit("")), " from ")
    rows = _lines(files).filter(F.col("line").contains("Global variable: ")).select("path", "n", F.get(parts, F.lit(0)).alias("name"), *_place(F.element_at(parts, -1)))
    return _last_of_place(rows).select("name", "source_file", "source_line")


def debug_types(files: DataFrame) -> DataFrame:
    """Structures and type names after the line that opens the module's types: ``kind`` (struct, typedef), ``name``,
    ``source_file``, ``source_line``, ``elements`` (names, in order). Elements belong to the structure before them; of one
    place the last type holds."""
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.when(F.col("line").contains("## Types defined in module"), F.col("n"))).over(order)
    head = F.col("line").contains("Type: Name:")
    body = _lines(files).withColumn("open", opened).filter("open is not null").withColumn("of", F.max(F.when(head, F.col("n"))).over(order))
    kind = F.when(F.col("line").contains("DW_TAG_structure"), "struct").when(F.col("line").contains("DW_TAG_typedef"), "typedef")
    location = F.get(F.split(F.trim(F.element_at(F.split("line", "from"), -1)), " "), F.lit(0))
    types = body.filter(head & kind.isNotNull()).select("path", "n", kind.alias("kind"), _within(F.col("line")).alias("name"), *_place(location))
    element = F.get(F.split(F.trim(F.element_at(F.split("line", r"\{"), -1)), " "), F.lit(0))
    inside = body.filter(F.col("line").contains("- Elem ")).groupBy("path", F.col("of").alias("n")).agg(F.sort_array(F.collect_list(F.struct("n", element.alias("e")))).alias("es"))
    rows = types.join(inside, ["path", "n"], "left").withColumn("elements", F.when((F.col("kind") == "struct") & F.col("es").isNotNull(), F.transform("es", lambda x: x["e"])).otherwise(F.array().cast("array<string>")))
    return _last_of_place(rows).select("kind", "name", "source_file", "source_line", "elements")


def debug_functions(rows: DataFrame) -> DataFrame:
    """Debug functions (``pos``, ``name``, ``file_location``) once a location, the last one held; those without a location all
    stay."""
    w = Window.partitionBy("file_location").orderBy(F.desc("pos"))
    placed = rows.filter(F.trim("file_location") != "").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    return rows.filter(F.coalesce(F.trim("file_location"), F.lit("")) == "").unionByName(placed)


def plain_type_name(name: Column) -> Column:
    return F.when(name == "_Bool", "bool").otherwise(name)


def logs_of_executables(files: DataFrame) -> DataFrame:
    """Executables (``path``, binary ``content``) with the first run of ten or more word characters that names a log:
    ``path``, ``log_file``. Bytes beyond ASCII separate nothing."""
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "[^\\x00-\\x7F]", "")
    found = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_-]{10,})"), F.lit(1)), lambda x: x.contains("fuzzerLogFile"))
    return files.select("path", F.get(found, F.lit(0)).alias("log_file")).filter("log_file is not null")


def build_status(fuzz: DataFrame, coverage: DataFrame, report: DataFrame) -> DataFrame:
    """Three status feeds (``value``: JSON of projects with a history, newest first) as one row a project: success and build
    of each, N/A where a feed lacks the project. A project of the coverage feed without history has failed."""
    kind = "struct<projects: array<struct<name: string, history: array<struct<build_id: string, success: boolean>>>>>"

    def feed(df: DataFrame, name: str, lenient: bool = False) -> DataFrame:
        p = df.select(F.inline(F.from_json("value", kind)["projects"])).select(F.col("name").alias("project"), F.get("history", F.lit(0)).alias("h"))
        p = p if lenient else p.filter("h is not null")
        return p.select("project", F.coalesce(F.col("h.success"), F.lit(False)).cast("string").alias(name), F.coalesce("h.build_id", F.lit("N/A")).alias(f"{name}_log"))

    rows = feed(fuzz, "fuzz").join(feed(coverage, "coverage", True), "project", "full").join(feed(report, "report"), "project", "full")
    return rows.fillna("N/A")


def is_test_path(path: Column) -> Column:
    """A file in a folder of samples, tests or examples, or with ``test`` in its name."""
    folder, name = F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), F.lower(F.element_at(F.split(path, "/"), -1))
    return folder.contains("sample") | folder.contains("test") | folder.contains("example") | name.contains("test")


def of_language(paths: DataFrame, extensions: list[str], excluded: list[str]) -> DataFrame:
    """Paths with one of the extensions outside the excluded folders."""
    bad = F.exists(F.split("path", "/"), lambda x: x.isin(*excluded)) if excluded else F.lit(False)
    return paths.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions) & ~bad)
