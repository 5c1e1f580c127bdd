"""Predicates on functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and words that results have to agree with.
BLOCKED_CALLEES = r"^__sanitizer|^llvm\.|^__assert|.*printf$"
MERGE_EXCLUDED = r"sanitizer|llvm|LLVMFuzzerTestOneInput"
KEYWORDS = ("deserialize", "parse", "parse_xml", "read_file", "read_json", "read_xml", "request", "parse_header", "parse_request", "compress", "file_read", "read_message", "load_image")
PUBLIC_EXCLUDED = ("fuzzertestoneinput", "fuzzerinitialize", "fuzzerteardown", "exception", "error", "test", "llvmfuzertestoneinput", "fuzz_target")
BANNED_PATHS = ("/src/fuzztest/", "/src/libfuzzer/", "/src/aflplusplus/", "/LPM/", "/googletest/", "/third_party/", "/thirdparty/", "fuzz", "/depends/", "/external/", "/build/", "/src/inspector/", "/source-code/", "/workspace/")

#: Functions outside the project that no call tree enters.
EXCLUDED_FUNCTIONS = ("^_ZNSt3", "^_ZSt", "^_ZNKSt", "^_ZTv0_n24_NSt", "^_ZN18FuzzedDataProvider", "^_Zd", "^_Zn", "^free$", "^malloc$", "llvm[.]", "sanitizer_cov", "sancov[.]module")


def not_excluded(name: Column, patterns: tuple[str, ...] = EXCLUDED_FUNCTIONS) -> Column:
    return ~name.rlike("|".join(patterns))


def with_package_and_name(df: DataFrame) -> DataFrame:
    """``df`` (``lang``, ``function_name``, ``source_file``) with ``package`` and ``name`` as the language writes them: none and
    the name without blanks for C and C++; the file, or what stands before the point of a builtin, for Python; what stands in
    brackets before the last point for the JVM, ``default`` without any. Other languages have neither."""
    n = F.col("function_name")
    builtin = n.startswith("<builtin>.")
    plain = F.substring_index(n, "(", 1)
    package = F.when(F.col("lang") == "c-cpp", "").when(F.col("lang") == "python", F.when(builtin, "<builtin>").otherwise(F.col("source_file"))).when(F.col("lang") == "jvm", F.when(plain.contains("."), F.expr("substring(%s, 2, length(%s) - 2)" % (("regexp_extract(substring_index(function_name, '(', 1), '^(.*)[.][^.]*$', 1)",) * 2))).otherwise("default"))
    name = F.when(F.col("lang") == "c-cpp", F.replace(n, F.lit(" "), F.lit(""))).when(F.col("lang") == "python", F.when(builtin, F.regexp_replace(n, r"^<builtin>\.", "")).otherwise(n)).when(F.col("lang") == "jvm", F.element_at(F.split(plain, r"\."), -1))
    return df.withColumn("package", package).withColumn("name", name)


def blocked_callee(name: Column) -> Column:
    return name.rlike(BLOCKED_CALLEES)


def visible_callees(callees: Column) -> Column:
    """Callees of a branch side that are neither runtime nor output functions."""
    return F.filter(callees, lambda x: ~blocked_callee(x))


def mergeable(name: Column) -> Column:
    return ~name.rlike(MERGE_EXCLUDED)


def with_source(file: Column, line: Column) -> Column:
    return (F.trim(file) != "") & (line != -1)


def keyword_name(name: Column, words: tuple[str, ...] = KEYWORDS) -> Column:
    """A keyword occurs in the name, with or without its underscores, whatever the case."""
    forms = sorted({f for w in words for f in (w, w.replace("_", ""))})
    return F.lower(name).rlike("|".join(forms))


def easy_parameters(types: Column) -> Column:
    """(char *, int) or one char * or string."""
    one = (F.size(types) == 1) & (F.element_at(types, 1).contains("char *") | F.element_at(types, 1).contains("string"))
    two = (F.size(types) == 2) & F.get(types, 0).contains("char *") & F.get(types, 1).contains("int")
    return F.coalesce(F.when(F.size(types) == 1, one).when(F.size(types) == 2, two), F.lit(False))


def public_candidate(name: Column, arg_count: Column) -> Column:
    return (arg_count > 0) & ~F.lower(name).rlike("|".join(PUBLIC_EXCLUDED))


def allowed_path(path: Column) -> Column:
    return ~path.rlike("|".join(BANNED_PATHS))


def without_blanks(name: Column) -> Column:
    return F.translate(name, " \t\r\n", "")


def without_generics(name: Column) -> Column:
    """``name`` without arguments of generics, written plainly or escaped (fixed pattern)."""
    return F.regexp_replace(name, r"<[\s.,a-zA-Z0-9]+>|\\u003C[\s.,a-zA-Z0-9]+\\u003E", "")


def with_package(package: Column, name: Column) -> Column:
    """``[package].name``, unless the name has its package in brackets already."""
    return F.when(name.startswith("["), name).otherwise(F.concat(F.lit("["), package, F.lit("]."), name))


def suffix_count(text: Column) -> Column:
    """Counts such as 4.68k, 9.3M or 2G as whole numbers; null for other text."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)[kMG]?\s*$", 1)
    factor = F.when(text.endswith("k"), 1000.0).when(text.endswith("M"), 1e6).when(text.endswith("G"), 1e9).otherwise(1.0)
    return F.when(text.rlike(r"^\s*[0-9]+(\.[0-9]+)?[kMG]?\s*$"), F.round(number.try_cast("double") * factor, 0).cast("long"))
