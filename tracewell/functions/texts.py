"""Texts for reports and look-ups, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_padded(number: Column, width: int = 5) -> Column:
    """A number with zeros in front; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def cut_number(text: Column, width: int = 5) -> Column:
    """The first characters of a number's text, without rounding."""
    return F.substring(text, 1, width)


def namespaces(name: Column) -> Column:
    """Parts of a C++ name between ``::``; what follows the parameters' bracket is cut off, and the name ends there. A part
    that begins with a bracket (an anonymous namespace) stays whole. A name without ``::`` has none."""
    parts = F.filter(F.split(name, "::"), lambda x: x != "")
    ends = lambda x: x.contains("(") & ~x.startswith("(")
    last = F.array_position(F.transform(parts, ends), True)
    kept = F.when(last > 0, F.slice(parts, 1, last.cast("int"))).otherwise(parts)
    return F.when(name.contains("::"), F.transform(kept, lambda x: F.when(ends(x), F.substring_index(x, "(", 1)).otherwise(x))).otherwise(F.array().cast("array<string>"))


def c_type(tags: Column) -> Column:
    """A C type from its debug tags, outermost first: pointers and references behind, const in front, names in the middle."""
    has = lambda *names: F.filter(tags, lambda x: x.isin(*names))
    post = F.array_join(F.transform(has("DW_TAG_pointer_type", "DW_TAG_reference_type"), lambda x: F.when(x == "DW_TAG_pointer_type", "*").otherwise("&")), "")
    pre = F.trim(F.repeat(F.lit("const "), F.size(has("DW_TAG_const_type"))))
    # Each name read while a structure is open puts ``struct`` in front of all names so far.
    start = F.struct(F.lit(False).alias("s"), F.lit("").alias("m"))

    def step(a: Column, x: Column) -> Column:
        quiet = x.isin("DW_TAG_pointer_type", "DW_TAG_reference_type", "DW_TAG_base_type", "DW_TAG_typedef", "DW_TAG_class_type", "DW_TAG_const_type")
        name = F.concat(F.when(a["s"], "struct ").otherwise(""), a["m"], x)
        return F.when(x == "DW_TAG_structure_type", F.struct(F.lit(True).alias("s"), a["m"].alias("m"))).when(quiet, a).otherwise(F.struct(a["s"].alias("s"), name.alias("m")))

    middle = F.aggregate(tags, start, step)["m"]
    return F.trim(F.concat(pre, F.lit(" "), middle, F.lit(" "), post))


def c_signature(result: Column, name: Column, params: Column) -> Column:
    """``result name(params)`` from debug tags of the result and an array of tags of each parameter; N/A without a result."""
    return F.when(result.isNull(), "N/A").otherwise(F.concat(c_type(result), F.lit(" "), name, F.lit("("), F.array_join(F.transform(params, c_type), ", "), F.lit(")")))


#: Widths of C types in command descriptions; fixed values.
COMMAND_TYPES = {"char": "int8", "int": "int32", "unsigned int": "int32", "__i32": "int32", "__b32": "int32", "__u32": "int32", "u32": "int32", "__s32": "int32", "s32": "int32", "__u64": "int64", "s64": "int64", "unsigned long long": "int64", "__u8": "int8", "u8": "int8", "__s8": "int8", "__u16": "int16", "u16": "int16"}


def command_type(tags: Column) -> Column:
    """A type for command descriptions, built from the innermost tag outwards; unknown names are structures of that name."""
    quiet = ["DW_TAG_reference_type", "DW_TAG_structure_type", "DW_TAG_base_type", "DW_TAG_typedef", "DW_TAG_class_type", "DW_TAG_const_type", "DW_TAG_enumeration_type"]
    known = F.create_map(*[F.lit(v) for pair in COMMAND_TYPES.items() for v in pair])

    def step(a: Column, x: Column) -> Column:
        size = F.concat(a, F.lit(", "), F.replace(x, F.lit("ARRAY-SIZE:"), F.lit("")))
        return F.when(x == "DW_TAG_pointer_type", F.concat(F.lit("ptr [in, "), a, F.lit("]"))).when(x.isin(*quiet), a).when(x.contains("ARRAY-SIZE"), size).when(x.contains("DW_TAG_array"), F.concat(F.lit("array["), a, F.lit("]"))).otherwise(F.coalesce(F.try_element_at(known, x), x))

    return F.aggregate(F.reverse(tags), F.lit(""), step)


def imports(classes: Column) -> Column:
    """Sorted import lines of public classes: each class, and a wildcard for every level of its package."""
    def of(c: Column) -> Column:
        parts = F.split(c, r"\.")
        levels = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
        wild = F.transform(levels, lambda i: F.concat(F.lit("import "), F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit(".*;")))
        return F.concat(F.array(F.concat(F.lit("import "), c, F.lit(";"))), F.when(F.size(parts) > 1, wild).otherwise(F.array().cast("array<string>")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(classes, of))))


def first_cause(log: Column) -> Column:
    """The first error that the engine's log names; the whole log if it names none."""
    found = F.regexp_extract(log, r"==\d+== ERROR: libFuzzer: ([^\n]*)", 1)
    return F.when(log.rlike(r"==\d+== ERROR: libFuzzer: "), F.trim(found)).otherwise(log)


def target_url(url: Column, target: Column) -> Column:
    """Address of the whole coverage report changed to that of one target."""
    return F.replace(F.replace(url, F.lit("reports"), F.lit("reports-by-target")), F.lit("/linux"), F.concat(F.lit("/"), target, F.lit("/linux")))


def coverage_link(base: Column, file: Column, line: Column) -> Column:
    return F.concat(base, file, F.lit(".html#L"), line.cast("string"))


def rounded_share(part: Column, whole: Column) -> Column:
    """A share rounded to two places and then scaled to percent; 0 without a whole."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 2) * 100


def day_month_year(text: Column) -> Column:
    """Dates written dd-mm-YYYY; null for other texts."""
    return F.try_to_date(text, "dd-MM-yyyy")


def merged_map(old: Column, new: Column) -> Column:
    """Both maps, the values of ``new`` where a key is in both."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)
