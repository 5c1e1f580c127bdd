"""Schemas that drift between the files of one sequence.

1. The valid delivery of each record is stored once; profile and exact check read it.
2. Each (file, field) is profiled by expressions: counts, types and a value sketch (the least record key in each of
   ``SKETCH`` buckets with the hash of its value, so that sketches of two fields sample the same records).
3. Of each two consecutive files, fields that go are matched with fields that come. An edge needs sketches that agree, and
   then equal values for all records that have both, which is checked exactly. Where a field has several edges, an
   assignment of greatest weight (records in common, then likeness of names) decides.
4. Renames are followed to one canonical name, and all files are read into one table under these names.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored

SKETCH = 8
#: A field whose members are fields of their own, as long as it is an object.
NESTED = "JavaMethodInfo"


#: Kinds of values by bit.
KINDS = ("integer", "decimal", "string", "boolean", "array", "object")
_END = "__end_of_payload"


def valid_json(payload: Column) -> Column:
    """The payload as a variant; null if it is no valid JSON value (cut off, followed by more, NaN, or with a name twice in one
    object). The parser stops after the first value, so the payload is read inside another one that has to end as well."""
    whole = F.try_parse_json(F.concat(F.lit('{"p":'), payload, F.lit(f',"{_END}":0}}')))
    return F.when(F.try_variant_get(whole, f"$.{_END}", "int") == 0, F.try_variant_get(whole, "$.p", "variant"))


def kind_of(value: Column, text: Column) -> Column:
    """Number of the value's kind in ``KINDS`` from the value and its JSON ``text``; null for null. Numbers written with a point
    or an exponent are decimals, and whole numbers of any length integers; only for numbers the value itself is asked."""
    number = F.schema_of_variant(value)
    whole = (number == "BIGINT") | number.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    first = F.substring(text, 1, 1)
    return F.when(first == "n", F.lit(None).cast("int")).when(first == '"', 2).when(first == "[", 4).when(first == "{", 5).when(first.isin("t", "f"), 3).when(whole, 0).when(text.isNotNull(), 1)


def valid_records(raw: DataFrame) -> DataFrame:
    """The record that holds of each (file, number): greatest ``ingest_ts`` (null first), then greatest payload.

    Copies fold on the map side. Rows without a file id or writing time belong to no file and are left out.
    """
    kept = raw.filter("file_id is not null and written_at is not null")
    best = kept.groupBy("project_name", "file_id", "written_at", "record_no").agg(F.max(F.struct("ingest_ts", "payload")).alias("m"))
    return best.select("project_name", "file_id", "written_at", "record_no", F.col("m.payload").alias("payload"))


def stored_records(raw: DataFrame) -> DataFrame:
    """``seq_name``, ``file_id``, ``written_us``, ``payload`` of the valid records, stored; a null sequence is ''."""
    rows = valid_records(raw.withColumn("project_name", F.coalesce("project_name", F.lit(""))))
    return stored(rows.select(F.col("project_name").alias("seq_name"), "file_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("written_us"), "payload"))


def parsed(records: DataFrame, key: str) -> DataFrame:
    """``records`` with ``v`` (the payload as a variant) and ``rec`` (text of the record's key) for the payload, without what is
    no valid JSON. Not to be stored: files may keep the numbers of a column in one type, which loses how they were written."""
    rows = records.withColumn("v", valid_json(F.col("payload"))).filter("v is not null")
    return rows.withColumn("rec", F.try_variant_get("v", f"$.{key}", "string")).drop("payload")


def fields(records: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``parsed`` records and ``parent``, ``field``, ``kind``, ``text`` of each field of each record: top-level ones, and as fields of
    their parent the members of objects. ``text`` is equal for equal values of one kind only."""
    spark = records.sparkSession
    top = records.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).filter("key is not null").select(*columns, F.col("key").alias("k1"), F.col("value").alias("v1"), F.to_json("value").alias("t1"))
    both = top.withColumn("o", F.when(F.col("t1").startswith("{"), F.col("v1")))
    inner = both.lateralJoin(spark.tvf.variant_explode_outer(F.col("o").outer())).select(*columns, "k1", kind_of(F.col("v1"), F.col("t1")).alias("n1"), "t1", F.col("pos").alias("at"), F.col("key").alias("k2"), F.col("value").alias("v2"), F.to_json("value").alias("t2"))
    own = F.when(F.col("at").isNull() | (F.col("at") == 0), F.col("k1"))
    told = F.array(F.struct(F.lit("").alias("parent"), own.alias("field"), F.col("n1").alias("kind"), F.col("t1").alias("text")), F.struct(F.col("k1").alias("parent"), F.col("k2").alias("field"), kind_of(F.col("v2"), F.col("t2")).alias("kind"), F.col("t2").alias("text")))
    return inner.select(*columns, F.inline(told)).filter("field is not null")


def profiles(records: DataFrame, key: str = "functionName") -> DataFrame:
    """One row per (file, parent, field): ``n``, ``n_values``, ``kinds`` (sorted), ``sketch``: for each of ``SKETCH`` buckets of
    record keys the least key with its value, 32 bits of the hash of either in one number. Everything is a fixed number of
    longs, so partial profiles merge in hash maps."""
    h, value = F.xxhash64("rec"), F.xxhash64("kind", "text")
    entry = F.shiftleft(F.shiftright(h, 32), 32).bitwiseOR(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    told = F.when(F.col("kind").isNotNull() & F.col("rec").isNotNull(), entry)
    rows = fields(parsed(records, key), ["seq_name", "file_id", "written_us", "rec"]).select("seq_name", "file_id", "written_us", "parent", "field", F.expr("shiftleft(1L, kind)").alias("bit"), F.pmod(h, F.lit(SKETCH)).alias("bucket"), told.alias("entry"))
    least = [F.min(F.when(F.col("bucket") == i, F.col("entry"))).alias(f"s{i}") for i in range(SKETCH)]
    merged = rows.groupBy("seq_name", "file_id", "written_us", "parent", "field").agg(F.count(F.lit(1)).alias("n"), F.count("bit").alias("n_values"), F.coalesce(F.bit_or("bit"), F.lit(0)).alias("mask"), *least)
    kinds = F.array_sort(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(KINDS)])))
    return merged.select("seq_name", "file_id", "written_us", "parent", "field", "n", "n_values", kinds.alias("kinds"), F.array(*[f"s{i}" for i in range(SKETCH)]).alias("sketch"))


def wanted_values(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``file_id``, ``parent``, ``field``, ``rec``, ``value`` of the fields in ``wanted`` (``file_id``, ``wanted``: their parents
    and names); records without a key and null values are left out."""
    asked = parsed(records.join(wanted, "file_id"), key).filter("rec is not null")
    rows = fields(asked, ["file_id", "rec", "wanted"]).filter("kind is not null").filter(F.array_contains("wanted", F.struct("parent", "field")))
    return rows.select("file_id", "parent", "field", "rec", F.concat_ws(":", "kind", "text").alias("value"))


def file_pairs(rows: DataFrame) -> DataFrame:
    """Consecutive files of a sequence: ``file_a`` before ``file_b``. Equal times are told apart by the file's number."""
    files = rows.select("seq_name", "file_id", "written_us").distinct()
    w = Window.partitionBy("seq_name").orderBy("written_us", "file_id")
    pairs = files.select("seq_name", F.lag("file_id").over(w).alias("file_a"), F.col("file_id").alias("file_b"), F.row_number().over(w).alias("file_no"))
    return pairs.filter("file_a is not null")


def likeness(a: str, b: str) -> float:
    """Likeness of two names from 0 to 1, without regard to case and underscores."""
    x, y = (s.lower().replace("_", "") for s in (a, b))
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def best_assignment(edges: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """Assignment of greatest weight among (going name, coming name, records in common).

    As many records as possible, then names as alike as possible; the Hungarian method with potentials on the
    bipartite graph, where a missing edge weighs nothing. Names are taken in order, so ties have one result.
    """
    rows, cols = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    weight = {(a, b): n + 0.5 * likeness(a, b) for a, b, n in edges}
    n, m = len(rows), max(len(rows), len(cols))
    cost = [[-weight.get((rows[i], cols[j]), 0.0) if j < len(cols) else 0.0 for j in range(m)] for i in range(n)]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((rows[match[j] - 1], cols[j - 1]) for j in range(1, m + 1) if match[j] and j <= len(cols) and (rows[match[j] - 1], cols[j - 1]) in weight)


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for seq, file_b, parent, edges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            out += [(seq, file_b, parent, a, b) for a, b in best_assignment([(e["going"], e["coming"], e["n"]) for e in edges])]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["seq_name", "file_b", "parent", "going", "coming"])


def _changes(records: DataFrame, profile: DataFrame, pairs: DataFrame, key_name: str) -> DataFrame:
    """Changes of the given (seq_name, file_a, file_b, parent) pairs: seq_name, file_b, parent, kind, going, coming."""
    side = lambda tag: profile.select(F.col("seq_name"), F.col("file_id").alias(f"file_{tag}"), F.col("parent"), F.col("field"), F.col("kinds").alias(f"kinds_{tag}"), F.col("sketch").alias(f"sketch_{tag}"))
    a = pairs.join(side("a"), ["seq_name", "file_a", "parent"])
    b = pairs.join(side("b"), ["seq_name", "file_b", "parent"])
    key = ["seq_name", "file_a", "file_b", "parent"]
    met = a.join(b, [*key, "field"], "full")
    met = stored(met.filter("kinds_a is null or kinds_b is null or kinds_a <> kinds_b"))
    kept = met.filter("kinds_a is not null and kinds_b is not null")
    retyped = kept.filter((F.size("kinds_a") > 0) & (F.size("kinds_b") > 0)).select("seq_name", "file_b", "parent", F.lit("retyped").alias("kind"), F.col("field").alias("going"), F.lit(None).cast("string").alias("coming"))
    going = met.filter("kinds_b is null").select(*key, F.col("field").alias("going"), "sketch_a", "kinds_a")
    coming = met.filter("kinds_a is null").select(*key, F.col("field").alias("coming"), "sketch_b", "kinds_b")
    # Fields of a rename have a kind of value in common, so they meet by equality of kinds. Buckets with the same record on both
    # sides and another value speak against it; a single one could be two records whose 32 bits agree, and is checked below.
    by_kind = lambda side, k, s: side.select(*key, k, F.col(s), F.explode(f"kinds_{s[-1]}").alias("kind"))
    met_ab = by_kind(going, "going", "sketch_a").join(by_kind(coming, "coming", "sketch_b"), [*key, "kind"]).dropDuplicates([*key, "going", "coming"])
    record = lambda x: F.shiftright(x, 32)
    clash = F.filter(F.arrays_zip("sketch_a", "sketch_b"), lambda z: (record(z["sketch_a"]) == record(z["sketch_b"])) & (z["sketch_a"] != z["sketch_b"]))
    may = stored(met_ab.filter(F.size(clash) <= 1).select(*key, "going", "coming"))
    asked = may.select(F.col("file_a").alias("file_id"), "parent", F.col("going").alias("field")).unionByName(may.select(F.col("file_b").alias("file_id"), "parent", F.col("coming").alias("field")))
    wanted = asked.groupBy("file_id").agg(F.collect_set(F.struct("parent", "field")).alias("wanted"))  # the few changed fields of a file
    values = wanted_values(records, wanted, key_name)
    each = stored(values.groupBy("file_id", "parent", "field", "rec").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    one = lambda tag, name: each.select(F.col("file_id").alias(f"file_{tag}"), "parent", F.col("field").alias(name), "rec", F.col("lo").alias(f"lo_{tag}"), F.col("hi").alias(f"hi_{tag}"))
    both = may.join(one("a", "going"), ["file_a", "parent", "going"]).join(one("b", "coming"), ["file_b", "parent", "coming", "rec"])
    edges = both.groupBy(*key, "going", "coming").agg(F.count(F.lit(1)).alias("n"), F.min((F.col("lo_a") == F.col("lo_b")) & (F.col("hi_a") == F.col("hi_b"))).alias("equal")).filter("equal")
    gathered = edges.groupBy("seq_name", "file_b", "parent").agg(F.collect_list(F.struct("going", "coming", "n")).alias("edges"))
    renamed = stored(gathered.mapInArrow(_assign, "seq_name string, file_b long, parent string, going string, coming string"))
    gone = going.join(renamed, ["seq_name", "file_b", "parent", "going"], "left_anti").select("seq_name", "file_b", "parent", F.lit("removed").alias("kind"), "going", F.lit(None).cast("string").alias("coming"))
    come = coming.join(renamed, ["seq_name", "file_b", "parent", "coming"], "left_anti").select("seq_name", "file_b", "parent", F.lit("added").alias("kind"), F.col("coming").alias("going"), F.lit(None).cast("string").alias("coming"))
    return retyped.unionByName(gone).unionByName(come).unionByName(renamed.select("seq_name", "file_b", "parent", F.lit("renamed").alias("kind"), "going", "coming"))


def aliases(renames: DataFrame, name: str = NESTED) -> DataFrame:
    """``seq_name``, ``alias``: every name that ``name`` bears in a sequence, by following renames either way in it.

    A sequence's distinct renames are a handful of names whatever its rows, so they are followed within one row.
    """
    links = renames.select("seq_name", "going", "coming").distinct()
    hops = stored(links.groupBy("seq_name").agg(F.collect_set(F.struct("going", "coming")).alias("hops")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, names = [], []
            for seq, edges in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                known, grown = {name}, True
                while grown:
                    more = ({e["coming"] for e in edges if e["going"] in known} | {e["going"] for e in edges if e["coming"] in known}) - known
                    known, grown = known | more, bool(more)
                seqs += [seq] * len(known - {name})
                names += sorted(known - {name})
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(names, pa.string())], ["seq_name", "alias"])

    return hops.mapInArrow(run, "seq_name string, alias string")


def schema_changes(raw: DataFrame, nested: str = NESTED, key: str = "functionName") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, stored records, stored profile). Changes: ``project_name``, ``file_id`` (the later file), ``change_kind``, ``field_name``, ``new_name``.

    A field is a top-level name in any valid payload of a file. ``added``, ``removed``; ``retyped``: the types of its
    non-null values differ (a field with nulls only has no type and is not retyped); ``renamed``: one goes, another comes,
    and all records (by ``key``) with values under both have equal ones, at least one of them. If a record key occurs more
    than once in a file, its least and greatest values have to be equal. Members of ``nested`` are fields
    ``Parent.member`` while it is an object in both files under one name. Payloads that are no valid JSON object count for
    nothing; a file without any valid payload is no file. Null sequences are one sequence of their own name ''.
    """
    records = stored_records(raw)
    profile = stored(profiles(records, key))
    pairs = stored(file_pairs(profile))
    plain = pairs.select("seq_name", "file_a", "file_b")
    # Members of every field that is an object in both files are compared along; those of ``nested`` are kept below.
    objects = profile.filter("parent = '' and kinds = array('object')").select("seq_name", "file_id", F.col("field").alias("parent"))
    still = plain.join(objects.withColumnRenamed("file_id", "file_a"), ["seq_name", "file_a"]).join(objects.withColumnRenamed("file_id", "file_b"), ["seq_name", "file_b", "parent"], "left_semi")
    asked = stored(plain.withColumn("parent", F.lit("")).unionByName(still.select("seq_name", "file_a", "file_b", "parent")))
    every = stored(_changes(records, profile, asked, key))
    seqs = pairs.select("seq_name").distinct().withColumn("alias", F.lit(nested))
    alias = aliases(every.filter("kind = 'renamed' and parent = ''"), nested).unionByName(seqs).distinct()
    inner = every.filter("parent <> ''").join(alias.withColumnRenamed("alias", "parent"), ["seq_name", "parent"], "left_semi").select(every.columns)
    both = every.filter("parent = ''").unionByName(inner)
    dotted = lambda c: F.when(F.col("parent") == "", F.col(c)).otherwise(F.concat_ws(".", "parent", c))
    return both.select(F.col("seq_name").alias("project_name"), F.col("file_b").alias("file_id"), F.col("kind").alias("change_kind"), dotted("going").alias("field_name"), F.when(F.col("coming").isNotNull(), dotted("coming")).otherwise("").alias("new_name")), records, profile


def canonical_names(changes: DataFrame, profile: DataFrame) -> DataFrame:
    """``project_name``, ``file_id``, ``field``, ``canonical``: the first name of each top-level field's chain of renames.

    The chain is followed file by file: a rename carries the canonical name on, any other arrival begins with its own.
    """
    files = profile.filter("parent = ''").select(F.col("seq_name").alias("project_name"), "file_id", "written_us", "field")
    events = changes.filter("change_kind = 'renamed' and not contains(field_name, '.')").select("project_name", "file_id", "field_name", "new_name")
    steps = files.groupBy("project_name", "file_id", "written_us").agg(F.collect_set("field").alias("fields"))
    moves = events.groupBy("project_name", "file_id").agg(F.collect_list(F.struct("field_name", "new_name")).alias("moves"))
    line = steps.join(moves, ["project_name", "file_id"], "left").groupBy("project_name").agg(F.sort_array(F.collect_list(F.struct("written_us", "file_id", "fields", "moves"))).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, line in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                now: dict[str, str] = {}
                for step in line:
                    moved = {m["new_name"]: now.get(m["field_name"], m["field_name"]) for m in step["moves"] or ()}
                    now = {f: moved.get(f, now.get(f, f)) for f in step["fields"]}
                    out += [(seq, step["file_id"], f, c) for f, c in sorted(now.items())]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.string()], strict=True)], ["project_name", "file_id", "field", "canonical"])

    return line.mapInArrow(run, "project_name string, file_id long, field string, canonical string")


def unified_records(raw: DataFrame, nested: str = NESTED, key: str = "functionName") -> DataFrame:
    """All records in one consistent table: each top-level field of each valid record under its canonical name, with its
    value as JSON text and the type that the column has over all files (integer and decimal give decimal, other mixtures
    string; null if no file has a value).

    Names and types come from changes and profiles; records are parsed once, and fields meet their column by one join.
    """
    changes, records, profile = schema_changes(raw, nested, key)
    names = stored(canonical_names(stored(changes), profile))
    top = profile.filter("parent = ''").select(F.col("seq_name").alias("project_name"), "file_id", "field", "kinds")
    kinds = names.join(top, ["project_name", "file_id", "field"]).select("canonical", F.explode("kinds").alias("k")).groupBy("canonical").agg(F.collect_set("k").alias("k"))
    kind = F.when(F.size("k") == 1, F.element_at("k", 1)).when(F.size(F.array_except("k", F.array(F.lit("integer"), F.lit("decimal")))) == 0, "decimal").otherwise("string")
    columns = names.join(kinds.select("canonical", kind.alias("column_type")), "canonical", "left")
    wanted = columns.select("file_id", F.col("field").alias("k"), "canonical", "column_type")
    top = parsed(records, key).lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("v").outer())).filter("key is not null").select("seq_name", "file_id", "rec", F.col("key").alias("k"), F.nullif(F.to_json("value"), F.lit("null")).alias("json_value"))
    return top.join(wanted, ["file_id", "k"]).select(F.col("seq_name").alias("project_name"), "file_id", F.col("rec").alias("function_name"), F.col("canonical").alias("column_name"), F.col("k").alias("field_name"), "column_type", "json_value")
