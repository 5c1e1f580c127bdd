"""Schema drift: planted changes, nulls, broken payloads and ambiguous renames."""

import json
from datetime import datetime

from tracewell.operators import drift as D

ROW = "file_id long, file_name string, project_name string, frontend string, written_at timestamp, record_no int, payload string, ingest_ts timestamp, seq_name string, parent int"


def files(spark, *specs, project="p"):
    """specs: lists of records (dict or raw text), one list a file."""
    rows = []
    for i, records in enumerate(specs):
        for n, r in enumerate(records):
            rows.append((100 - i, "x", project, "c", datetime(2025, 1, 1 + i), n, r if isinstance(r, str) or r is None else json.dumps(r), datetime(2025, 2, 1), "clash", 1))
    return spark.createDataFrame(rows, ROW)


def found(df):
    return {tuple(r) for r in D.schema_changes(df)[0].select("file_id", "change_kind", "field_name", "new_name").collect()}


def rec(name, **kw):
    return {"functionName": name, **kw}


def test_kinds_of_change(spark):
    df = files(
        spark,
        [rec("f", a=1, b="x", c=[1], d=1), rec("g", a=2, b="y", c=[2], d=2), '{"functionName": "h", "z"'],
        [rec("g", a="2", bb="y", c=[2], e=5.0, d=None), rec("f", a="1", bb="x", c=None, e=1.5)],
    )
    assert found(df) == {(99, "retyped", "a", ""), (99, "renamed", "b", "bb"), (99, "added", "e", "")}


def test_rename_needs_equal_values_in_all_records(spark):
    df = files(spark, [rec("f", a=1), rec("g", a=2), rec("h", a=3)], [rec("f", b=1), rec("g", b=7), rec("h", b=None)])
    assert found(df) == {(99, "removed", "a", ""), (99, "added", "b", "")}
    df = files(spark, [rec("f", a=1), rec("g", a=None)], [rec("f", b=1), rec("g", b=7)])
    assert found(df) == {(99, "renamed", "a", "b")}


def test_number_kinds(spark):
    df = files(spark, [rec("f", a=1, b=True, c=1)], [rec("f", a=1.0, b=1, c=2)])
    assert found(df) == {(99, "retyped", "a", ""), (99, "retyped", "b", "")}


def test_members_of_the_nested_field(spark):
    one = rec("f", JavaMethodInfo={"x": 1, "y": True, "w": 5}, other={"m": 1})
    two = rec("f", JavaMethodInfo={"x": "1", "y": True, "v": 5}, other={"n": 2})
    three = rec("f", jmi={"v": 5, "x": "1", "y": True}, other={"n": 2})
    four = rec("f", jmi={"x": "1", "v": 5}, other={"n": 2})
    assert found(files(spark, [one], [two], [three], [four])) == {
        (99, "retyped", "JavaMethodInfo.x", ""), (99, "renamed", "JavaMethodInfo.w", "JavaMethodInfo.v"), (98, "renamed", "JavaMethodInfo", "jmi"), (97, "removed", "jmi.y", "")}


def test_ambiguous_renames_are_assigned(spark):
    df = files(spark, [rec("f", count=1, size=1), rec("g", count=1, size=1)], [rec("f", counts=1, the_size=1), rec("g", counts=1, the_size=1)])
    assert found(df) == {(99, "renamed", "count", "counts"), (99, "renamed", "size", "the_size")}


def test_assignment_is_the_best_one():
    import itertools
    import random

    rnd = random.Random(1)
    for _ in range(60):
        edges = [(f"a{i}", f"b{j}", rnd.randrange(1, 6)) for i in range(4) for j in range(5) if rnd.random() < 0.5]
        weight = {(a, b): n + 0.5 * D.likeness(a, b) for a, b, n in edges}
        got = D.best_assignment(edges)
        assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
        best = 0.0
        for cols in itertools.permutations(range(5), 4):
            best = max(best, sum(weight.get((f"a{i}", f"b{c}"), 0.0) for i, c in enumerate(cols)))
        assert abs(sum(weight[x] for x in got) - best) < 1e-9


def test_dirty_payloads(spark):
    bad = ["[1, 2]", "null", "", None, '{"a": NaN}', '{"a": 1', "7", '"text"']
    df = files(spark, [rec("f", a=1), *bad], [rec("f", a=2), *bad], bad, [rec("f", a=3), {"a": 4}, rec(None, a=5), rec("f", a=3)])
    assert found(df) == set()
    assert found(files(spark)) == set()
    assert found(files(spark, bad)) == set()


def test_latest_delivery_holds_and_null_sequence(spark):
    late = datetime(2025, 3, 1)
    df = files(spark, [rec("f", a=1)], [rec("f", b="old")], project=None)
    more = spark.createDataFrame([(99, "x", None, "c", datetime(2025, 1, 2), 0, json.dumps(rec("f", a=5)), late, "clash", 1)], ROW)
    assert found(df.unionByName(more)) == set()


def test_canonical_names_follow_renames(spark):
    df = files(spark, [rec("f", a=1)], [rec("f", b=1)], [rec("f", c=1)], [rec("f", a="z", c=1)])
    changes, _, profile = D.schema_changes(df)
    got = {(r["file_id"], r["field"]): r["canonical"] for r in D.canonical_names(changes, profile).collect()}
    assert got[(98, "c")] == "a" and got[(99, "b")] == "a" and got[(97, "c")] == "a"


def test_unified_table(spark):
    df = files(spark, [rec("f", a=1, n=None), rec("g", a=2)], [rec("f", b=1), "{broken"], [rec("f", b=1.5), {"x": [1]}])
    got = sorted((r["file_id"], r["function_name"] or "", r["column_name"], r["column_type"], r["json_value"]) for r in D.unified_records(df).collect() if r["column_name"] != "functionName")
    assert got == [(98, "", "x", "array", "[1]"), (98, "f", "a", "decimal", "1.5"), (99, "f", "a", "decimal", "1"), (100, "f", "a", "decimal", "1"), (100, "f", "n", None, None), (100, "g", "a", "decimal", "2")]


def test_very_long_value_and_odd_names(spark):
    long = "x" * 300_000
    assert found(files(spark, [rec("f", a=long, **{"ü.b": 1})], [rec("f", z=long, **{"ü.b": 1})])) == {(99, "renamed", "a", "z")}
