"""Entry points: contract, agreement with SQL on the smallest tables, and import without the text package."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import compare

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 6):
        assert f"p{n}_found" in entry.queries()


def test_import_without_texts():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('tracewell.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import importlib.util as u\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith('tracewell.llm') else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert 'p1_found' in e.queries() and 'p6_found' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


FEW = "p2_found p4_found p5_found p5_per_name g4_calltree_parents a7_hit_summary a11_side_complexity j6_asof_site w5_forward_reds t1_blocker_order h3_unique_callees p1_hierarchy p1_descendants p3_found w1_outage_filter g17_type_chain j3_function_keys j5_branch_coverage j20_texts_that_call s4_coverage_lines s4_coverage_branches s6_go_functions s7_jacoco s9_debug_texts s16_build_status k1_summary_sections x1_texts u7_command_types".split()


@pytest.mark.parametrize("name", FEW)
def test_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(cols, res.fetchall())


def test_analyses(spark, sf):
    from tracewell.plans import composed
    from tracewell.plans.domain import Tables

    assert composed.run_analysis(Tables(spark, sf), "third_party_calls").count() > 0
    with pytest.raises(KeyError):
        composed.run_analysis(Tables(spark, sf), "nothing")
