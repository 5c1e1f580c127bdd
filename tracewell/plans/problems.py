"""Queries of the general training-data problems and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import resolve_path
from ..operators import drift, rolling, skew, snapshots
from ..operators import hierarchy as tree
from ..runtime import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1 ------------------------------------------------------------------------------------------------------------------
def call_forest(spark: SparkSession, sf_dir: str, paths: bool = True) -> DataFrame:
    """Functions in the trees of their calls. Of a site delivered more than once the latest delivery holds."""
    facts = table(spark, sf_dir, "function_facts").select(F.col("project_name").alias("ns"), F.col("function_name").alias("node"))
    sites = table(spark, sf_dir, "callsites").groupBy("site_id").agg(F.max(F.struct("load_ts", "project_name", "src_func", "site_dst")).alias("m"))
    links = sites.select(F.col("m.project_name").alias("ns"), F.col("m.src_func").alias("src"), F.col("m.site_dst").alias("dst"))
    return tree.hierarchy(facts, links, paths)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_forest(spark, sf_dir).filter("on_cycle").select(F.col("ns").alias("project_name"), F.col("node").alias("function_name"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = call_forest(spark, sf_dir)
    return rows.select(F.col("ns").alias("project_name"), F.col("node").alias("function_name"), F.col("root").alias("entry_function"), F.col("parent").alias("caller"), "depth", F.array_join("path", " > ").alias("full_path"), "descendants", "on_cycle", F.array_join("back_to", " | ").alias("back_to"))


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendant_pairs(call_forest(spark, sf_dir)).select(F.col("ns").alias("project_name"), F.col("ancestor").alias("function_name"), F.col("node").alias("function_below"), "distance")


# 2 ------------------------------------------------------------------------------------------------------------------
def _function_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "all_functions_db").select("project_name", "snap_date", "function_name", "function_source_file", "cyclomatic_complexity", "load_ts")
    # A date takes fewer bytes than its text in each shuffle.
    return rows.withColumn("function_source_file", resolve_path(F.col("function_source_file"))).withColumn("snap_date", F.try_to_date("snap_date", "yyyy-MM-dd"))


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


_P2 = ("project_name", "snap_date", ["function_name", "function_source_file"], ["cyclomatic_complexity"], "load_ts")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(_function_versions(spark, sf_dir), *_P2).withColumn("snap_date", _text("snap_date"))


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = snapshots.validity_intervals(_function_versions(spark, sf_dir), *_P2)
    return runs.select("project_name", "function_name", "function_source_file", _text("valid_from"), _text("valid_to"), (F.col("last_seq") - F.col("first_seq") + 1).alias("snapshots"), F.col("next_date").isNull().alias("still_valid"))


# 3 ------------------------------------------------------------------------------------------------------------------
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, _, _ = drift.schema_changes(table(spark, sf_dir, "raw_function_files"))
    return changes.select("file_id", "change_kind", "field_name", "new_name")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table under canonical names and types."""
    return drift.unified_records(table(spark, sf_dir, "raw_function_files"))


# 4 ------------------------------------------------------------------------------------------------------------------
def trailing_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = "coverage_data.line_coverage"
    projects = table(spark, sf_dir, "project_snapshots").select(F.lit("project").alias("series_kind"), F.col("project_name").alias("entity_name"), "snap_date", F.col(f"{cov}.percent").alias("value"), F.col(f"{cov}.covered").cast("double").alias("amount"), "load_ts")
    dbs = table(spark, sf_dir, "db_timestamps").select(F.lit("database").alias("series_kind"), F.col("db_name").alias("entity_name"), "snap_date", F.col("function_coverage_estimate").alias("value"), F.col("project_count").cast("double").alias("amount"), "load_ts")
    days = rolling.daily_series(projects.unionByName(dbs), ["series_kind", "entity_name"], "snap_date", ["value", "amount"], "load_ts", "value")
    # Sums of decimals are exact, so a mean at a bound falls on the right side of it.
    exact = days.withColumns({c: F.col(c).cast("decimal(28,9)") for c in ("value", "amount")})
    return rolling.trailing_totals(exact, ["series_kind", "entity_name"], "snap_date", ["value", "amount"], [7, 30])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trailing_coverage(spark, sf_dir)
    low = F.col("sum_value_7") * F.col("n_value_30") + F.lit(5) * F.col("n_value_7") * F.col("n_value_30") <= F.col("sum_value_30") * F.col("n_value_7")
    return rows.filter((F.col("n_value_7") > 0) & low).select("series_kind", "entity_name", F.date_format("snap_date", "yyyy-MM-dd").alias("snap_date"))


def p4_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trailing_coverage(spark, sf_dir)
    out = [F.date_format("snap_date", "yyyy-MM-dd").alias("snap_date")]
    for v, name in (("value", "coverage"), ("amount", "amount")):
        for n in (7, 30):
            total = F.col(f"sum_{v}_{n}").cast("double")
            out += [F.col(f"n_{v}_{n}").alias(f"{name}_days_{n}"), total.alias(f"{name}_total_{n}"), F.try_divide(total, F.col(f"n_{v}_{n}")).alias(f"{name}_mean_{n}")]
    return rows.select("series_kind", "entity_name", *out)


# 5 ------------------------------------------------------------------------------------------------------------------
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "all_functions_db")
    names = stored(skew.split_key_aggregate(rows, ["function_name"], ["project_name", "snap_date"]))
    total = names.agg(F.sum("n_rows").alias("total"))
    return names.crossJoin(F.broadcast(total)).filter("function_name is not null and n_rows * 50 >= total").select("function_name")  # one row


def p5_per_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "all_functions_db").select("function_name", "project_name", "snap_date", F.col("cyclomatic_complexity").cast("long").alias("cc"), F.col("i_count").cast("long").alias("ic"), "fuzzers_reaching")
    return skew.split_key_aggregate(rows, ["function_name"], ["project_name", "snap_date"], sums={"complexity_total": "cc", "instructions_total": "ic"}, lows={"first_date": "snap_date"}, highs={"last_date": "snap_date", "most_fuzzers": "fuzzers_reaching"}, runs={"n_projects": "project_name"})


def p5_per_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "db_timestamps").select("db_name", "snap_date", "function_count", "fuzzer_count")
    return skew.split_key_aggregate(rows, ["db_name"], ["snap_date"], sums={"functions_total": "function_count"}, lows={"first_date": "snap_date"}, highs={"last_date": "snap_date", "most_functions": "function_count"}, runs={"n_dates": "snap_date"})


def p5_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "db_timestamps").select("db_name", "snap_date", "function_count", "load_ts")
    return skew.split_key_running(rows, ["db_name"], ["snap_date", "load_ts", "function_count"], "function_count").drop("load_ts")


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_intervals, p3_found, p3_unified, p4_found, p4_trailing, p5_found, p5_per_name, p5_per_database, p5_running)}

_LINKS = """
n as (select distinct project_name, function_name from function_facts),
s as (select * from (select *, row_number() over (partition by site_id order by load_ts desc, src_func desc) k from callsites) where k = 1),
e as (select distinct s.project_name, s.src_func src, s.site_dst dst from s
      join n a on a.project_name = s.project_name and a.function_name = s.src_func
      join n b on b.project_name = s.project_name and b.function_name = s.site_dst),
r as (select project_name, src, dst from e union
      select r.project_name, r.src, e.dst from r join e on e.project_name = r.project_name and e.src = r.dst)"""

#: Parents by the rule of ``hierarchy``: parts are mutual reach, entered by their first link from outside, levels inside.
_FOREST = _LINKS + """,
m as (select a.project_name, a.src f, min(a.dst) part from r a join r b on b.project_name = a.project_name and b.src = a.dst and b.dst = a.src group by 1, 2),
pt as (select n.project_name, n.function_name f, coalesce(m.part, n.function_name) part, m.part is not null on_cycle from n left join m on m.project_name = n.project_name and m.f = n.function_name),
lp as (select e.project_name, e.src, e.dst, a.part ps, b.part pd from e join pt a on a.project_name = e.project_name and a.f = e.src join pt b on b.project_name = e.project_name and b.f = e.dst),
dr as (select project_name, pd part, min(struct_pack(s := src, d := dst)) x from lp where ps <> pd group by 1, 2),
en as (select q.project_name, q.part, q.size, coalesce(dr.x.d, q.part) entry, dr.x.s parent from (select project_name, part, count(*) size from pt group by 1, 2) q left join dr on dr.project_name = q.project_name and dr.part = q.part),
lv(project_name, part, f, lev, size) as (select project_name, part, entry, 0, size from en union
 select lv.project_name, lv.part, lp.dst, lv.lev + 1, lv.size from lv join lp on lp.project_name = lv.project_name and lp.src = lv.f and lp.ps = lv.part and lp.pd = lv.part where lv.lev < lv.size),
ml as (select project_name, f, min(lev) lev from lv group by 1, 2),
pa as (select project_name, entry f, parent from en union all
 select lp.project_name, lp.dst, min(lp.src) from lp join ml a on a.project_name = lp.project_name and a.f = lp.src join ml b on b.project_name = lp.project_name and b.f = lp.dst where lp.ps = lp.pd and a.lev = b.lev - 1 group by 1, 2),
w(project_name, f, root, depth, path) as (select project_name, f, f, 0, [f] from pa where parent is null union all
 select pa.project_name, pa.f, w.root, w.depth + 1, list_append(w.path, pa.f) from w join pa on pa.project_name = w.project_name and pa.parent = w.f),
an as (select project_name, f, depth, unnest(path) above, generate_subscripts(path, 1) - 1 lev from w)"""

#: Rows with resolved paths; each replacement takes one level of '..' out, and no path here has more than five.
_RESOLVED = """
v0 as (select *, regexp_replace(regexp_replace(function_source_file, '/(\\./)+', '/', 'g'), '/+', '/', 'g') p0 from all_functions_db),
v1 as (select *, regexp_replace(p0, '/[^/]+/\\.\\./', '/') p1 from v0),
v2 as (select *, regexp_replace(p1, '/[^/]+/\\.\\./', '/') p2 from v1),
v3 as (select *, regexp_replace(p2, '/[^/]+/\\.\\./', '/') p3a from v2),
v4 as (select *, regexp_replace(p3a, '/[^/]+/\\.\\./', '/') p4 from v3),
v5 as (select *, regexp_replace(p4, '/[^/]+/\\.\\./', '/') p3 from v4),
f as (select project_name, snap_date, function_name, p3 function_source_file, cyclomatic_complexity from v5
      qualify row_number() over (partition by project_name, snap_date, function_name, p3 order by load_ts desc) = 1),
d as (select project_name, snap_date, lead(snap_date) over w next_date, row_number() over w seq
      from (select distinct project_name, snap_date from all_functions_db) window w as (partition by project_name order by snap_date)),
g as (select f.*, d.seq, d.next_date from f join d using (project_name, snap_date))"""

_SERIES = """
x as (select 'project' series_kind, project_name entity_name, snap_date, coverage_data.line_coverage.percent v,
             coverage_data.line_coverage.covered::double a, load_ts from project_snapshots
      union all select 'database', db_name, snap_date, function_coverage_estimate, project_count::double, load_ts from db_timestamps),
y as (select series_kind, entity_name, snap_date::date d, v::decimal(28,9) v, a::decimal(28,9) a from x
      qualify row_number() over (partition by series_kind, entity_name, snap_date order by load_ts desc) = 1),
b as (select series_kind, entity_name, min(d) lo, max(d) hi from y where v is not null group by all),
c as (select series_kind, entity_name, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date d from b),
z as (select c.*, v, a from c left join y using (series_kind, entity_name, d)),
t as (select series_kind, entity_name, d,
        count(v) over s vn7, sum(v) over s vs7, count(v) over l vn30, sum(v) over l vs30,
        count(a) over s an7, sum(a) over s as7, count(a) over l an30, sum(a) over l as30
      from z window s as (partition by series_kind, entity_name order by d rows between 6 preceding and current row),
                    l as (partition by series_kind, entity_name order by d rows between 29 preceding and current row))"""

_MEANS = ", ".join(f"{c}n{n} {name}_days_{n}, {c}s{n}::double {name}_total_{n}, {c}s{n}::double / nullif({c}n{n}, 0) {name}_mean_{n}" for c, name in (("v", "coverage"), ("a", "amount")) for n in (7, 30))

#: Fields of the files of problem 3 with their kinds, values and renames; a rename is the only partner of both its names.
_DRIFT = """
x as (select project_name, file_id, written_at, payload from (select *, row_number() over (partition by project_name, file_id, written_at, record_no order by ingest_ts desc nulls last, payload desc nulls last) k from raw_function_files) where k = 1 and json_valid(payload) and json_type(payload) = 'OBJECT'),
v0 as (select project_name, file_id, written_at, json_extract_string(payload, '$.functionName') rec, payload, unnest(json_keys(payload)) field from x),
v1 as (select project_name, file_id, written_at, rec, '' parent, field, json_extract(payload, concat('$."', field, '"')) j from v0),
v2 as (select project_name, file_id, written_at, rec, field parent, j, unnest(json_keys(j)) field from v1 where json_type(j) = 'OBJECT'),
va as (select project_name, file_id, written_at, rec, parent, field, j from v1 union all select project_name, file_id, written_at, rec, parent, field, json_extract(j, concat('$."', field, '"')) from v2),
vk as (select *, case when json_type(j) in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'integer' when json_type(j) = 'DOUBLE' then 'decimal' when json_type(j) = 'NULL' then null else lower(json_type(j)) end kind from va),
pf as (select project_name, file_id, written_at, parent, field, list_sort(list_distinct(list(kind) filter (kind is not null))) kinds from vk group by all),
fs as (select project_name, file_id, lag(file_id) over (partition by project_name order by written_at, file_id) before_id from (select distinct project_name, file_id, written_at from pf)),
pr as (select project_name, before_id a, file_id b, '' parent from fs where before_id is not null
 union all select fs.project_name, before_id, fs.file_id, p.field from fs join pf p on p.file_id = before_id and p.parent = '' and p.kinds = ['object'] join pf q on q.file_id = fs.file_id and q.parent = '' and q.field = p.field and q.kinds = ['object']),
ga as (select pr.*, p.field, p.kinds from pr join pf p on p.file_id = pr.a and p.parent = pr.parent), gb as (select pr.*, p.field, p.kinds from pr join pf p on p.file_id = pr.b and p.parent = pr.parent),
ch as (select coalesce(ga.project_name, gb.project_name) project_name, coalesce(ga.a, gb.a) a, coalesce(ga.b, gb.b) b, coalesce(ga.parent, gb.parent) parent, ga.field fa, gb.field fb, ga.kinds ka, gb.kinds kb
 from ga full join gb on ga.a = gb.a and ga.b = gb.b and ga.parent = gb.parent and ga.field = gb.field),
gv as (select ch.*, v.rec, v.j::varchar t from ch join vk v on v.file_id = ch.a and v.parent = ch.parent and v.field = ch.fa and v.kind is not null where ch.fb is null),
cv as (select ch.*, v.rec, v.j::varchar t from ch join vk v on v.file_id = ch.b and v.parent = ch.parent and v.field = ch.fb and v.kind is not null where ch.fa is null),
rn as (select gv.project_name, gv.b, gv.parent, gv.fa, cv.fb from gv join cv on cv.a = gv.a and cv.b = gv.b and cv.parent = gv.parent and cv.rec = gv.rec group by all having bool_and(gv.t = cv.t)),
al(project_name, alias) as (select distinct project_name, 'JavaMethodInfo' from fs union select rn.project_name, case when al.alias = rn.fa then rn.fb else rn.fa end from al join rn on rn.project_name = al.project_name and rn.parent = '' and al.alias in (rn.fa, rn.fb)),
ev as (select project_name, b, parent, 'renamed' kind, fa f, fb g from rn
 union all select project_name, b, parent, 'retyped', fa, null from ch where fa is not null and fb is not null and ka <> kb and len(ka) > 0 and len(kb) > 0
 union all select project_name, b, parent, 'removed', fa, null from ch where fb is null and not exists (select 1 from rn where rn.b = ch.b and rn.parent = ch.parent and rn.fa = ch.fa)
 union all select project_name, b, parent, 'added', fb, null from ch where fa is null and not exists (select 1 from rn where rn.b = ch.b and rn.parent = ch.parent and rn.fb = ch.fb))"""

ORACLES = {
    "p3_found": f"""with recursive {_DRIFT} select b file_id, kind change_kind, case when parent = '' then f else concat(parent, '.', f) end field_name,
case when g is null then '' when parent = '' then g else concat(parent, '.', g) end new_name from ev where parent = '' or (project_name, parent) in (select (project_name, alias) from al)""",
    "p1_found": f"with recursive {_LINKS} select distinct project_name, src function_name from r where src = dst",
    "p1_hierarchy": f"""with recursive {_FOREST},
dn as (select project_name, above f, count(*) below from an where lev < depth group by 1, 2),
bk as (select e.project_name, e.src f, string_agg(e.dst, ' | ' order by e.dst) back_to from e join w on w.project_name = e.project_name and w.f = e.src where list_contains(w.path, e.dst) group by 1, 2)
select w.project_name, w.f function_name, w.root entry_function, pa.parent caller, w.depth::int depth, array_to_string(w.path, ' > ') full_path, coalesce(dn.below, 0)::bigint descendants, pt.on_cycle, coalesce(bk.back_to, '') back_to
from w join pa on pa.project_name = w.project_name and pa.f = w.f join pt on pt.project_name = w.project_name and pt.f = w.f left join dn on dn.project_name = w.project_name and dn.f = w.f left join bk on bk.project_name = w.project_name and bk.f = w.f""",
    "p1_descendants": f"with recursive {_FOREST} select project_name, above function_name, f function_below, (depth - lev)::int distance from an where lev < depth",
    "p2_found": f"""with {_RESOLVED}
select a.project_name, a.snap_date, a.function_name, a.function_source_file, 'added' change_kind from g a
where a.seq > 1 and not exists (select 1 from g b where b.project_name = a.project_name and b.function_name = a.function_name and b.function_source_file = a.function_source_file and b.seq = a.seq - 1)
union all select a.project_name, a.next_date, a.function_name, a.function_source_file, 'removed' from g a
where a.next_date is not null and not exists (select 1 from g b where b.project_name = a.project_name and b.function_name = a.function_name and b.function_source_file = a.function_source_file and b.seq = a.seq + 1)
union all select a.project_name, a.snap_date, a.function_name, a.function_source_file, 'changed' from g a
join g b on b.project_name = a.project_name and b.function_name = a.function_name and b.function_source_file = a.function_source_file and b.seq = a.seq - 1
where a.cyclomatic_complexity is distinct from b.cyclomatic_complexity""",
    "p2_intervals": f"""with {_RESOLVED},
o as (select *, case when lag(seq) over w = seq - 1 and lag(cyclomatic_complexity) over w is not distinct from cyclomatic_complexity then 0 else 1 end opens
      from g window w as (partition by project_name, function_name, function_source_file order by seq)),
i as (select *, sum(opens) over (partition by project_name, function_name, function_source_file order by seq) run from o)
select project_name, function_name, function_source_file, min(snap_date) valid_from, max(snap_date) valid_to, count(*)::int snapshots, bool_or(next_date is null) still_valid
from i group by project_name, function_name, function_source_file, run""",
    "p4_found": f"with {_SERIES} select series_kind, entity_name, strftime(d, '%Y-%m-%d') snap_date from t where vn7 > 0 and vs7 * vn30 + 5 * vn7 * vn30 <= vs30 * vn7",
    "p4_trailing": f"with {_SERIES} select series_kind, entity_name, strftime(d, '%Y-%m-%d') snap_date, {_MEANS} from t",
    "p5_found": "select function_name from all_functions_db where function_name is not null group by 1 having count(*) * 50 >= (select count(*) from all_functions_db)",
    "p5_per_name": """select function_name, count(*) n_rows, sum(cyclomatic_complexity)::bigint complexity_total, sum(i_count)::bigint instructions_total,
min(snap_date) first_date, max(snap_date) last_date, max(fuzzers_reaching) most_fuzzers, count(distinct project_name) n_projects from all_functions_db group by 1""",
    "p5_per_database": """select db_name, count(*) n_rows, sum(function_count)::bigint functions_total, min(snap_date) first_date, max(snap_date) last_date,
max(function_count) most_functions, count(distinct snap_date) n_dates from db_timestamps group by 1""",
    "p5_running": """select db_name, snap_date, function_count, count(*) over w row_rank, coalesce(sum(function_count) over w, 0)::bigint running_total from db_timestamps
window w as (partition by db_name order by snap_date, load_ts nulls first, function_count nulls first rows between unbounded preceding and current row)""",
}
