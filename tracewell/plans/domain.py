"""Domain views over the driver's tables, each with the SQL of the same view for the oracle.

``fn`` functions, ``ed`` call edges, ``hs`` harnesses, ``cl`` line coverage per harness, ``ct`` call trees are embedded in
the star schema; ``ff`` function facts, ``cs`` call sites, ``ps``/``db`` daily rows come from the project's own tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import latest_by


class Tables:
    """Views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def fn(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        return self.raw("part").select(
            k.alias("k"), F.concat(F.lit("fn_"), k).alias("name"), F.concat(F.lit("/src/"), "p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".c")).alias("file"),
            (size * 10).cast("long").alias("b"), (size * 10 + k % 40).cast("long").alias("e"), (k % 4).alias("argc"), (1 + size % 17).cast("long").alias("cc"), size.cast("long").alias("bb"), F.floor("p_retailprice").alias("ic"),
        )

    @property
    def ed(self) -> DataFrame:
        p = self.raw("part").select(F.col("p_partkey").alias("src"))
        to = F.array(F.floor(F.col("src") / 3), F.floor(F.col("src") / 5), F.when(F.col("src") < 4, F.col("src") * 3 + 1))
        return p.select("src", F.explode(to).alias("dst")).filter("dst is not null and src <> dst").distinct()

    @property
    def hs(self) -> DataFrame:
        top = self.raw("part").agg(F.max("p_partkey").alias("top"))
        return self.raw("supplier").crossJoin(F.broadcast(top)).select(F.col("s_suppkey").alias("h"), (F.col("top") - 7 * F.col("s_suppkey")).alias("entry"))  # one row

    @property
    def cl(self) -> DataFrame:
        hit = F.when(F.col("l_linenumber") <= F.col("l_partkey") % 8, F.floor("l_quantity")).otherwise(0)
        line = (F.col("l_linenumber") * 10 + F.floor("l_quantity") % 10).cast("long")
        return self.raw("lineitem").groupBy(F.col("l_suppkey").alias("h"), F.col("l_partkey").alias("k"), line.alias("line")).agg(F.sum(hit).alias("hits"))

    @property
    def ct(self) -> DataFrame:
        w = Window.partitionBy("h").orderBy("event_id")
        n = self.raw("supplier").agg(F.count(F.lit(1)).alias("harnesses"))
        rows = self.raw("events").crossJoin(F.broadcast(n)).select(F.pmod("user_id", "harnesses").alias("h"), "event_id", "value", "event_type").withColumn("idx", F.row_number().over(w).cast("long") - 1)
        shape = F.array(*[F.lit(x) for x in (1, 2, 3, 3, 2, 1, 2, 3)])
        depth = F.when(F.col("idx") == 0, 0).otherwise(F.element_at(shape, F.pmod(F.col("idx") - 1, F.lit(8)).cast("int") + 1)).cast("long")
        return rows.select("h", "idx", depth.alias("depth"), F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("long").alias("hits"), (F.col("event_id") % 97).alias("k"), (F.floor("value") % 50).cast("long").alias("line"))

    @property
    def ff(self) -> DataFrame:
        cols = [c for c in self.raw("function_facts").columns if c not in ("project_name", "function_name", "load_ts")]
        return latest_by(self.raw("function_facts"), ["project_name", "function_name"], "load_ts", cols)

    @property
    def af(self) -> DataFrame:
        """Functions of all snapshots, of each key the latest delivery."""
        keys = ["project_name", "snap_date", "function_name", "function_source_file"]
        rows = self.raw("all_functions_db")
        return latest_by(rows, keys, "load_ts", [c for c in rows.columns if c not in (*keys, "load_ts")])

    @property
    def cs(self) -> DataFrame:
        sites = latest_by(self.raw("callsites"), ["site_id"], "load_ts", ["project_name", "src_func", "site_src", "site_dst"])
        place = lambda n, kind: F.regexp_extract("site_src", r"^(.*):(\d+),(\d+)$", n).cast(kind)
        return sites.withColumn("file", place(1, "string")).withColumn("line", F.expr(r"try_cast(regexp_extract(site_src, '^(.*):([0-9]+),([0-9]+)$', 2) as bigint)"))

    @property
    def ps(self) -> DataFrame:
        return latest_by(self.raw("project_snapshots"), ["project_name", "snap_date"], "load_ts", ["proj_lang", "coverage_data", "introspector_data", "fuzzer_count"])

    @property
    def db(self) -> DataFrame:
        cols = ["project_count", "fuzzer_count", "function_count", "function_coverage_estimate", "accummulated_lines_total", "accummulated_lines_covered"]
        return latest_by(self.raw("db_timestamps"), ["db_name", "snap_date"], "load_ts", cols)


VIEWS = {
    "fn": """fn as (select p_partkey k, concat('fn_', p_partkey) name, concat('/src/', p_brand, '/', replace(p_type, ' ', '_'), '.c') file,
        (p_size*10)::bigint b, (p_size*10 + p_partkey % 40)::bigint e, p_partkey % 4 argc, (1 + p_size % 17)::bigint cc, p_size::bigint bb, floor(p_retailprice)::bigint ic from part)""",
    "ed": """ed as (select distinct src, dst from (select p_partkey src, p_partkey // 3 dst from part union all select p_partkey, p_partkey // 5 from part
        union all select p_partkey, p_partkey * 3 + 1 from part where p_partkey < 4) where src <> dst)""",
    "hs": "hs as (select s_suppkey h, (select max(p_partkey) from part) - 7 * s_suppkey entry from supplier)",
    "cl": """cl as (select l_suppkey h, l_partkey k, (l_linenumber*10 + floor(l_quantity)::bigint % 10)::bigint line,
        sum(case when l_linenumber <= l_partkey % 8 then floor(l_quantity)::bigint else 0 end)::bigint hits from lineitem group by all)""",
    "ct": """ct0 as (select *, row_number() over (partition by h order by event_id) - 1 idx from (select user_id % (select count(*) from supplier) h, event_id, value, event_type from events)),
      ct as (select h, idx, (case when idx = 0 then 0 else [1,2,3,3,2,1,2,3][(idx - 1) % 8 + 1] end)::bigint depth,
        (case when event_type = 'error' then 0 else floor(value) end)::bigint hits, event_id % 97 k, (floor(value)::bigint % 50) line from ct0)""",
    "ff": "ff as (select * from function_facts qualify row_number() over (partition by project_name, function_name order by load_ts desc) = 1)",
    "af": "af as (select * from all_functions_db qualify row_number() over (partition by project_name, snap_date, function_name, function_source_file order by load_ts desc) = 1)",
    "cs": """cs as (select *, regexp_extract(site_src, '^(.*):([0-9]+),([0-9]+)$', 1) file, try_cast(regexp_extract(site_src, '^(.*):([0-9]+),([0-9]+)$', 2) as bigint) line
        from callsites qualify row_number() over (partition by site_id order by load_ts desc) = 1)""",
    "ps": "ps as (select * from project_snapshots qualify row_number() over (partition by project_name, snap_date order by load_ts desc) = 1)",
    "db": "db as (select * from db_timestamps qualify row_number() over (partition by db_name, snap_date order by load_ts desc) = 1)",
    "re": "re(src, dst) as (select src, dst from ed union select re.src, ed.dst from re join ed on ed.src = re.dst)",
    "hr": "hr(h, k) as (select h, entry from hs union select hr.h, ed.dst from hr join ed on ed.src = hr.k)",
    "cm": "cm as (select k, line, max(hits) hits from cl group by all)",
    "cf": "cf as (select k, count(*) n, count(*) filter (hits > 0) hit from cm group by k)",
    "hc": "hc as (select k, count(*) hc from hr group by k)",
}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views before it."""
    return "with recursive " + ",\n".join(VIEWS[n] for n in names.split()) + "\n" + body
