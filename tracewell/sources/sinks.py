"""Writers: JSON by key, CSV, append and upsert of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import upsert
from ..runtime import stored


def write_json_by(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON lines for each value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def merge_sections(sections: DataFrame) -> DataFrame:
    """``section``, ``key``, ``value`` (JSON) rows to one JSON object per section, keys in order, the last value of a key
    (by ``value``) kept."""
    one = sections.groupBy("section", "key").agg(F.max("value").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return one.groupBy("section").agg(pairs.alias("p")).select("section", F.concat(F.lit("{"), F.array_join(F.transform("p", lambda x: F.concat(F.lit('"'), x["key"], F.lit('": '), x["value"])), ", "), F.lit("}")).alias("json"))


def engine_input(rows: DataFrame) -> DataFrame:
    """``harness``, ``key``, ``values`` as one JSON object a harness, keys in order; empty lists have no section."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values"))))
    return rows.filter(F.size("values") > 0).groupBy("harness").agg(F.to_json(pairs).alias("json"))


def append_daily(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key is not stored yet; the first write of a day wins. Only new rows are written. They are settled
    before (see ``stored``), as the table must not be read while it is written to."""
    old = new.sparkSession.read.parquet(path)
    stored(new.join(old.select(*keys).distinct(), keys, "left_anti")).write.mode("append").parquet(path)


def _paths(spark, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> None:
    """New rows replace stored ones of the same key. The table is written beside the old one, which is moved aside before the
    new one takes its place and deleted last: at every moment the old or the new rows are whole under one of the names
    ``path``, ``path-old`` and ``path-new``. A table found under ``path-old`` alone is what a crash left and is put back."""
    spark = new.sparkSession
    path_of, fs = _paths(spark, path)
    target, aside, fresh = path_of(path), path_of(f"{path}-old"), path_of(f"{path}-new")
    if fs.exists(aside) and not fs.exists(target):
        fs.rename(aside, target)
    fs.delete(aside, True)
    fs.delete(fresh, True)
    upsert(spark.read.parquet(path), new, keys).write.parquet(f"{path}-new")
    fs.rename(target, aside)
    fs.rename(fresh, target)
    fs.delete(aside, True)
    spark.catalog.refreshByPath(path)
