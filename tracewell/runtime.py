"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: the session's ``spark.checkpoint.dir``, one of our own only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracewell-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and forget how it was made.

    A checkpoint keeps what is known of its rows (partitioning, constraints); in loops the constraints multiply with each
    round, so loops take ``stored`` tables.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a columnar, prunable lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    """Null-safe equality over column pairs of two frames."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def ship(spark: SparkSession) -> None:
    """Make this package importable in the session's Python workers, once a session, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewell_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tracewell-py-")) / "tracewell_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._tracewell_shipped = True
