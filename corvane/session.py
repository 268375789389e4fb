"""Session defaults and the few cluster facts that operators need."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("corvane")
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run and whatever the driver's working directory.

    The package is code of a fixed small size; it is shipped once for each Spark context.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corvane")) / "corvane.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._corvane_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a folder of our own serves a session on one machine; on a cluster it is an error, as every executor
    would write to a disk of its own.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(sc, "_corvane_dir", None)
        if not where:
            where = sc._corvane_dir = f"file://{tempfile.mkdtemp(prefix='corvane-shared-')}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def small_rows(df: DataFrame, what: str, most: int = 10_000) -> list[Row]:
    """All rows of a control table on the driver; a table of more than ``most`` rows is an error, none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} may have {most} rows at most")
    return rows


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def cpu_count() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
