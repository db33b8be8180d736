"""Session factory and the shared working folder.

Nothing in the engine keeps state on one machine: intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a local folder is made.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "broadsheet", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for (AQE on, UTC, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if not os.environ.get("SPARK_REMOTE") and "spark.master" not in conf:
        b = b.master(f"local[{cpus}]")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else, with a local master only, a local one made once per application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share; a folder of the driver's machine would lose tables")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="broadsheet-")
    return _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.

    Unlike ``checkpoint()`` the table is columnar, so later reads fetch only the columns they need.
    """
    spark = df.sparkSession
    path = f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def working_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/broadsheet-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that were not written or collected by then are lost."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(working_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for few bytes with much work, which must not be fitted to their size: those of a shuffle, or four a core if that is less."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors, once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    # The driver serves this file to the executors for as long as the application runs.
    path = Path(tempfile.mkdtemp(prefix="broadsheet-"), "broadsheet_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, a Parquet file or folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
