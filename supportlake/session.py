"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("supportlake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The package's own setting, used where the cluster names no checkpoint folder.
FOLDER_SETTING = "spark.supportlake.shared.dir"


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    ``folder`` (or the package's own setting) is used where the session names none. Without either, a local
    session gets a temporary folder; on a cluster that is an error, because executors do not share local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or folder or spark.conf.get(FOLDER_SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise RuntimeError(f"set spark.checkpoint.dir (or {FOLDER_SETTING}) to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="supportlake-")
        spark.conf.set(FOLDER_SETTING, named)
    return named.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/supportlake-{spark.sparkContext.applicationId}"


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, inside the folder of this application."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_run_dirs(spark: SparkSession) -> None:
    """Deletes what this application stored. Results that still read stored tables are no longer valid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: With this, Spark deletes what a query shuffled at its end; else that stays on disk until the driver happens to collect its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: cuts lineage, survives lost executors. What was shuffled for it goes once it is written."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


#: With at most this many open files in a task, Spark writes rows as they come instead of sorting them by file first.
WRITERS_SETTING, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", "4"


def bucketed(df: DataFrame, key: str, name: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write a frame once as a table in buckets of ``key``, as many as there are shuffle partitions.

    Tables with the same buckets are joined by the key without a shuffle. ``finish`` adds columns that follow from the others and
    need not be moved: it is applied where the rows of a bucket lie. A task writes one bucket, so its rows are not sorted, whatever
    their width. The table is external, in the folder of this application.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(n, key)
    rows = rows if finish is None else finish(rows)
    before = spark.conf.get(WRITERS_SETTING)
    spark.conf.set(WRITERS_SETTING, WRITERS)
    try:
        rows.write.bucketBy(n, key).option("path", run_dir(spark, name)).format("parquet").saveAsTable(table)
    finally:
        spark.conf.set(WRITERS_SETTING, before)
    return spark.table(table)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
