"""Session helpers shared by every operator: tables, scratch folders, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SCRATCH = "/tmp/checkpoints"


def build_session(app: str = "graphloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; `conf` overrides by full key."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


#: Bounds of an Arrow batch, which both the JVM and Python hold whole: texts may be long. A session whose own
#: configuration names a bound keeps it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, and bounds Arrow batches (BATCH)."""
    context = spark.sparkContext
    own = context.getConf()
    for name, bound in BATCH.items():
        if not own.contains(name):
            spark.conf.set(name, bound)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="graphloom-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "graphloom.zip")
    with zipfile.ZipFile(path, "w") as pack:
        for file in sorted(root.rglob("*.py")):
            pack.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine one of our own will do."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or LOCAL_SCRATCH).rstrip("/")


_SCRATCH: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet. It goes when the driver's process ends."""
    if not _SCRATCH:
        atexit.register(forget_scratch)
    path = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def forget_scratch() -> None:
    """Deletes all scratch folders of this process; results that still read them can't be used any more."""
    while _TABLES:
        spark, name = _TABLES.pop()
        with contextlib.suppress(Exception):  # as below
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        with contextlib.suppress(Exception):  # a session that has stopped can't delete
            drop_path(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df without its lineage, as a table in the shared folder that goes with the other scratch (eager)."""
    return written(df, "cut")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back (eager, columnar, splittable)."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark then takes a bucket of one sorted file as sorted, which merges don't sort again.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def bucketed(df: DataFrame, label: str, key: str, apart: bool = True) -> DataFrame:
    """Writes df's rows to the shared folder as a table bucketed and sorted by key: joins on key don't shuffle or sort it again (eager).

    Rows are told apart, unless `apart` is false: equal ones are neighbours in their sorted bucket, so no shuffle and no
    table of rows in memory is needed. A session whose own configuration names SORTED_BUCKETS keeps it.
    """
    spark, name = df.sparkSession, f"graphloom_{label}_{uuid.uuid4().hex}"
    if not spark.sparkContext.getConf().contains(SORTED_BUCKETS):
        spark.conf.set(SORTED_BUCKETS, "true")
    parts, others = int(spark.conf.get("spark.sql.shuffle.partitions")), [c for c in df.columns if c != key]
    rows = df.repartition(parts, key)
    if apart:
        last = F.lag(F.struct(*others)).over(Window.partitionBy(key).orderBy(*others))
        rows = rows.withColumn("last_", last).where(~F.struct(*others).eqNullSafe(F.col("last_"))).drop("last_")
    rows.write.bucketBy(parts, key).sortBy(key, *(others if apart else ())).option("path", scratch(spark, label)).saveAsTable(name)
    _TABLES.append((spark, name))
    return spark.table(name)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
