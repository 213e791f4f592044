"""Tables of snapshots that appear whole or not at all.

A run writes its rows beside those of others, under its snapshot and a number of its own, and then adds one pointer
row, which is a single file and so there or not. Readers take the latest pointer of every snapshot and only the rows
of that run: a second run replaces the first for them, and a run that died leaves nothing that they see. `vacuum`
deletes what no pointer leads to. Rows must fit the schemas below: missing optional columns become null, unknown
columns and nulls where none may be raise. An empty table, or a folder without pointers, reads as empty.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import serve
from graphloom.session import drop_path
from graphloom.sources import parse as parsing

#: Columns by table; those with NOT NULL must hold values.
SCHEMAS = {
    "features": "id string NOT NULL, repo_id string NOT NULL, snapshot_id string NOT NULL, name string NOT NULL, description string, color string NOT NULL",
    "code_nodes": "id string NOT NULL, snapshot_id string NOT NULL, file_path string NOT NULL, node_type string NOT NULL, name string NOT NULL, language string NOT NULL, line_start int NOT NULL, line_end int NOT NULL, source_code string, docstring string, metadata string, feature_id string, is_entry_point boolean NOT NULL, is_dead_code boolean NOT NULL, description string, flow_order int",
    "code_edges": "id string NOT NULL, snapshot_id string NOT NULL, source_node_id string, target_node_id string, edge_type string NOT NULL, line_number int",
    # what the next analysis of the repository starts from
    "manifests": "snapshot_id string NOT NULL, path string NOT NULL, content_hash string NOT NULL",
    "links": "snapshot_id string NOT NULL, src string NOT NULL, dst string NOT NULL",
    "starts": "snapshot_id string NOT NULL, cluster string NOT NULL, node string NOT NULL",
    "reached": "snapshot_id string NOT NULL, cluster string NOT NULL, node string NOT NULL",
    "parsed": f"snapshot_id string NOT NULL, {parsing.SCHEMA}",
}
POINTER = "repo_id string, snapshot_id string, run_id string, committed_at timestamp"


def _fields(name: str) -> list[tuple[T.StructField, bool]]:
    """Fields of a table, and whether they must hold values."""
    made = T.StructType.fromDDL(SCHEMAS[name])
    return [(T.StructField(f.name, f.dataType), not f.nullable) for f in made.fields]


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """rows in the columns of a table; raises on unknown or missing columns, and when run on a null that may not be."""
    fields = _fields(name)
    unknown = set(rows.columns) - {f.name for f, _ in fields}
    missing = {f.name for f, must in fields if must} - set(rows.columns)
    if unknown or missing:
        raise ValueError(f"{name}: unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
    out = []
    for field, must in fields:
        value = F.col(field.name).cast(field.dataType) if field.name in rows.columns else F.lit(None).cast(field.dataType)
        out.append((F.coalesce(value, F.raise_error(F.lit(f"{name}.{field.name} is null")).cast(field.dataType)) if must else value).alias(field.name))
    return rows.select(*out)


class Run:
    """One run's tables; leaving the block commits them, an error leaves them unseen."""

    def __init__(self, spark: SparkSession, folder: str, repo_id: str, snapshot_id: str):
        self.spark, self.folder, self.repo_id, self.snapshot_id = spark, folder.rstrip("/"), repo_id, snapshot_id
        self.run_id = uuid.uuid4().hex

    def save(self, rows: DataFrame, name: str) -> None:
        """Writes rows of this snapshot; a column snapshot_id is added or replaced."""
        made = conformed(rows.withColumn("snapshot_id", F.lit(self.snapshot_id)), name)
        made.withColumn("run_id", F.lit(self.run_id)).write.mode("append").partitionBy("snapshot_id", "run_id").parquet(f"{self.folder}/{name}")

    def __enter__(self) -> Run:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            row = [(self.repo_id, self.snapshot_id, self.run_id, datetime.now(UTC).replace(tzinfo=None))]
            self.spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def pointers(spark: SparkSession, folder: str) -> DataFrame:
    """The latest pointer of every snapshot."""
    path = f"{folder.rstrip('/')}/pointers"
    rows = spark.read.schema(POINTER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], POINTER)
    best = rows.groupBy("snapshot_id").agg(F.max_by(F.struct("repo_id", "run_id", "committed_at"), F.struct("committed_at", "run_id")).alias("p"))
    return best.select("p.repo_id", "snapshot_id", "p.run_id", "p.committed_at")


def load(spark: SparkSession, folder: str, name: str, snapshot_id: str | None = None) -> DataFrame:
    """Committed rows of a table, of one snapshot or of all. Only the partitions of committed runs are read."""
    path = f"{folder.rstrip('/')}/{name}"
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([f for f, _ in _fields(name)]))
    schema = T.StructType([*[f for f, _ in _fields(name)], T.StructField("run_id", T.StringType())])
    rows, held = spark.read.schema(schema).parquet(path), pointers(spark, folder)
    if snapshot_id is not None:
        run = held.where(F.col("snapshot_id") == snapshot_id).first()
        rows = rows.where((F.col("snapshot_id") == snapshot_id) & (F.col("run_id") == (run["run_id"] if run else "")))
    else:
        rows = rows.join(held.select("snapshot_id", "run_id"), ["snapshot_id", "run_id"], "left_semi")
    return rows.select(*[f.name for f, _ in _fields(name)])


def latest(spark: SparkSession, folder: str, repo_id: str) -> str | None:
    """The snapshot of a repository that was committed last."""
    found = serve.latest(pointers(spark, folder).where(F.col("repo_id") == repo_id), ["repo_id"], ["committed_at", "snapshot_id"]).first()
    return found["snapshot_id"] if found else None


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes the rows of runs that no pointer leads to, and returns how many there were. Not while runs write."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    gone = 0
    for name in SCHEMAS:
        path = f"{folder.rstrip('/')}/{name}"
        if _exists(spark, path):
            runs = spark.read.schema("snapshot_id string, run_id string").parquet(path).select("snapshot_id", "run_id").distinct()
            for r in runs.join(pointers(spark, folder), ["snapshot_id", "run_id"], "left_anti").collect():  # one row a dead run
                drop_path(spark, f"{path}/snapshot_id={escape(r['snapshot_id'])}/run_id={r['run_id']}")
                gone += 1
    return gone
