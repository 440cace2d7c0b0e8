"""Session helpers: shipping the package, the shared folder, cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="redactory-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. It is set here only where it is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (context := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return str(context.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join("/tmp/checkpoints", str(os.getpid()))
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(own)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a table for each core, below which it is dealt out before it is read by costly tasks.
BYTES_PER_CORE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: it may be a single row group, which only one task reads. Others are as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, from their listing
    return df.repartition(cores) if size < BYTES_PER_CORE * cores else df


#: Narrow rows of a file in the shared folder.
ROWS_PER_FILE = 200_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing.

    rows: how many narrow rows there are at most, where that is known; they are then written in no more files than they need.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(-(-max(rows, 1) // ROWS_PER_FILE))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path  # for forget()
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for some tables, once nothing will read them again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; one that isn't there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
