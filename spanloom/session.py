"""What a Spark session needs for the library: code on the executors, a shared folder, stored tables and their end.

Stored tables are scratch: scratch() deletes those that were made within it, clean() all of the session, and the end of the Python process
what is left by then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_paths: list[str] = []
#: Rows of an Arrow batch on the way to Python, where the session has Spark's own default: rows hold whole texts, and a task holds a batch or two.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python, once for each application."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spanloom-code-")) / "spanloom.zip"  # served to the executors by the driver
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local[...] session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for data that clean() may delete."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_at_exit)
    _paths.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read from there: computed once, whatever executors are lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _paths:
            _paths.remove(path)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Deletes what was stored (after the first `since` paths); frames that read it can't be used any more."""
    delete(spark, *_paths[since:])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end."""
    since = len(_paths)
    try:
        yield
    finally:
        clean(spark, since)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            clean(spark)
    except Exception:  # the JVM may be gone  # noqa: BLE001
        pass
