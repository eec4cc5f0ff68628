"""Session settings that every query of this package relies on, and what is kept in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .errors import InvalidConfiguration

#: Set only where the session has no value of its own.
DEFAULTS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}
_BUILTIN = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "268435456"}


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, since a record may hold 16 MiB, and give workers this package."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, _BUILTIN[key], f"{_BUILTIN[key]}b"):
            spark.conf.set(key, value)
    _ship(spark)
    return spark


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` on workers that have this package, whatever directory the caller runs in."""
    tune(df.sparkSession)
    return df.mapInArrow(function, schema)


def _ship(spark: SparkSession) -> None:
    """Send the package's source to workers, which may not share the driver's Python path; once a session."""
    if getattr(spark.sparkContext, "_corpusloom_shipped", False):
        return
    root = Path(__file__).parent
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    if shared.startswith(("file:", "/")):
        folder = os.path.join("/" + shared.removeprefix("file:").lstrip("/"), f"corpusloom-{spark.sparkContext.applicationId}")
        os.makedirs(folder, exist_ok=True)
    else:  # the driver's own copy, from which Spark serves the executors
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    target = os.path.join(folder, "corpusloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._corpusloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder below the one that ``spark.checkpoint.dir`` names, deleted when the application ends.

    Where the setting is absent a temporary folder does on a single machine; on a cluster, whose executors don't share such a
    folder, that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise InvalidConfiguration("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    folder = context._jsc.sc().getCheckpointDir().get()
    if not getattr(context, "_corpusloom_folder", None):
        context._corpusloom_folder = folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: compressed, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that is no longer read."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/table-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
