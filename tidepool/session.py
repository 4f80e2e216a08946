"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "tidepool", master: str | None = None, shared_dir: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on. On a cluster, pass nothing and let spark-submit decide.

    ``shared_dir`` is the folder for intermediate tables, as ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shared_dir:
        conf["spark.checkpoint.dir"] = shared_dir
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path of the driver."""
    context = spark.sparkContext
    if getattr(context, "_tidepool_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidepool-code-"), "tidepool.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.join("tidepool", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._tidepool_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster without the setting is an
    error, because a folder on one machine is lost with that machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="tidepool-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def stage_table(df: DataFrame, label: str, schema: StructType | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table cuts the lineage, survives lost executors, is computed once however often it is used,
    and gives the next join real size statistics and a plain scan below its shuffle, which is what
    adaptive execution needs to split a skewed join key. ``schema`` reads the columns back as other
    types with the same stored form. ``partition_by`` columns become folders.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def stage_csv(df: DataFrame, label: str) -> str:
    """Write ``df`` as header CSV files to the shared folder; returns their folder."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    _STAGED.append(path)
    return path


#: Staged tables of this driver that still exist.
_STAGED: list[str] = []


def drop_table(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; ``df`` is what ``stage_table`` returned."""
    files = df.inputFiles()
    folder = files[0].rsplit("/", 1)[0].rsplit("/", 1)[-1] if files else None
    for path in [p for p in _STAGED if p.rsplit("/", 1)[-1] == folder]:
        _STAGED.remove(path)
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are no longer in use: it does when the driver's memory is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staged(spark: SparkSession) -> int:
    """Delete the tables staged so far; results that still read them must have been written. Returns their number."""
    gone = 0
    while _STAGED:
        gone += _delete(spark, _STAGED.pop())
    return gone
