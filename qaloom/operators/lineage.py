"""Cutting lineage so that iterative jobs survive lost executors.

Rows are written as a compressed table below the folder that
``spark.checkpoint.dir`` names, which all executors share, and read back: later
steps read only the columns they need, and lost tasks start from the files.  A
folder of our own is set only where none is configured, as in local tests.  What
was written goes with ``release``, the rest when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="qaloom-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def _delete(sc: SparkContext, folder: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None or sc.applicationId not in _ROOTS:
        return
    try:
        _delete(sc, _ROOTS[sc.applicationId])
    except Exception:  # the session is going down; what is left lies in the checkpoint folder
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    root = _ROOTS.setdefault(sc.applicationId, f"{sc._jsc.sc().getCheckpointDir().get()}/qaloom-{uuid.uuid4().hex}")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared checkpoint folder."""
    spark = df.sparkSession
    folder = scratch(spark, "cut")
    df.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    return out


def release(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for this frame; nothing may read it afterwards."""
    folder = getattr(df, "_cut_folder", None)
    if folder is not None:
        _delete(df.sparkSession.sparkContext, folder)
