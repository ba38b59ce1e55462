"""Reading of the test tables and materialisation of intermediate results."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import warnings
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and its executors are threads of this process (tests on one machine) a
    temporary folder is set.  On a cluster without the setting this is an error: each executor would write into
    a disk of its own, and the driver would read back a part.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return  # the session is gone: the folder belongs to the cluster's housekeeping
    try:
        hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
    except (Py4JError, OSError) as e:
        warnings.warn(f"{path} could not be deleted: {e}", stacklevel=2)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back.

    Cuts the lineage so that a lost executor costs a re-read and no recomputation,
    and keeps the columnar form, so later stages still prune columns.
    The files go by :func:`release`, with the :func:`scratch` around it unless ``keep``, at the latest when the driver
    process ends.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


@contextmanager
def scratch():
    """Releases at its end what was materialised inside, but for what was asked to be kept."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        release(*_SCRATCH.pop())


_SCRATCH: list[list[DataFrame]] = []


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def release(*written: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more; plans that still read them would fail."""
    for df in written:
        path = getattr(df, "_written_to", None)
        if path:
            _delete(df.sparkSession, path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, where its input has fewer splits than there are cores.

    For work that takes far longer than reading: a small input then costs one shuffle and
    uses the whole cluster, a large one stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
