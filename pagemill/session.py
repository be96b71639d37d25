"""What a session needs: the package in Python workers, and tables in the shared folder between the steps of a job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that the package is in.
ROOT = Path(__file__).resolve().parents[1]


def is_local(spark: SparkSession) -> bool:
    """Whether driver and workers are one machine."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


#: Bytes from which a worker's free memory goes back to the system, where its arrays begin to be mapped and at the heap's end: workers live
#: through many stages, and what one leaves in the heap would be missing in the next.
_MALLOC = {"MALLOC_MMAP_THRESHOLD_": 8 << 20, "MALLOC_TRIM_THRESHOLD_": 32 << 20}
#: Bytes of an Arrow batch, where the session says nothing else: texts are long, and each task holds some batches on both sides.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: on a cluster Spark sends it to them once a session, compiled. Bounds what workers hold."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
    context = spark.sparkContext
    for name, size in _MALLOC.items():
        context.environment.setdefault(name, str(size))
    if is_local(spark):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(ROOT) not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    elif not any(Path(f).name == "pagemill.zip" for f in context._python_includes):
        archive = os.path.join(tempfile.mkdtemp(), "pagemill.zip")
        with zipfile.PyZipFile(archive, "w") as z:
            z.writepy(str(ROOT / "pagemill"))
        context.addPyFile(archive)


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "checkpoints").as_uri()
    return f"{base.rstrip('/')}/pagemill-{spark.sparkContext.applicationId}"


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, in the application's own folder; a local session may leave that unset."""
    return f"{_base(spark)}{_scratch.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes inside go to one folder, which is deleted at the end. What is to stay is written elsewhere by then."""
    before = _scratch.get()
    mark = _scratch.set(f"{before}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, f"{_base(spark)}{_scratch.get()}")
        _scratch.reset(mark)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is in it, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and returns what was written: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> None:
    """Deletes all that stored() has written in this application. Results that are not written out by then are lost."""
    delete(spark, _base(spark))
