"""The shared folder for intermediates."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_LOCAL_FALLBACK = "/tmp/emberlog-checkpoints"


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session (as in tests) may leave it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL_FALLBACK


#: Folders given inside each open :func:`scratch`, the innermost last.
_given: list[list[str]] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/emberlog-{name}-{uuid.uuid4().hex}"
    if _given:
        _given[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what :func:`fresh_dir` gave meanwhile.

    What is to last must be written elsewhere before.  After an error the
    folders stay, to be looked at.  For one thread of the driver at a time.
    """
    _given.append([])
    try:
        yield
    except BaseException:
        _given.pop()
        raise
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in _given.pop():
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)
