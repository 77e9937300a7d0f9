"""Cut points of iterated plans: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) a temporary
    folder is made once per session and recorded in that setting; a cluster
    without the setting is an error, since a local folder would not be shared.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    made = tempfile.mkdtemp(prefix="fieldloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def fresh_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path below the shared folder, deleted when the session's JVM ends unless it is to ``keep``; runs never reuse one another's."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if keep:
        return path
    store, at = _store(spark, path)
    store.deleteOnExit(at)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Paths made by this process, by application: those that ``drop_cuts`` may delete.
_made: dict[str, list[str]] = {}


def made_so_far(spark: SparkSession) -> int:
    """A mark for ``drop_cuts``: how many paths the session has made."""
    return len(_made.setdefault(spark.sparkContext.applicationId, []))


def drop_cuts(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the paths made since a mark, but for those that ``keep`` reads.

    For when all results that read them are written; what is left is deleted
    when the session's JVM ends.
    """
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    kept = [] if keep is None else [f.rsplit("/", 2)[-2] for f in keep.inputFiles()]
    for path in made[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            store, at = _store(spark, path)
            store.delete(at, True)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later stages start from these files, so a lost executor costs only the
    tasks it was running, and a join on the rereading sees plain exchanges on
    both sides, which adaptive execution may split when a key is hot.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
