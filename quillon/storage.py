"""Tables written to the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Where the tables lie that are still referred to.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder. A local one is made only where the session names none and runs in one process, as
    in tests; elsewhere executors wouldn't see each other's files, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def store(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs one read.

    The JVM is asked to collect garbage, as Spark only deletes shuffle files of stages that nothing refers to.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    schema = df.schema
    del df
    gc.collect()
    jvm.System.gc()
    found = spark.read.schema(schema).parquet(path)
    _paths[found] = path
    return found


def drop(*stored: DataFrame) -> None:
    """Delete the files of tables that :func:`store` returned and that nothing reads any more."""
    for df in stored:
        path = _paths.pop(df, None)
        if path:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
