"""Cutting lineage with tables in storage that every executor shares."""

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, one of its own for this session if all of Spark runs on this machine (tests, local
    mode); on a cluster that is an error, since no executor would see the tables of another."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("framegate.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="framegate-")
        spark.conf.set("framegate.scratch", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder and read back.

    Lost executors cost no recomputation and a nondeterministic input (range bounds, partition numbers) is fixed from here on.
    The table is compressed and columnar, so later reads prune columns. The application's folder is removed when its driver ends.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark.sparkContext.applicationId not in _written:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For a query and its action: removes the tables that durable() wrote in between. What is read later must have been written elsewhere."""
    before = list(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, keep=before)


def release(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Remove the tables that durable() wrote for this session, but for the paths to keep."""
    paths, kept = _written.get(spark.sparkContext.applicationId, []), set(keep)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in paths if p not in kept]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    paths[:] = [p for p in paths if p in kept]


def drop_table(df: DataFrame) -> None:
    """Remove the table behind a DataFrame that durable() returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        for paths in _written.values():
            if path in paths:
                paths.remove(path)
