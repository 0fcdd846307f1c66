"""Session settings, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings that queries of this library are written for; ANSI mode stays on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
#: Rows in an Arrow batch where the session has Spark's default, which with long texts makes batches of tens of MB.
ARROW_ROWS, ARROW_DEFAULT = "2000", "10000"


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with these settings; ``shuffle_partitions`` is best left to adaptive execution on a cluster."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.  Only a local session may do without, and gets
    a folder of its own; on a cluster such a folder would lose data."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tributary/{spark.sparkContext.applicationId}"


#: Where tables that ``settled`` removes lie below the application's folder.
_SCOPE: ContextVar[str] = ContextVar("scope", default="")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{_own_dir(spark)}{_SCOPE.get()}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a write when it is over; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a narrow table for which a file of its own is worth while.
FILE_ROWS = 200_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: this cuts lineage and survives lost executors.

    rows: a bound on the rows of a narrow table, where one is known, so that a small one isn't scattered over as many files as there
    are shuffle partitions.  The tables stay for as long as results that read them may be used; ``forget`` removes them."""
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of ``make``, written; the tables that it wrote on its way are removed."""
    inner = f"{_SCOPE.get()}/{name}-{uuid.uuid4().hex}"
    token = _SCOPE.set(inner)
    try:
        df = make()
    finally:
        _SCOPE.reset(token)
    out = written(df, name)
    _remove(spark, _own_dir(spark) + inner)
    return out


def _remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Remove a written table; results that still read it are void."""
    for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, place)


def forget(spark: SparkSession) -> None:
    """Remove all tables that this application has written with ``written``; results that still read them are void."""
    _remove(spark, _own_dir(spark))


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a context, so that their Python workers can import it wherever it lies;
    and keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if getattr(context, "_tributary_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        place = os.path.join(tempfile.mkdtemp(prefix="tributary-"), "tributary.zip")
        with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("tributary", os.path.relpath(path, top)))
        context.addPyFile(place)
    context._tributary_shipped = True
