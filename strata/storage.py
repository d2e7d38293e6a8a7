"""Tables between the steps of an iteration, and the folder that holds them."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a statement when it ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that this driver has made and not released.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave that setting out; anywhere else it is an error, since executors would
    write to folders that nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = os.path.join(tempfile.gettempdir(), "strata-checkpoints")
        else:
            raise RuntimeError("spark.checkpoint.dir: name a folder that driver and executors share")
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one. What is not released before goes when the driver ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_at_end)
    _made[path] = spark
    return path


def keep(df: DataFrame, where: str, name: str) -> DataFrame:
    """Write ``df`` below ``where`` and read it back. Lineage ends here, and a lost executor costs nothing;
    the shuffle files that made the table go with the end of the write."""
    path, spark = f"{where}/{name}", df.sparkSession
    with _setting(spark, _CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_dealt(df: DataFrame, where: str, name: str, by: list[str], parts: int) -> DataFrame:
    """``keep`` as buckets by the columns ``by``: joins and groupings by just these don't shuffle the table again,
    so that a small table can be met with it at the cost of a scan. The table has no name that outlives the call."""
    path, spark, table = f"{where}/{name}", df.sparkSession, f"strata_{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        df.repartition(parts, *by).write.format("parquet").bucketBy(parts, *by).sortBy(*by).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # its files stay, and ``out`` knows how they are dealt
    return out


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder or a table in it; nothing that reads it may be used after this."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@contextlib.contextmanager
def folders_made() -> Iterator[list[str]]:
    """A list that gets the scratch folders made within the block when it ends."""
    before, out = set(_made), []
    try:
        yield out
    finally:
        out.extend(p for p in _made if p not in before)


def _at_end() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may be gone by now
            release(spark, path)


def ship(spark: SparkSession) -> None:
    """Ship this package to the executors, once for each application, for functions that run there."""
    context = spark.sparkContext
    if getattr(context, "_strata_shipped", None) is not None:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "strata_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "strata")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._strata_shipped = target
