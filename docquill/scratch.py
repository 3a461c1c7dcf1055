"""Tables that cut a plan's lineage, kept where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, SparkSession] = {}
#: Local applications may have equal ids.
_RUN = uuid.uuid4().hex[:8]


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary folder (driver and executors are one process) and
    any other session a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="docquill-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docquill"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it read back; with ``by`` a folder for each value of that column.

    Unlike a cached frame, the written table survives the loss of executors;
    unlike ``localCheckpoint``, no part of it lives on one machine only. Every
    application writes below a folder of its own, so that the end of one leaves
    the tables of others alone.
    """
    spark = df.sparkSession
    root = f"{shared_root(spark)}/docquill-tables/{spark.sparkContext.applicationId}-{_RUN}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        atexit.register(clear, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again, and let Spark drop the shuffle files of plans that are done. Another table is an error."""
    jvm = spark._jvm
    for df in tables:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        if others := [f for f in folders if f"/docquill-tables/{spark.sparkContext.applicationId}-{_RUN}/" not in f]:
            raise ValueError(f"not a table of this application: {others[0]}")
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()  # Spark's cleaner follows the collector


def clear(root: str) -> None:
    """Delete the tables below ``root``, a folder of this application alone; runs by itself when Python ends."""
    spark = _ROOTS.pop(root, None)
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already
        pass
