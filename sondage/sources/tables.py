"""Parquet tables by name, and intermediate tables that outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """File stem = view name, for every known table that the directory holds."""
    for name in TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


#: A batch of so many texts, or of so many bytes of text, with what Python makes of it, fits beside a small executor's heap.
TEXTS_AT_ONCE = 1_000
BYTES_AT_ONCE = 16 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after seeing to it that Arrow batches of its session are bounded in rows and in bytes.

    Plans are lazy, so the bounds stay set in the session; smaller ones of the caller stay as they are.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", TEXTS_AT_ONCE), ("maxBytesPerBatch", BYTES_AT_ONCE)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs in one local process (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
    return at or f"file://{tempfile.gettempdir()}/sondage-checkpoints"


#: Spark drops the shuffle files of a query when it ends, not when the driver's memory is next collected.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str = "stage", rows_per_file: int = 0, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and two readers see the same
    rows in the same files. The files go when the driver ends, those of the shuffles at once. ``codec`` compresses the pages; without
    one the session's holds.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        writer = df.write.option("maxRecordsPerFile", rows_per_file)
        (writer.option("compression", codec) if codec else writer).parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if was is None else spark.conf.set(DROP_SHUFFLES, was)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`durable`, once nothing reads it any more."""
    for f in df.inputFiles()[:1]:
        _remove(df.sparkSession, f.rsplit("/", 1)[0])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session is already gone; the folder belongs to the cluster's own cleaner
        return
