"""Shared folder handling and small helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow rows per Python batch: texts may be long, so batches stay small.
BATCH_ROWS = 512

_folders: list[str] = []  # written by this process, oldest first


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process gets a temporary folder; on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    conf = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="foliospark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        conf = "file://" + own
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Written tables that cut lineage: lost executors re-read files instead of recomputing.

    What an operator returns may still read its tables; drop_since removes them once that is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
        _folders.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, folder: str) -> None:
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), spark.sparkContext._jsc.hadoopConfiguration()
    path.getFileSystem(conf).delete(path, True)


def mark() -> int:
    return len(_folders)


def drop_since(spark: SparkSession, marked: int) -> None:
    """Remove the tables of all operators begun since mark(): their results are written elsewhere."""
    while len(_folders) > marked:
        _delete(spark, _folders.pop())


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch size, which holds for its other Python functions too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_flag(doc_id):
    """True where crc32 of the id's decimal text leaves remainder 0 by 5; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def without(docs: DataFrame, flagged, name: str) -> DataFrame:
    """docs without the rows that flagged marks.

    flagged takes (doc_id long, text) and returns a table with the doc_ids to drop; it must judge
    by text alone.  Rows go in under a hash of their doc_id and text, so each is judged by its own
    text, rows with a null doc_id and several of one doc_id too.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = flagged(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = Scratch(docs.sparkSession, name).keep(gone, "gone")
    return docs.join(gone, key == gone["__gone"], "left_anti")


def worker_cache(owner: str) -> dict:
    """A dict that outlives the tasks of one Python worker, of one operator at a time: another's goes."""
    import sys
    import types

    home = sys.modules.setdefault("_foliospark_worker", types.ModuleType("_foliospark_worker"))
    if getattr(home, "owner", None) != owner:
        home.owner, home.cache = owner, {}
        release()
    return home.cache


def release() -> None:
    """Gives the memory that this Python worker has freed back to the system: workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
