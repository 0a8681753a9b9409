"""Scratch tables in the cluster's shared folder, and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and U+0009 to U+000D. Everything else belongs to a word.
GAPS = "\t\n\x0b\x0c\r"
#: An Arrow batch is closed at so many rows or bytes while a table is saved: texts may be long, and both sides of the pipe to Python hold whole batches.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one if all of Spark is on this machine (tests), else an error."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, _local_root, True)
    return f"file://{_local_root}"


class Scratch:
    """Tables written to the shared folder so that a lost executor never costs more than one stage.

    save() writes a table and returns it as read back, which also cuts its lineage; drop() removes
    tables that nothing lazy still reads. What the returned DataFrame of an operator reads stays
    until the folder of the run is cleaned. With free_shuffles the shuffle files of a table go as soon as it is written, not when
    the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, free_shuffles: bool = False):
        self.spark = spark
        self.settings = ARROW_BATCH | ({FREE_SHUFFLES: "true"} if free_shuffles else {})
        self.base = f"{shared_root(spark)}/paperloom/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/t{self.n}"
        self.n += 1
        conf = self.spark.conf
        before = {k: conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            conf.set(k, str(v))
        try:
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._paperloom_path = path  # keeps the id from being used again
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._paperloom_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema); at a task's end its worker, which Spark keeps for other tasks, gives unused memory back to the system."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(task, schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written in decimal; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_tag(text: Column) -> Column:
    """Tells texts apart; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def repeated_ids(docs: DataFrame) -> bool:
    """Is there a doc_id, null included, that several rows have?"""
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: whatever else a table holds can't clash with working columns."""
    return docs.select(*[docs[n] for n in names])
