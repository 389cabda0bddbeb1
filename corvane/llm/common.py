"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(col, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often a lambda in the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none and all its tasks run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: The tables that operators stored and nobody dropped yet, by application.
_STORED: dict[str, set[str]] = {}


class Stored:
    """A DataFrame written as Parquet in the shared folder: it cuts the lineage and outlives a lost executor."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        _STORED.setdefault(self.spark.sparkContext.applicationId, set()).add(self.path)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; for tables that no later plan reads."""
        _delete(self.spark, self.path)
        _STORED[self.spark.sparkContext.applicationId].discard(self.path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_stored(spark: SparkSession) -> int:
    """Deletes all tables that operators stored in this session, and returns their number.

    For callers who have written the results: DataFrames returned before read some of these tables.
    """
    paths = _STORED.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        _delete(spark, path)
    return len(paths)


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_source(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The kept columns, with the text where it is one of them, else as one more; and its place."""
    if text in keep:
        return docs.select(*[docs[c] for c in keep]), keep.index(text)
    return docs.select(*[docs[c] for c in keep], docs[text].alias(free_name(docs, "text_"))), len(keep)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The DataFrame with columns of these names under free ones, and what selects all of its own columns from it again."""
    own, found = df, []
    for c in df.columns:
        other = c
        if c.lower() in names:
            other = free_name(own, f"own_{c}")
            own = own.withColumnRenamed(c, other)
        found.append((other, c))
    return own, [F.col(f"`{a}`").alias(c) for a, c in found]


def parallel(df: DataFrame) -> int:
    """Tasks for work that is bound by the CPU: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def is_training(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1
