"""Indexes as files: built once, then searched by reading the few row groups that hold a search's terms."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, vocabulary

#: Rows of a row group of postings, about: what a search reads for one rare term.
GROUP_BYTES = 1 << 20


def write_index(index: Index, path: str, files: int | None = None) -> None:
    """Blocks of postings sorted by term across files and within them, the vocabulary likewise, lengths, and one row of statistics.

    Row groups are small and terms sorted, so that a filter on terms skips nearly all of them. A term has a block for each
    chunk of documents, so that not even one with all documents makes a file much larger than the others.
    """
    spark = index.blocks.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.row.count.limit": "5000"}
    blocks = index.cut(index.blocks.drop("shard").repartitionByRange(files, "term"))
    blocks.sortWithinPartitions("term").write.options(**small).parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    vocabulary(stored).repartitionByRange(max(1, files // 8), "term").sortWithinPartitions("term").write.options(**small).parquet(f"{path}/vocabulary")
    index.lists.write.parquet(f"{path}/lengths")
    index.stats.coalesce(1).write.parquet(f"{path}/stats")


class Kept:
    """Stores a table below a folder; drop() deletes what was stored."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder}/kept-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        df.write.parquet(self.path)
        return self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index as it was written; searches push their terms down to its files."""
    read = {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "stats", "vocabulary")}
    return Index(read["postings"], read["lengths"], read["stats"], read["vocabulary"])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session whose tasks all run in this process may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="corvane-index-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def version_of(spark: SparkSession, path: str) -> str:
    """What changes when a table's files do: their number, size and time, from the file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own, content = system.getFileStatus(where), system.getContentSummary(where)
    return f"{own.getModificationTime()}-{content.getLength()}-{content.getFileCount()}"


_BUILT: dict[tuple, str] = {}


def indexed(spark: SparkSession, source: str, kind: str, build: Callable[[Kept], Index]) -> Index:
    """The index of a table's files, built by build(keep) at its first use in a session and read from then on."""
    key = (spark.sparkContext.applicationId, source, version_of(spark, source), kind)
    if key not in _BUILT:
        path, keep = f"{shared_folder(spark)}/index-{kind}-{uuid.uuid4().hex}", Kept(spark, shared_folder(spark))
        write_index(build(keep), path)
        keep.drop()
        _BUILT[key] = path
    return open_index(spark, _BUILT[key])
