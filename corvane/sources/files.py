"""Files in and out. Paths are whatever Spark's readers open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug, strip, valid_utf8

SCHEMA_VERSION = 2


def read_json_roots(spark: SparkSession, roots: list[str], schema: str) -> DataFrame:
    """JSON files below several roots, with the root's place as `root` and the file's path; what can't be parsed is left out."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
    parts = [reader.json(root).select("*", F.lit(i).alias("root"), F.col("_metadata.file_path").alias("path")) for i, root in enumerate(roots)]
    return reduce(DataFrame.unionByName, parts).filter("_corrupt is null").drop("_corrupt")


def identity_of(path: Column) -> tuple[Column, Column]:
    """(team, year) of a path ../team/year/file; a year that is none is null."""
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2)).try_cast("int")


def with_identity(raw: DataFrame, path: str = "path") -> DataFrame:
    """Adds slug and year as the path has them."""
    team, year = identity_of(F.col(path))
    return raw.withColumn("slug", slug(F.url_decode(team))).withColumn("year", year)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, cells trimmed, and `row` in the order of files and lines; rows without a year go."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("row"))
    named = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    cells = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in named.columns if c not in ("_file", "row", "year")]
    return named.select("row", F.expr("try_cast(trim(year) as int)").alias("year"), *cells).filter("year is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, plain or gzip; bytes that are no UTF-8 are left out."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), valid_utf8(F.col("value")).alias("text"))


def first_texts(texts: DataFrame) -> DataFrame:
    """The first text of every folder."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return texts.withColumn("folder", folder).groupBy("folder").agg(F.min_by("text", "path").alias("text"), F.min("path").alias("path"))


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Published records, instead of raw sources. kind: json or parquet, told from the path's end if it isn't given."""
    kind = kind or ("json" if path.rstrip("/").endswith((".json", ".json.gz", ".jsonl")) else "parquet")
    return spark.read.format(kind).load(path)


def write_json(df: DataFrame, path: str, order: list[str], files: int = 1) -> None:
    """Gzip JSON, the rows in order; the same rows give the same bytes, in that many files at most.

    One file is for tables that a reader loads whole; larger ones take as many as they need.
    """
    dealt = df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha, bytes) of files: the first 16 hex digits of SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.substring(F.sha2("content", 256), 1, 16).alias("sha"), F.col("length").alias("bytes"))


def write_manifest(spark: SparkSession, path: str, build: str) -> DataFrame:
    """Writes manifest.json beside the files of a folder: one row with the schema version, the build and each file's checksum."""
    own = checksums(spark, path).filter(F.col("name").rlike(r"^[^_.]") & (F.col("name") != "manifest.json"))
    files = F.sort_array(F.collect_list(F.struct("name", "sha", "bytes")))
    manifest = own.agg(files.alias("files")).select(F.lit(SCHEMA_VERSION).alias("schema"), F.lit(build).alias("build"), "files")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")
    return manifest


def changed(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Names that either manifest (name, sha) lacks or whose checksum differs."""
    met = local.select("name", F.col("sha").alias("own")).join(remote.select("name", F.col("sha").alias("theirs")), "name", "full")
    return met.filter(~F.col("own").eqNullSafe(F.col("theirs"))).select("name")


def first_loadable(spark: SparkSession, origins: list[str], version: int = SCHEMA_VERSION) -> DataFrame | None:
    """The manifest of the first origin that can be read and has the schema version; None if there is none."""
    from pyspark.errors import AnalysisException

    for origin in origins:
        try:
            manifest = spark.read.json(f"{origin}/manifest.json", multiLine=True)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        if "schema" in manifest.columns and manifest.filter(F.col("schema") == version).limit(1).count():
            return manifest
    return None
