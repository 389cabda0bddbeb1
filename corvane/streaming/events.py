"""Server-sent events of recorded bodies, and postings kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, index_of_counts, token_counts

#: Where each provider's event has its text.
TEXT_PATHS = ("$.choices[0].delta.content", "$.delta.text", "$.candidates[0].content.parts[0].text")
PROVIDER_ID = "^[a-z0-9][a-z0-9_-]{0,39}$"
FORMATS = ("chat", "messages", "contents")


def event_data(body: Column) -> Column:
    """The data of each event: blocks are divided by blank lines, their data lines joined; the closing mark isn't data."""
    flat = F.regexp_replace(body, "\r\n?", "\n")
    lines = lambda block: F.filter(F.split(block, "\n"), lambda x: x.startswith("data:"))
    joined = lambda block: F.array_join(F.transform(lines(block), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return F.filter(F.transform(F.split(flat, "\n\n+"), joined), lambda x: (x != "") & (x != "[DONE]"))


def event_text(body: Column) -> Column:
    """The text of all events; those that are no JSON or have none count for nothing."""
    found = lambda x: F.coalesce(*[F.get_json_object(x, p) for p in TEXT_PATHS], F.lit(""))
    return F.array_join(F.transform(event_data(body), found), "")


def event_error(body: Column) -> Column:
    """The first error an event reports, or null."""
    return F.get(F.filter(F.transform(event_data(body), lambda x: F.get_json_object(x, "$.error.message")), lambda x: x.isNotNull()), F.lit(0))


def valid_provider(identifier: Column, base: Column, kind: Column) -> Column:
    return identifier.rlike(PROVIDER_ID) & base.rlike("^https://[^\\s]+$") & kind.isin(*FORMATS)


def maintain_postings(docs: DataFrame, doc: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the counts and the documents of new texts, one folder a batch, so that a batch that is tried again replaces itself.

    A document that comes again replaces its earlier text when the index is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        token_counts(batch, doc, text).withColumnRenamed("tf", "w").write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        batch.select(F.col(doc).alias("doc")).distinct().write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintained_index(spark: SparkSession, path: str) -> Index:
    """The full-text index of all that a stream has brought so far; write it by sources.index_files for searches."""
    last = spark.read.parquet(f"{path}/docs").groupBy("doc").agg(F.max("batch").alias("batch"))
    counts = spark.read.parquet(f"{path}/counts").join(last, ["doc", "batch"]).select("term", "doc", "w")
    return index_of_counts(counts, last.select("doc"))
