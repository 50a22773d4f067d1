"""Page tables and page streams: (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id long, url string, html string"


def read_pages(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Page snapshots from a table format, or raw files with ``format="files"``.

    Raw files become one page each: the path is the URL, its hash the page id, and the file's time ``fetched_at``.
    """
    if format == "files":
        raw = spark.read.text(path, wholetext=True, **options).select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"), F.col("_metadata.file_modification_time").alias("fetched_at")
        )
        return raw.select(F.xxhash64("url").alias("page_id"), "url", "html", "fetched_at")
    return spark.read.schema(PAGE_SCHEMA).format(format).options(**options).load(path)


def stream_pages(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Newly landed page files as a stream."""
    return spark.readStream.schema(PAGE_SCHEMA).format(format).options(**options).load(path)


def spread(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal pages out to as many tasks as asked for, by argument or ``spark.domweave.parsePartitions``.

    Without either the pages stay as their source splits them, without a shuffle.
    Round robin: a repartition by key could be merged with an earlier shuffle, which
    adaptive execution then packs into few tasks by size, though parsing is CPU work.
    """
    partitions = partitions or int(pages.sparkSession.conf.get("spark.domweave.parsePartitions", "0"))
    return pages.repartition(partitions) if partitions else pages


def bytes_processed(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))
