"""Streaming queries: everything available is processed into tables, which are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from domweave.functions.selectors import css
from domweave.operators.extract import extract_items
from domweave.plans.job_queries import _FAILED, LOG_SQL, crawl_rows
from domweave.plans.page_queries import _decoded
from domweave.plans.registry import query, table
from domweave.session import work_dir
from domweave.sources.pages import stream_pages
from domweave.streaming import streams


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


@query(
    "stream_extract",
    f"""
    SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]+)">([^<]+)</a>')) AS BIGINT) AS links FROM pages
    """,
)
def stream_extract(spark, sf_dir):
    path, state = work_dir(spark, "items"), work_dir(spark, "state")
    pages = stream_pages(spark, f"{sf_dir}/pages.parquet*").select("page_id", "html")
    running = streams.extract_stream(pages, lambda dom: extract_items(dom, "body", parts=("links",)), path, state)
    running.awaitTermination()
    found = spark.read.parquet(path)
    return found.select("page_id", F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("links"))


@query(
    "stream_elements",
    f"""
    SELECT page_id, {_decoded("unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))")} AS href FROM pages
    """,
)
def stream_elements(spark, sf_dir):
    path, state = work_dir(spark, "elements"), work_dir(spark, "state")
    found = streams.element_stream(stream_pages(spark, f"{sf_dir}/pages.parquet*"), css("a[href]"))
    rows = found.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"))
    streams.run_to_table(rows, path, state).awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_first_occurrences",
    """
    SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1
    """,
)
def stream_first_occurrences(spark, sf_dir):
    path, state = work_dir(spark, "first"), work_dir(spark, "state")
    keyed = event_stream(spark, sf_dir).select(
        "user_id", F.concat_ws("-", "user_id", "event_type").alias("value"), "ts"
    )
    streams.run_to_table(streams.first_occurrences(keyed, "value", "ts", "400 days"), path, state).awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_duplicates",
    """
    SELECT user_id AS job_id, event_type AS value, event_id AS item_no, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_duplicate
    FROM events
    """,
)
def stream_duplicates(spark, sf_dir):
    path, state = work_dir(spark, "flags"), work_dir(spark, "state")
    items = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("value"), F.col("event_id").alias("item_no")
    )
    streams.run_to_table(streams.flag_duplicates(items, "job_id", "value", "item_no"), path, state).awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_duplicates_hot",
    """
    -- a third of all rows share one value; the files are four, by event_id
    SELECT user_id % 2 AS job_id, value, event_id AS item_no, row_number() OVER (PARTITION BY user_id % 2, value ORDER BY event_id) > 1 AS is_duplicate
    FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type || '-' || (user_id // 2) END AS value FROM events)
    """,
)
def stream_duplicates_hot(spark, sf_dir):
    """Flags over four micro-batches, with state that expires."""
    path, state, landed = work_dir(spark, "flags"), work_dir(spark, "state"), work_dir(spark, "landed")
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id % 2 AS job_id", "if(event_id % 3 = 0, 'hot', concat(event_type, '-', user_id div 2)) AS value", "event_id AS item_no")
    last = rows.agg(F.max("item_no")).first()[0] or 0
    for part in range(4):  # files are taken in the order of their times
        low, high = last * part // 4, last * (part + 1) // 4
        some = rows.where((F.col("item_no") >= low) & ((F.col("item_no") < high) | F.lit(part == 3)))
        some.coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    flagged = streams.flag_duplicates(stream, "job_id", "value", "item_no", ttl="30 days")
    streams.run_to_table(flagged, path, state, idle_batches=False).awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_counters",
    f"""
    -- windows that end at or before the watermark, ten minutes behind the newest row
    WITH l AS ({LOG_SQL}), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM l)
    SELECT date_trunc('hour', ts) AS window_start, count(*) AS total_requests, count(*) FILTER (WHERE NOT {_FAILED}) AS successful_requests,
      count(*) FILTER (WHERE {_FAILED}) AS failed_requests
    FROM l, w GROUP BY date_trunc('hour', ts), mark HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark
    """,
)
def stream_counters(spark, sf_dir):
    path, state = work_dir(spark, "windows"), work_dir(spark, "state")
    counters = streams.windowed_counters(crawl_rows(event_stream(spark, sf_dir)))
    streams.run_to_table(counters, path, state).awaitTermination()
    return spark.read.parquet(path).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_totals",
    f"""
    SELECT count(*) AS total_requests, count(*) FILTER (WHERE NOT {_FAILED}) AS successful_requests,
      count(*) FILTER (WHERE {_FAILED}) AS failed_requests FROM ({LOG_SQL})
    """,
)
def stream_totals(spark, sf_dir):
    path, state = work_dir(spark, "totals"), work_dir(spark, "state")
    totals = streams.live_totals(crawl_rows(event_stream(spark, sf_dir)))

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(path)

    totals.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", state).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(path)
