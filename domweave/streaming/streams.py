"""Streaming forms: extraction of landing pages, duplicates, counters per window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from domweave.operators.dom import parse_pages
from domweave.operators.extract import matches


def extract_stream(pages: DataFrame, extractor: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                   mode: str = "append") -> StreamingQuery:
    """Parse landing pages batch by batch and write what ``extractor`` makes of them.

    ``extractor`` may group and join: each micro-batch is an ordinary DataFrame.  The
    batch id is part of the output path, so a replayed batch replaces its own files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        extractor(parse_pages(batch)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def element_stream(pages: DataFrame, selector) -> DataFrame:
    """Matching elements of landing pages; stateless, so plain append works."""
    return matches(parse_pages(pages), selector, "page_id", "url")


def _timed(rows: DataFrame, ts: str) -> DataFrame:
    """Event time must be a timestamp with time zone; stored ones may be without."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def first_occurrences(items: DataFrame, value: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of ``value`` within the watermark delay."""
    return _timed(items, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([value])


class _FirstOfKey(StatefulProcessor):
    """Tells of the candidates of a bucket's keys which are the first ever; remembers a key until it has not been seen for a while.

    A call takes all keys of one bucket, as every call costs far more than a key's entry in the bucket's map.
    """

    def __init__(self, key: dict[str, str], ttl_ms: int | None):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", ", ".join(f"{n} {t}" for n, t in self.key.items()), "seen boolean", self.ttl_ms)
        self.out = Row(*self.key, "items", "is_first")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] < 0:  # what came after a candidate of its own task: known to be repeats, no state is read
            for job, value, items, _ in rows:
                yield self.out(job, value, items, False)
            return
        best = {}
        for job, value, items, _ in rows:
            known = best.get((job, value))
            if known is None:
                best[job, value] = items[0]
            else:
                first, repeat = sorted((known, items[0]), key=lambda i: (i is None, i))
                best[job, value] = first
                yield self.out(job, value, [repeat], False)
        for at, item in best.items():
            seen = self.seen.containsKey(at)
            if not seen or self.ttl_ms:  # a sight puts the expiry off
                self.seen.updateValue(at, (True,))
            yield self.out(*at, [item], not seen)

    def close(self) -> None:
        pass


def flag_duplicates(items: DataFrame, job: str, value: str, item: str, ttl: str | None = None, hold: int = 100_000, salts: int = 64,
                    buckets: int = 1024) -> DataFrame:
    """(job, value, item, is_duplicate): repeats of a value within a job, in order of ``item`` within a micro-batch.

    Every task first reduces its rows to one candidate for each (job, value), its least item; all others are
    repeats whatever the state says, and go on packed, spread over ``salts`` groups.  So a value in a third of all
    rows sends a few candidates to the task that holds its state.  State is one boolean per (job, value), kept in ``buckets``
    maps: a call of the state operator takes a bucket, and holds its candidates of one micro-batch.  The number of buckets belongs
    to the checkpoint.  With ``ttl`` (such as "7 days") a value is forgotten once it has not been seen for that long, and the
    next occurrence counts as a first one again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    keys = f"{job} {kinds[job]}, {value} {kinds[value]}"

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by(item)  # nulls last
        groups = rows.group_by([job, value], use_threads=False).aggregate([(item, "list")]).combine_chunks()
        for part in groups.to_batches(max_chunksize=hold):
            lists = part.column(f"{item}_list").to_pylist()
            rest = [n for n, i in enumerate(lists) if len(i) > 1]
            for at, salt, cut in ((None, [0] * len(lists), [i[:1] for i in lists]),
                                  (pa.array(rest, pa.int64()), [1 + hash(lists[n][0]) % salts for n in rest], [lists[n][1:] for n in rest])):
                of = part if at is None else part.take(at)
                yield pa.RecordBatch.from_arrays(
                    [of.column(job), of.column(value), pa.array(salt, pa.int32()), pa.array(cut, pa.list_(rows.schema.field(item).type))],
                    names=[job, value, "salt", "items"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= hold:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    reduced = items.select(job, value, item).mapInArrow(reduce, f"{keys}, salt int, items array<{kinds[item]}>")
    bucket = F.when(F.col("salt") == 0, F.pmod(F.xxhash64(job, value), F.lit(buckets))).otherwise(-F.col("salt")).cast("int")
    flagged = reduced.select(job, value, "items", bucket.alias("bucket")).groupBy("bucket").transformWithState(
        _FirstOfKey({job: kinds[job], value: kinds[value]}, _millis_of(ttl)), f"{keys}, items array<{kinds[item]}>, is_first boolean", "Append",
        "ProcessingTime" if ttl else "None")
    return flagged.select(job, value, F.explode("items").alias(item), (~F.col("is_first")).alias("is_duplicate"))


def _millis_of(ttl: str | None) -> int | None:
    return int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None


def windowed_counters(log: DataFrame, ts: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests per tumbling window; rows later than the watermark are dropped."""
    failed = F.col("error_code").isNotNull() | (F.col("status") >= 400)
    return (
        _timed(log, ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(~failed).alias("successful_requests"),
            F.count_if(failed).alias("failed_requests"),
        )
        .select(F.col("w.start").alias("window_start"), "total_requests", "successful_requests", "failed_requests")
    )


def live_totals(log: DataFrame) -> DataFrame:
    """Running totals of requests (complete output mode)."""
    failed = F.col("error_code").isNotNull() | (F.col("status") >= 400)
    return log.groupBy().agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(~failed).alias("successful_requests"),
        F.count_if(failed).alias("failed_requests"),
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", idle_batches: bool = True) -> StreamingQuery:
    """Process everything available into Parquet files.

    ``idle_batches=False`` for state that expires by the clock: such a query asks for one more batch without
    data for ever, and so would never end.  Expired state is then left out at the next read, and removed with the next data.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(idle_batches and before == "true").lower())
    try:  # a query keeps the settings of its start
        return (
            stream.writeStream.format("parquet")
            .outputMode(mode)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(name, before)
