"""Accounting over a crawl log: (job_id, url, attempt, status, error_code, message, bytes, ts)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from domweave.plans import rules as R


def is_retryable(code: Column, status: Column, message: Column) -> Column:
    words = [F.contains(message, F.lit(w)) for w in R.RETRYABLE_WORDS]
    return reduce(
        or_,
        [F.coalesce(c, F.lit(False)) for c in (code.isin(R.RETRYABLE_CODES), status.isin(R.RETRYABLE_STATUSES), *words)],
    )


def retry_delay(
    attempt: Column, base: int = R.RETRY_BASE_MS, limit: int = R.RETRY_MAX_MS, factor: int = R.RETRY_FACTOR
) -> Column:
    """Wait in milliseconds after a failed attempt (1-based)."""
    return F.least(F.lit(base) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(limit))).cast("long")


def total_wait(attempts: Column, **options) -> Column:
    """Wait added up over the attempts before the last one."""
    waits = F.when(attempts > 1, F.sequence(F.lit(1), (attempts - 1).cast("int")))
    return F.coalesce(
        F.aggregate(waits, F.lit(0).cast("long"), lambda total, i: total + retry_delay(i, **options)), F.lit(0).cast("long")
    )


def success_rate(ok: Column, failed: Column) -> Column:
    """Percentage of successful requests, 0 when there were none."""
    return F.coalesce(F.try_divide(ok, ok + failed) * 100, F.lit(0.0))


def _millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def request_counters(log: DataFrame, *by: str) -> DataFrame:
    """Requests, failures, retries, bytes, success rate and duration per job."""
    by = by or ("job_id",)
    failed = F.col("error_code").isNotNull() | (F.col("status") >= 400)
    counted = log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(~failed).alias("successful_requests"),
        F.count_if(failed).alias("failed_requests"),
        F.count_distinct("url").alias("distinct_urls"),
        F.sum("bytes").alias("bytes_processed"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
    )
    return counted.select(
        *by, "attempts", "successful_requests", "failed_requests",
        (F.col("attempts") - F.col("distinct_urls")).alias("retry_attempts"),
        "bytes_processed",
        success_rate(F.col("successful_requests"), F.col("failed_requests")).alias("success_rate"),
        (_millis("end_time") - _millis("start_time")).alias("duration_ms"),
    )


def observed(log: DataFrame, name: str = "requests") -> tuple[DataFrame, Observation]:
    """The log, and its running totals: they are filled by whatever action first reads all of it.

    On a stream use the same metrics by name, they are part of every batch's progress.
    """
    totals = Observation(name)
    return log.observe(totals, *request_metrics()), totals


def request_metrics() -> list[Column]:
    failed = F.col("error_code").isNotNull() | (F.col("status") >= 400)
    return [
        F.count(F.lit(1)).alias("total_requests"), F.count_if(~failed).alias("successful_requests"), F.count_if(failed).alias("failed_requests")]


def error_status(name: Column, code: Column, message: Column) -> Column:
    """Response category of an error."""
    return (
        F.when(name == "ValidationError", 400)
        .when(F.contains(message, F.lit("URL")), 400)
        .when(F.contains(message, F.lit("timeout")), 408)
        .when(F.contains(message, F.lit("not found")) | (code == "ENOTFOUND"), 404)
        .otherwise(500)
    )


def request_summary(access_log: DataFrame) -> DataFrame:
    """Requests by method and status with mean, maximum and approximate median duration."""
    return access_log.groupBy("method", "status").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.5).alias("median_ms"),
    )
