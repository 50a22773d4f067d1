"""Duplicates on a stream over several micro-batches: one hot value, replayed order, expiry."""

import time

import pytest
from pyspark.sql import functions as F

from domweave.session import configure, work_dir
from domweave.streaming import streams

SCHEMA = "job long, value string, item long"


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    configure(spark)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(folder)
    time.sleep(0.05)  # files are taken in the order of their times


def flags(spark, folder, checkpoint, path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(folder)
    streams.run_to_table(streams.flag_duplicates(stream, "job", "value", "item", **options), path, checkpoint, idle_batches=False).awaitTermination(120)
    return {(r.job, r.value, r.item): r.is_duplicate for r in spark.read.parquet(path).collect()}


def test_first_of_each_value_over_batches(spark):
    folder, checkpoint, path = (work_dir(spark, n) for n in ("in", "state", "out"))
    batches = []
    for b in range(3):
        rows = [(j, "hot", 1000 * b + i) for j in (1, 2) for i in range(120)]
        rows += [(1, f"v{i % 40}", 5000 + 1000 * b + i) for i in range(200)] + [(1, f"only{b}", 9000 + b), (3, None, 9100 + b), (None, "x", 9200 + b)]
        batches.append(rows)
        land(spark, folder, rows)
    got = flags(spark, folder, checkpoint, path, hold=50)
    seen, want = set(), {}
    for rows in batches:
        for j, v, i in sorted(rows, key=lambda r: r[2]):
            want[j, v, i] = (j, v) in seen
            seen.add((j, v))
    assert got == want
    # a later run goes on with the state
    land(spark, folder, [(1, "hot", 99_999), (9, "hot", 99_998)])
    got = flags(spark, folder, checkpoint, path, hold=50)
    assert got[1, "hot", 99_999] is True and got[9, "hot", 99_998] is False


def test_values_are_forgotten(spark):
    folder, checkpoint, path = (work_dir(spark, n) for n in ("in", "state", "out"))
    land(spark, folder, [(1, "a", 1), (1, "a", 2)])
    first = flags(spark, folder, checkpoint, path, ttl="2 seconds")
    assert first == {(1, "a", 1): False, (1, "a", 2): True}
    time.sleep(3)
    land(spark, folder, [(1, "a", 3), (1, "a", 4)])
    assert flags(spark, folder, checkpoint, path, ttl="2 seconds") == first | {(1, "a", 3): False, (1, "a", 4): True}


def test_a_hot_value_sends_candidates_only(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("job"), F.lit("hot").alias("value"), F.col("id").alias("item")).repartition(6)
    folder, path = work_dir(spark, "in"), work_dir(spark, "out")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    query = streams.run_to_table(streams.flag_duplicates(stream, "job", "value", "item", ttl="7 days"), path, work_dir(spark, "state"), idle_batches=False)
    assert query.awaitTermination(120)
    out = spark.read.parquet(path)
    assert out.count() == 30_000 and out.where("not is_duplicate").collect() == [(1, "hot", 0, False)]
    # one value is remembered, whatever the number of rows
    assert [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.numInputRows] == [1]


def test_a_call_takes_a_bucket_of_values(spark):
    """The state operator is called by bucket, not by value; whole numbers beside nulls stay exact."""
    big = 2**60 + 1
    rows = [(big + i % 400, f"v{i % 7}", i) for i in range(8_000)] + [(None, "x", 9_000), (None, "x", 9_001)]
    folder, path = work_dir(spark, "in"), work_dir(spark, "out")
    land(spark, folder, rows)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    flagged = streams.flag_duplicates(stream, "job", "value", "item", buckets=3)
    assert "bucket" in flagged._jdf.queryExecution().analyzed().toString()
    assert streams.run_to_table(flagged, path, work_dir(spark, "state")).awaitTermination(120)
    seen, want = set(), {}
    for j, v, i in rows:
        want[j, v, i] = (j, v) in seen
        seen.add((j, v))
    assert {(r.job, r.value, r.item): r.is_duplicate for r in spark.read.parquet(path).collect()} == want
