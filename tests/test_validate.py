import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from domweave.operators import validate as v
from domweave.session import configure


@pytest.fixture(scope="module")
def items(spark):
    configure(spark)
    rng = random.Random(7)
    # one job and one value hold a third of all rows
    rows = []
    for i in range(600):
        job = 1 if rng.random() < 0.34 else rng.randrange(2, 9)
        mail = "hot@x.org" if rng.random() < 0.34 else rng.choice([None, "", "bad", f"u{rng.randrange(60)}@x.org"])
        rows.append((job, i, mail, rng.choice(["Hello", "hello 2", "  spaced   out ", "", None]), rng.choice([0.0, 1.5, None])))
    return spark.createDataFrame(rows, "job_id int, item_no int, email string, title string, amount double")


SCHEMA = v.Schema(
    {"email": v.FieldRule("email", min_length=5), "title": v.FieldRule("text", required=True)},
    relations=(v.Relation("required_together", ("title", "amount")),),
    unique_fields=("email",),
)


def test_duplicates_against_brute_force(items):
    checked = v.check_items(items, SCHEMA)
    expected, seen = set(), set()
    for r in sorted(checked.collect(), key=lambda r: (r["job_id"], r["item_no"])):
        if r["email"]:
            key = (r["job_id"], r["email"])
            if key in seen:
                expected.add((r["job_id"], r["item_no"], "email", r["email"]))
            seen.add(key)
    found = [tuple(r) for r in v.duplicate_issues(checked, ("email",)).collect()]
    assert set(found) == expected and len(found) == len(expected) > 100


def test_long_values_are_compared_whole(spark):
    long = "x" * 5000
    rows = spark.createDataFrame([(1, 1, long + "a"), (1, 2, long + "b"), (1, 3, long + "a")], "job_id int, item_no int, t string")
    assert [(r["item_no"]) for r in v.duplicate_issues(rows, ("t",)).collect()] == [3]


def test_counters_add_up(items):
    cleaned, issues, stats = v.validate(items, SCHEMA)
    total = stats.agg(*[F.sum(c).alias(c) for c in ("total_items", "valid_items", "invalid_items", "cleaned_items")]).first()
    assert total["total_items"] == 600 == total["valid_items"] + total["invalid_items"]
    assert cleaned.count() == total["valid_items"] >= total["cleaned_items"]
    with_errors = issues.where("severity = 'error'").select("job_id", "item_no").distinct().count()
    assert with_errors == total["invalid_items"]


def test_invalid_items_can_be_kept(items):
    kept = v.validate(items, v.Schema(SCHEMA.fields, include_invalid=True))[0]
    assert kept.count() == 600
    assert kept.where("title = 'hello 2'").count() == 0  # failed fields are left out


def test_verdict_and_messages(spark):
    rows = [(1, i, "ok" if i < 4 else "not 1") for i in range(10)] + [(2, i, "ok" if i < 5 else "no 1") for i in range(10)]
    rows += [(3, i, "no 1") for i in range(3)]
    frame = spark.createDataFrame(rows, "job_id int, item_no int, t string")
    schema = v.Schema({"t": v.FieldRule("text")})
    result, messages, stats = v.apply_validation(frame, schema)
    verdicts = {r["job_id"]: (r["is_valid"], r["invalid_percent"]) for r in stats.collect()}
    assert verdicts == {1: (False, 60), 2: (True, None), 3: (False, 100)}
    kinds = {(r["job_id"], r["type"]) for r in messages.collect()}
    assert kinds == {(1, "critical"), (1, "format"), (3, "critical"), (3, "format")}
    counts = {r["job_id"]: r["count"] for r in result.groupBy("job_id").count().collect()}
    assert counts == {1: 4, 2: 5, 3: 3}  # job 3 keeps its originals


def test_empty_input_is_valid(spark):
    frame = spark.createDataFrame([], "job_id int, item_no int, t string")
    cleaned, issues, stats = v.validate(frame, v.Schema({"t": v.FieldRule("text")}))
    assert (cleaned.count(), issues.count(), stats.count()) == (0, 0, 0)


def check(spark, value, rule, **options):
    frame = spark.createDataFrame([(1, 1, value)], "job_id int, item_no int, f string")
    row = v.check_items(frame, v.Schema({"f": rule}, **options)).first()
    return [e["type"] for e in row["errors"]], [w["type"] for w in row["warnings"]], row["f"]


@pytest.mark.parametrize(
    ("value", "rule", "errors"),
    [
        (None, v.FieldRule("text", required=True), ["required"]),
        ("", v.FieldRule("text", required=True), ["required"]),
        (None, v.FieldRule("text"), []),
        ("!№", v.FieldRule("text"), []),
        ("№", v.FieldRule("text"), ["format", "min_length"]),
        ("x" * 10_000, v.FieldRule("text", max_length=0), []),
        ("x" * 10_001, v.FieldRule("text"), ["max_length"]),
        ("x", v.FieldRule("text", min_length=2), ["min_length"]),
        ("x", v.FieldRule("text", validator=lambda c: c == "y"), ["custom"]),
        ("<b>x</b>", v.FieldRule("html"), []),
    ],
)
def test_field_rules(spark, value, rule, errors):
    assert check(spark, value, rule)[0] == errors


def test_html_fields_fail_under_the_strict_rule(spark):
    assert check(spark, "<b>x</b>", v.FieldRule("html"), strict_html=True)[0] == ["format"]
    assert check(spark, "&lt;b&gt;", v.FieldRule("html"), strict_html=True)[0] == []


def test_unknown_types_only_warn(spark):
    assert check(spark, "x", v.FieldRule("array")) == ([], ["unknown_type"], "x")


def test_a_pandas_validator(spark):
    @F.pandas_udf("boolean")
    def even(values: pd.Series) -> pd.Series:
        return values.str.len() % 2 == 0

    assert check(spark, "ab", v.FieldRule("text", validator=even))[0] == []
    assert check(spark, "abc", v.FieldRule("text", validator=even))[0] == ["custom"]


def test_relations_use_cleaned_values(spark):
    frame = spark.createDataFrame([(1, 1, "№", "b"), (1, 2, "a", "b"), (1, 3, None, None)], "job_id int, item_no int, a string, b string")
    rules = {"a": v.FieldRule("text"), "b": v.FieldRule("text")}
    together = v.check_items(frame, v.Schema(rules, (v.Relation("required_together", ("a", "b")),)))
    types = [[e["type"] for e in r["errors"]] for r in together.orderBy("item_no").collect()]
    assert types == [["format", "min_length", "required_together"], [], []]
    exclusive = v.check_items(frame, v.Schema(rules, (v.Relation("mutually_exclusive", ("a", "b")),)))
    row = exclusive.where("item_no = 2").first()
    assert [(e["type"], e["detail"]) for e in row["errors"]] == [("mutually_exclusive", "a, b")]


def test_schema_from_the_first_item(spark):
    frame = spark.createDataFrame(
        [(1, 2, "x", 1.0), (1, 1, "a@b.co", None), (2, 1, "<b>", 2.0)], "job_id int, item_no int, f string, n double"
    )
    schema = v.schema_from_sample(frame)
    assert schema.fields["f"].type == "email" and schema.fields["n"].type == "object"
    rules = {(r["job_id"], r["field"]): r["type"] for r in v.sample_rules(frame).collect()}
    assert rules == {(1, "f"): "email", (1, "n"): "object", (2, "f"): "html", (2, "n"): "number"}


def test_checks_of_valid_items_are_made_once(spark):
    """A filter on the verdict does not hold the checks a second time."""
    items = spark.createDataFrame([(1, 1, "a@b.org", "12345678"), (1, 2, "none", "12345678"), (1, 3, None, None)], "job_id int, item_no int, email string, phone string")
    schema = v.Schema({"email": v.FieldRule("email"), "phone": v.FieldRule("phone")}, (v.Relation("required_together", ("email", "phone")),))
    kept = v.validate(items, schema)[0]
    assert [tuple(r) for r in kept.orderBy("item_no").collect()] == [(1, 1, "a@b.org", "12345678"), (1, 3, None, None)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2


def test_customers_are_dealt_over_the_tasks_of_a_shuffle(spark, tmp_path):
    from domweave.plans import quality_queries

    spark.range(0, 500, 1, 1).selectExpr(
        "id AS c_custkey", "if(id = 3, NULL, 'n') AS c_name", "1 AS c_nationkey", "-1.5D AS c_acctbal", "'AUTO' AS c_mktsegment",
    ).write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.domweave.parsePartitions", "0")
    spark.conf.set("spark.domweave.parsePartitions", "0")
    try:
        for frame, per_row in ((quality_queries.values(spark, str(tmp_path)), 27), (quality_queries.items(spark, str(tmp_path)), 1)):
            tasks = frame.groupBy(F.spark_partition_id()).count().collect()
            assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 500 * per_row
    finally:
        spark.conf.set("spark.domweave.parsePartitions", before)
