"""Rules held as data give what schemas in the plan give."""

import random

import pytest
from pyspark.sql import functions as F

from domweave.operators import field_rules as fr
from domweave.operators import validate as v
from domweave.session import configure

FIELDS = {
    "mail": v.FieldRule("email", required=True), "phone": v.FieldRule("phone"), "price": v.FieldRule("price", min_length=2, max_length=6),
    "name": v.FieldRule("text", max_length=12), "page": v.FieldRule("html"), "odd": v.FieldRule("colour"), "free": v.FieldRule(),
    "day": v.FieldRule("date", required=True), "n": v.FieldRule("number"),
}
VALUES = ["", None, "a@b.co", "a @b.co", "+7 (900) 123-45-67", "12345678", "$19.99", "1,299.00", "hello", " hello  there ", "hello 2", "café", "<b>x</b>", "&lt;b&gt;",
          "15.01.2024", "2024-01-15", "42", "3.14", "x" * 20, " ", "-", "https://x.io/a?b=c"]


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    configure(spark)


@pytest.fixture(scope="module")
def wide(spark):
    draw = random.Random(3)
    rows = [(j, i, *[draw.choice(VALUES) for _ in FIELDS]) for j in range(4) for i in range(150)]
    rows += [(9, i, "a@b.co", None, "$10", "ok", "<b>x</b>", None, "f", "2024-01-15", "1") for i in range(10)]
    return spark.createDataFrame(rows, "job_id int, item_no int, " + ", ".join(f"{f} string" for f in FIELDS))


def long_form(wide):
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    return wide.select("job_id", "item_no", F.inline(entries))


def rules_of(spark, jobs):
    rows = [(j, n, r.type, r.required, r.min_length, r.max_length) for j in jobs for n, r in FIELDS.items()]
    return spark.createDataFrame(rows, "job_id int, field string, type string, required boolean, min_length int, max_length int")


def issues(column):
    return sorted((i.severity, i.type, i.field, i.value, i.detail) for i in column)


def test_same_findings_as_the_wide_form(spark, wide):
    want = {(r.job_id, r.item_no): r for r in v.check_items(wide, v.Schema(FIELDS)).collect()}
    got = {(r.job_id, r.item_no): r for r in fr.check_values(long_form(wide), rules_of(spark, [0, 1, 2, 3, 9])).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        g = got[key]
        text = lambda rows: sorted(map(str, issues(rows)))
        assert text(g.errors) == text(w.errors) and text(g.warnings) == text(w.warnings), key
        assert (g.is_valid, g.was_cleaned) == (w.is_valid, w.was_cleaned), key
        failed = {i.field for i in w.errors}
        assert {k: x for k, x in g.fields.items()} == {f: w[f] for f in FIELDS if f not in failed}, key


def test_every_job_has_its_own_rules(spark):
    values = spark.createDataFrame([(1, 1, "a", "12"), (2, 1, "a", "12"), (3, 1, "a", "12"), (3, 2, "b", "x")], "job_id int, item_no int, field string, value string")
    rules = spark.createDataFrame(
        [(1, "a", "number", True, None, None), (2, "a", "email", False, None, None), (3, "a", "number", True, None, 1)],
        "job_id int, field string, type string, required boolean, min_length int, max_length int")
    got = {(r.job_id, r.item_no): [(i.type, i.field) for i in r.errors] for r in fr.check_values(values, rules).collect()}
    assert got == {(1, 1): [], (2, 1): [("format", "a")], (3, 1): [("max_length", "a")], (3, 2): [("missing", "a")]}


def test_apply_rules(spark, wide):
    # the same data without nulls, which a wide table cannot tell from absent fields
    rules = rules_of(spark, [0, 1, 2, 3, 9])
    kept, messages, stats = fr.apply_rules(long_form(wide), rules)
    result, told, counted = v.apply_validation(wide, v.Schema(FIELDS))
    assert sorted(map(tuple, stats.collect()), key=str) == sorted(map(tuple, counted.collect()), key=str)
    assert {(r.job_id, r.item_no) for r in kept.collect()} == {(r.job_id, r.item_no) for r in result.collect()}
    assert sorted((r.job_id, str(r.item_no), r.severity, r.type, r.field, r.value or "") for r in messages.collect()) == sorted(
        (r.job_id, str(r.item_no), r.severity, r.type, r.field, r.value or "") for r in told.collect())


def test_rules_of_the_first_item(spark, wide):
    got = {(r.job_id, r.field): (r.type, r.min_length, r.max_length) for r in fr.sample_rules_of(long_form(wide)).collect()}
    want = {(r.job_id, r.field): (r.type, r.min_length, r.max_length) for r in v.sample_rules(wide).collect()}
    assert got == want


def test_nothing(spark):
    values = spark.createDataFrame([], "job_id int, item_no int, field string, value string")
    kept, messages, stats = fr.apply_rules(values)
    assert (kept.count(), messages.count(), stats.count()) == (0, 0, 0)
