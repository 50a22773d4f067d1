import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domweave.functions import text
from domweave.functions.urls import page_url


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("kind", "raw", "cleaned"),
    [
        ("text", "  a\t\n b  ", "a b"),
        ("text", "café — №5!", "caf  5!"),
        ("text", "Ёлка, ёж.", "Ёлка, ёж."),
        ("text", "😀", ""),
        ("html", "<script>if (a<b) {}</script><b>x</b>&nbsp;&amp;lt;", "x <"),
        ("html", "<SCRIPT>x</SCRIPT>y<style a>z</style>", "y"),
        ("html", "a < b and <i>c", "a  and c"[:2] + "c"),
        ("html", "&lt;b&gt;", "<b>"),
        ("price", "$1,299.00 USD", "$1.299.00"),
        ("phone", "tel: +7 (900)\t123-45-67", "+7 (900) 123-45-67"),
        ("email", " a @b.co\n", "a@b.co"),
        ("date", " 2024 ", " 2024 "),
    ],
)
def test_cleaning(spark, kind, raw, cleaned):
    assert one(spark, raw, lambda c: text.clean(c, kind)) == cleaned


@pytest.mark.parametrize("kind", ["price", "phone", "email"])
@pytest.mark.parametrize("raw", ["a @b.co", "+7 (900)\t 1", "$1,2 x", ""])
def test_cleaning_twice_changes_nothing(spark, kind, raw):
    once = one(spark, raw, lambda c: text.clean(c, kind))
    assert one(spark, once, lambda c: text.clean(c, kind)) == once


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("email", ["a@b.co", "é@b.c.d"], ["a @b.co", "a@b", "a@b.co\n", "a@b. c"]),
        ("phone", ["+7 (900) 1-2", "1234567", "2024-01-15"], ["123456", "1" * 16, "12a4567", "1234567\n8 9 1234567"]),
        ("url", ["http://x.io/a?b=c", "https://www.a-b.com"], ["ftp://x.io", "http://x", "http://x.io/é"]),
        ("price", ["$19.99", "1,299.00", "€ 5", "15.01.2024"], ["-1", "1.", "5 $", "1 299"]),
        ("date", ["01/02/2024", "1.2.24", "2024-1-5"], ["2024-1", "01/02/2024\n"]),
        ("number", ["42", "3,14"], ["-1", "1.2.3", "1\n"]),
        ("text", ["Hello, мир!", "a b"], ["hello 2", "a_b", ""]),
        ("html", ["<b>", "x < y > z"], ["<", "> <", "a"]),
        ("coordinate", ["-12.5", "0.0"], ["12", "1.2.3"]),
    ],
)
def test_formats(spark, kind, good, bad):
    for value in good:
        assert one(spark, value, lambda c: text.matches_format(c, kind)), value
    for value in bad:
        assert not one(spark, value, lambda c: text.matches_format(c, kind)), value


def test_patterns_survive_long_values(spark):
    """No recursion per repeat and no quadratic scans."""
    for kind, value in [
        ("price", "1" + ".1" * 200_000), ("number", "1" * 400_000 + "x"), ("text", "a " * 200_000 + "1"), ("html", "<" * 400_000),
    ]:
        one(spark, value, lambda c, k=kind: text.matches_format(c, k))
    for value in ["<script>" + "<" * 200_000 + "</script>x", "<" * 200_000 + ">x", "<a" * 200_000]:
        one(spark, value, lambda c: text.clean(c, "html"))


@pytest.mark.parametrize(
    ("value", "name", "kind"),
    [
        ("2024-01-15", "d", "phone"), ("15.01.2024", "d", "price"), ("01/02/2024", "d", "date"), ("12345678", "n", "phone"),
        ("42", "n", "price"), ("a@b.co", "x", "email"), ("x", "my_Email", "email"), ("x", "thumb_url", "url"), ("x", "update", "date"),
        ("<b>x</b>", "x", "html"), ("hello", "x", "text"), ("", "x", "text"), (None, "x", "object"),
    ],
)
def test_inference(spark, value, name, kind):
    assert one(spark, value, lambda c: text.infer_field(c, F.lit(name))["type"]) == kind


def test_inference_of_other_types(spark):
    row = spark.range(1).select(
        text.infer_field(F.lit(1.5), F.lit("x"), T.DoubleType()).alias("n"),
        text.infer_field(F.lit(True), F.lit("x"), T.BooleanType()).alias("b"),
        text.infer_field(F.array(F.lit(1)), F.lit("x"), T.ArrayType(T.IntegerType())).alias("a"),
        text.infer_field(F.struct(F.lit(1)), F.lit("x"), T.StructType()).alias("o"),
    ).first()
    assert [row[c]["type"] for c in "nbao"] == ["number", "boolean", "array", "object"]
    assert (row["a"]["min_length"], row["a"]["max_length"]) == (0, 200)


def test_page_urls(spark):
    rows = spark.createDataFrame(
        [("http://a/x", "query", None, None), ("http://a/x?b", "query", "p", None), ("http://a//", "path", None, None),
         ("http://a", "path", None, "s-"), ("http://a", "button", None, None)],
        "u string, t string, q string, p string",
    )
    made = rows.select(page_url(F.col("u"), F.lit(3), F.col("t"), F.col("q"), F.col("p"))).collect()
    assert [r[0] for r in made] == ["http://a/x?page=3", "http://a/x?b&p=3", "http://a//page/3", "http://a/s-3", "http://a"]


def test_truthiness(spark):
    row = spark.range(1).select(
        *[
            text.truthy(F.lit(v).cast(t), t).alias(f"c{i}")
            for i, (v, t) in enumerate(
                [("", T.StringType()), ("0", T.StringType()), (0, T.LongType()), (-1, T.LongType()), (float("nan"), T.DoubleType()),
                 (False, T.BooleanType()), (None, T.StringType())]
            )
        ]
    ).first()
    assert list(row) == [False, True, False, True, False, False, False]
