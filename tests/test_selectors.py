import pytest

from domweave.functions.selectors import css, css_to_xpath, rewrite_xpath, xpath, xpath_error
from domweave.operators.dom import elements, parse_pages, text_of
from domweave.operators.extract import Field, extract_items, interactive_extras, matches
from domweave.session import configure
from pyspark.sql import functions as F

PAGE = """
<main id=m><div class="card big" data-k=1><h2>one</h2><a href=/1>x</a><a>no</a></div>
<div class=card-wide><h2 class=card>two</h2><div class=card><p>in<p>ner</div></div></main>
<div class=card style="color:red; display: none" onclick=f()>three<img src=i.png></div>
"""


@pytest.fixture(scope="module")
def dom(spark):
    configure(spark)
    return parse_pages(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).cache()


def texts(dom, selector):
    rows = matches(dom, selector, "page_id", "doc_text").orderBy("node_id").select(text_of().alias("t")).collect()
    return [r["t"] for r in rows]


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("h2", ["one", "two"]),
        (".card", ["onexno", "two", "inner", "three"]),
        ('[class*="card"]', ["onexno", "two\ninner"[:3] + "inner", "two", "inner", "three"]),
        ("div.card", ["onexno", "inner", "three"]),
        ("#m .card h2", ["one"]),
        ("main > div", ["onexno", "twoinner"]),
        ("main > .card, .card, h2", ["onexno", "one", "two", "inner", "three"]),
        ("a[href]", ["x"]),
        ('[data-k="1"] > a:nth-of-type(2)', ["no"]),
        ('[class^="card-"]', ["twoinner"]),
        ('[class$="big"]', ["onexno"]),
        ("div div p", ["in", "ner"]),
        ("table", []),
    ],
)
def test_css(dom, selector, found):
    assert texts(dom, css(selector)) == found


@pytest.mark.parametrize(
    ("expression", "found"),
    [
        ("//h2", ["one", "two"]),
        ("//*[contains(@class,'card')]", ["onexno", "twoinner", "two", "inner", "three"]),
        ("//div[@data-k='1']//a[2]", ["no"]),
        ("//main/div/h2", ["one", "two"]),
        ("//a[@href]", ["x"]),
        ("//div[contains(@class,'card') and contains(@class,'big')]", ["onexno"]),
        ("//h2|//p", ["one", "two", "in", "ner"]),
    ],
)
def test_xpath(dom, expression, found):
    assert texts(dom, xpath(expression)) == found


@pytest.mark.parametrize("text", ["a::before", "div:hover", "", ">", "a{}"])
def test_unsupported_css_is_refused(text):
    with pytest.raises(ValueError):
        css(text)


def test_nested_items_keep_their_own_fields(dom):
    fields = [Field.static("h2"), Field.scoped("p", "div"), Field.by_xpath("//p", "first")]
    rows = extract_items(dom, "div", fields, parts=("text", "links", "images")).orderBy("item_id").collect()
    assert [r["h2"] for r in rows] == [["one"], ["two"], None, None]
    # the inner div is an item too, and p is below a div only for the outer one
    assert [r["p"] for r in rows] == [None, ["in", "ner"], None, None]
    assert [r["first"] for r in rows] == [None, "in", "in", None]
    assert [[tuple(x) for x in r["links"] or []] for r in rows] == [[("/1", "x")], [], [], []]
    assert [[tuple(x) for x in r["images"] or []] for r in rows] == [[], [], [], [("i.png", "")]]


def test_interactive_extras(dom):
    row = interactive_extras(elements(dom)).where(F.col("has_click_handler")).first()
    assert row["is_hidden"] and row["data_attributes"] == {}


@pytest.mark.parametrize(
    ("selector", "expression"),
    [
        ("#a", "//*[@id='a']"),
        (".a .b", "//*[contains(@class,'a .b')]"),
        ('div[x="1"]', "//div[@x='1']"),
        ("[x]", "//*[@x]"),
        ("div.card", "//div.card"),
        ("a > b >c", "//a/b/c"),
        ("a  b", "//a//b"),
        ("a.b[c]", ""),
        ("div[a=b] x[1]", "//div[@a='b] x[1']"),
    ],
)
def test_css_strings(spark, selector, expression):
    made = spark.createDataFrame([(selector,)], "s string").select(css_to_xpath(F.col("s"))).first()[0]
    assert made == expression


def test_expression_checks(spark):
    rows = spark.createDataFrame([("//a[",), ("a",), (None,), ("//a[@b='c]",), ("//a",)], "s string")
    found = [r[0] for r in rows.select(xpath_error(F.col("s"))).collect()]
    assert found == ["unbalanced_brackets", "no_leading_slash", "not_a_string", "unbalanced_quotes", None]
    row = spark.createDataFrame([("////a[@class='x'][position()=1]",)], "s string").select(rewrite_xpath(F.col("s")))
    assert row.first()[0] == "//a[contains(@class,'x')][1]"


def test_a_locator_makes_its_path_once(spark):
    from domweave.operators import similar
    from domweave.operators.dom import parse_pages

    assert "aggregate(" not in similar.smart_locator_sql(path="NULL")
    pages = spark.createDataFrame([(1, "<div id=a><p>x<p class=k>y<b>z</b></div>")], "page_id long, html string")
    got = {r.tag + str(r.node_id): (r.locator, r.path) for r in similar.locators(parse_pages(pages)).collect()}
    assert got["div3"] == ("//div[@id='a']", "//div")
    assert got["p4"] == ("//div/p[1]", "//div/p[1]")
    assert got["p5"] == ("//p[contains(@class,'k')]", "//div/p[2]")
    assert got["b6"] == ("//div/p[2]/b", "//div/p[2]/b")
