"""Rules held as data against selectors written into the plan, and whole runs of mixed jobs."""

import pytest
from pyspark.sql import functions as F

from domweave.functions.selectors import css, xpath
from domweave.operators import rule_sets as rs
from domweave.operators.dom import parse_pages
from domweave.operators.extract import matches
from domweave.operators.jobs import JOB_SCHEMA, with_defaults
from domweave.plans import scrape
from domweave.session import configure

PAGES = {
    1: """<html><body><div id="main" class="a b"><ul class="list"><li class="x">one</li><li class="x y">two<a href="/1" class="next">n</a></li>
          <li>three <b><i class="x">deep</i></b></li></ul><p data-k="v1">p</p><p data-k="">q</p></div><div class="ab"><p><a href="">e</a></p></div></body></html>""",
    2: "<div><div class='a'><div class='b'><div class='a'><span class='c'>s</span></div></div></div><span class='c'>t</span></div>",
    3: "",
    4: "<div class='x'>" * 60 + "<a href='/deep'>d</a>" + "</div>" * 60,
}
CSS = [
    "li", ".x", "#main", "li.x", "li.x.y", "[data-k]", "[data-k=v1]", "[class*=a]", "[class^='a']", "[data-k$='1']", "ul > li", "div li.x", "div > p",
    "#main .x, .ab a", "div.a div.a span.c", ".a > .b > .a", ".a .b .c", "body > div > p > a", "li:nth-of-type(2)", "ul li:nth-of-type(3) > b i", "*", "div div > div a",
    ".x .x .x > a", "[id]", "nothing", "div.a > span.c",
]
XPATH = ["//li", "//li[2]", "//div[@id='main']//li", "//*[contains(@class,'x')]", "//ul/li/a[@href]", "//p[@data-k='v1']|//a", "/html/body/div", "//div[@class='a']//span"]


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    configure(spark)


@pytest.fixture(scope="module")
def dom(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "page_id long, html string")
    return parse_pages(pages).cache()


def jobs_of(spark, jobs):
    base = {"url": "https://a.org/", "max_pages": 5, "enable_smart_analysis": False, "pagination_type": "none"}
    schema = spark.createDataFrame([], JOB_SCHEMA).schema
    return with_defaults(spark.createDataFrame([base | {"job_id": i} | job for i, job in enumerate(jobs)], schema))


def evaluated(spark, dom, jobs):
    job_sets, sets = rs.rule_sets(jobs_of(spark, jobs))
    wanted = dom.select("page_id").crossJoin(job_sets.select("set_id").distinct())
    return rs.evaluate(dom, wanted, sets).join(job_sets, "set_id")


def test_items_equal_those_of_selectors_in_the_plan(spark, dom):
    jobs = [{"item_selector": s, "strategy": "cheerio"} for s in CSS] + [{"item_selector": s, "strategy": "xpath"} for s in XPATH]
    found = evaluated(spark, dom, jobs).where(F.col("item_id") != rs.MARK)
    # an item without text is dropped by the static extractor, and kept by the other for its tag
    got = {(r.job_id, r.page_id, r.item_id) for r in found.collect()}
    for i, selector in enumerate([css(s) for s in CSS] + [xpath(s) for s in XPATH]):
        rows = matches(dom, selector, "page_id", "doc_text", "nodes")
        want = {(i, r.page_id, r.node_id) for r in rows.select("page_id", "node_id", "trim_start", "trim_end").collect() if i >= len(CSS) or r.trim_end > r.trim_start}
        kept = {g for g in got if g[0] == i}
        # images and links keep items without text as well
        assert want <= kept and all((j, p, n) in want or PAGES[p] for j, p, n in kept - want), selector.text
        if i >= len(CSS):
            assert kept == want, selector.text


def test_fields_and_parts(spark, dom):
    tags = lambda *t: [{n: e.get(n) for n in ("name", "tag", "selector", "attribute")} for e in t]
    xs = lambda *t: [{n: e.get(n) for n in ("xpath", "name", "type", "attribute", "multiple", "fallback")} for e in t]
    jobs = [
        {"item_selector": "#main", "strategy": "cheerio", "tag_selectors": tags(
            {"name": "n", "tag": "li"}, {"name": "n", "selector": "b"}, {"selector": "p"}, {"tag": "img"}, {"name": "bad", "selector": "p::x"})},
        {"item_selector": "#main", "strategy": "puppeteer", "tag_selectors": tags(
            {"tag": "i", "selector": "li"}, {"tag": "b", "selector": ".list > .x"}, {"tag": "p", "attribute": "data-k"}, {"tag": "a", "selector": "#main"})},
        {"item_selector": "#main", "strategy": "xpath", "xpath_selectors": xs(
            {"xpath": "//li[@class='zz']", "name": "f", "fallback": "//li", "multiple": True}, {"xpath": "//b", "name": "h", "type": "html"},
            {"xpath": "//p", "name": "k", "type": "attribute", "attribute": "data-k", "multiple": True}, {"xpath": "//li[1]"}),
         "tag_selectors": tags({"tag": "i", "selector": "ul"}, {"tag": "a", "selector": ".list", "attribute": "href"}, {"tag": "p"})},
    ]
    found = {r.job_id: r for r in evaluated(spark, dom, jobs).where("item_id >= 0 AND page_id = 1").collect()}
    assert found[0].fields == {"n": ["deep"], "p": ["p", "q"]}
    assert [(x.href, x.text) for x in found[0].links] == [("/1", "n")] and found[0].images is None and found[0].html is None
    assert found[1].fields == {"i": ["deep"], "p": ["v1"]}
    assert found[1].text is None and found[1].attributes == {"id": "main", "class": "a b"} and found[1].html.startswith("<ul")
    assert found[2].fields == {
        "f": ["one", "twon", "three deep"], "h": ['<i class="x">deep</i>'], "k": ["v1"], "xpath_field_4": ["one"], "i": ["deep"], "a": ["/1"], "p": ["p", "q"]}
    assert found[2].tag_name == "div" and found[2].text.startswith("one")


def test_nested_items_share_their_fields(spark, dom):
    job = {"item_selector": "div", "strategy": "cheerio", "tag_selectors": [{"name": None, "tag": "span", "selector": None, "attribute": None}]}
    found = {r.item_id: r.fields for r in evaluated(spark, dom, [job]).where("page_id = 2 AND item_id >= 0").collect()}
    assert sorted(len(f["span"]) for f in found.values()) == [1, 1, 1, 2]


NEXT = "<html><body><p>t</p><a class='next{}' {}>n</a><a class='go' href='#'>g</a></body></html>"


@pytest.mark.parametrize("strategy, paging, config, html, more", [
    ("cheerio", "query", {"next_page_selector": ".next"}, NEXT.format("", ""), True),
    ("cheerio", "query", {"next_page_selector": ".none"}, NEXT.format("", ""), False),
    ("cheerio", "query", {"next_button_selector": ".next"}, NEXT.format("", ""), False),
    ("cheerio", "none", {"next_page_selector": ".next"}, NEXT.format("", ""), False),
    ("cheerio", "button", {"next_page_selector": ".go", "next_button_selector": ".next"}, NEXT.format(" disabled", ""), False),
    ("cheerio", "button", {"next_page_selector": ".go", "next_button_selector": ".next"}, NEXT.format("", "disabled"), True),
    ("cheerio", "infinite", {"next_page_selector": ".none", "load_more_selector": ".go"}, NEXT.format("", ""), True),
    ("puppeteer", "path", {"next_page_selector": ".next"}, NEXT.format(" disabled", ""), True),
    ("smart-puppeteer", "button", {"next_page_selector": ".next"}, NEXT.format("", "disabled"), False),
    ("smart-puppeteer", "button", {"next_page_selector": ".next"}, NEXT.format("", "style='display: none'"), False),
    ("smart-puppeteer", "button", {"next_page_selector": "a"}, NEXT.format(" disabled", ""), True),
    ("xpath", "none", {"next_page_selector": ".next"}, NEXT.format("", ""), True),
    ("xpath", "query", {"next_page_selector": ".none", "next_page_xpath": "//a[@href]"}, NEXT.format("", ""), True),
    ("xpath", "query", {}, NEXT.format("", ""), False),
    ("cheerio", "query", {"next_page_selector": "a"}, "", False),
])
def test_markers(spark, strategy, paging, config, html, more):
    dom = parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    job = {"item_selector": "p", "strategy": strategy, "pagination_type": paging, "pagination": config}
    mark = evaluated(spark, dom, [job]).where(F.col("item_id") == rs.MARK).collect()
    assert [m.has_next for m in mark] == [more]


def test_equal_rules_are_one_set(spark):
    job = {"item_selector": ".x", "strategy": "cheerio"}
    job_sets, sets = rs.rule_sets(jobs_of(spark, [job, job, job | {"max_pages": 9}, job | {"item_selector": ".y"}]))
    assert sets.count() == 2 and job_sets.count() == 4


def test_run_with_gaps_failures_and_adaptation(spark):
    shop = "<html><head><title>shop cart product buy price</title></head><body>%s<a class='next' href='#'>n</a></body></html>"
    cards = "".join(f"<div class='product'><h2 class='title'>t{i}</h2></div>" for i in range(4))
    pages = [(i, f"https://s.org/l?page={i}", shop % cards) for i in (1, 2, 4)] + [(9, "https://t.org/", "<p class='x'>only</p>")]
    base = {"enable_smart_analysis": False, "delay": 0, "max_pages": 5}
    jobs = [
        {"job_id": 1, "url": "https://s.org/l", "item_selector": ".product", "strategy": "cheerio", "pagination": {"next_page_selector": ".next"}},
        {"job_id": 2, "url": "https://s.org/l", "item_selector": "body", "strategy": "smart-puppeteer", "enable_smart_analysis": True, "max_pages": 2,
         "pagination": {"next_page_selector": ".next"}},
        {"job_id": 3, "url": "https://t.org/", "item_selector": "//p", "strategy": "cheerio", "pagination_type": "none"},
        {"job_id": 4, "url": "https://t.org/", "item_selector": ".none", "strategy": "xpath", "pagination_type": "none"},
        {"job_id": 5, "url": "https://gone.org/", "item_selector": "p", "strategy": "smart-puppeteer", "pagination_type": "none"},
        {"job_id": 6, "url": "not a url", "item_selector": "p", "strategy": "cheerio"},
        {"job_id": 7, "url": "https://t.org/", "item_selector": "p::x", "strategy": "puppeteer", "pagination_type": "none"},
    ]
    schema = spark.createDataFrame([], JOB_SCHEMA).schema
    items, summary = scrape.run_mixed(
        spark.createDataFrame([base | j for j in jobs], schema), spark.createDataFrame(pages, "page_id long, url string, html string"))
    counted = {(r.job_id, r.extractor): r["count"] for r in items.groupBy("job_id", "extractor").count().collect()}
    assert counted == {(1, "cheerio"): 8, (2, "smart-puppeteer"): 8, (3, "xpath"): 1}
    got = {r.job_id: r for r in summary.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 7]
    assert (got[1].pages_processed, got[1].failed_requests, got[1].fallback) == (2, 1, None)
    assert got[1].bytes_processed == 2 * len(shop % cards) and round(got[1].success_rate, 3) == 66.667
    assert (got[2].total_items, got[2].pages_processed, got[2].failed_requests) == (8, 2, 0)
    assert (got[3].fallback, got[3].total_items, got[3].success_rate, got[3].quality) == ("xpath", 1, 50.0, 0.0)
    # an expression that finds nothing is no failure
    assert (got[4].total_items, got[4].failed_requests, got[4].quality, got[4].fallback) == (0, 0, 1.0, None)
    assert [(got[i].fallback, got[i].total_items, got[i].failed_requests, got[i].success_rate) for i in (5, 7)] == [(None, 0, 1, 0.0)] * 2
