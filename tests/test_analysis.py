import pytest
from pyspark.sql import functions as F

from domweave.functions.selectors import css
from domweave.operators import analyze
from domweave.operators.dom import parse_pages
from domweave.operators.similar import similar_elements
from domweave.session import configure


def parsed(spark, *sources):
    configure(spark)
    return parse_pages(spark.createDataFrame(list(enumerate(sources)), "page_id long, html string"))


def by_page(frame):
    return {r["page_id"]: r for r in frame.collect()}


def test_limits_of_groups_and_patterns(spark):
    def page(groups, rows, items, cards):
        return (
            "<i class=g>x</i>" * groups + "<table>" + "<tr><td>1</tr>" * rows + "</table><ul>" + "<li>x" * items
            + "</ul>" + "<b class='c card'>y</b>" * cards
        )

    found = by_page(analyze.analyze_pages(parsed(spark, page(2, 2, 3, 2), page(3, 3, 4, 3))))
    assert found[0]["data_patterns"] == [] and found[0]["repeating_elements"] == []
    assert [p["type"] for p in found[1]["data_patterns"]] == ["table", "cards", "cards", "list"]
    assert [g["selector"] for g in found[1]["repeating_elements"]] == ["B.c", "I.g"]
    assert found[0]["confidence"] == 0.5
    assert found[1]["confidence"] == pytest.approx(0.5 + 0.15 + 0.15)
    assert found[0]["recommendations"] == ["low_confidence"]
    assert found[1]["recommendations"] == ["patterns_found", "repeating_elements"]


def test_advice_before_confidence_is_known(spark):
    dom = parsed(spark, "<main>" + "<p class=a>x" * 5)
    assert analyze.analyze_pages(dom).first()["recommendations"] == ["repeating_elements"]
    assert analyze.analyze_pages(dom, reference_order=True).first()["recommendations"][0] == "low_confidence"


def test_a_selector_with_a_thousand_matches_is_not_suggested(spark):
    dom = parsed(spark, "<a>x</a>" * 999, "<a>x</a>" * 1000)
    best = {(r["page_id"], r["suggestion"]): r["count"] for r in analyze.best_selectors(dom).collect()}
    assert best == {(0, "links"): 999}


def test_tied_types_go_to_the_later_one(spark):
    # post, four times as a class: blog and forum tie on elements, blog has the bonus as well
    dom = parsed(spark, "<i class=thread></i><i class=reply></i>" * 3, "<i class=comment></i><i class=reply></i>" * 6, "<p>plain")
    found = by_page(analyze.page_features(dom))
    assert [found[i]["page_type"] for i in range(3)] == ["forum", "forum", "general"]
    assert (found[1]["score_blog"], found[1]["score_forum"]) == (6, 6)


def test_main_content(spark):
    dom = parsed(
        spark, "<div class='x y'>ab</div><div>ab</div>", "<article><p></article><div role=main id=q>", "<p>no div", "<div></div>"
    )
    found = by_page(analyze.page_features(dom))
    assert found[0]["main_content"]["selector"] == "div.x" and found[0]["main_content"]["is_inferred"]
    assert found[1]["main_content"]["selector"] == '[role="main"]' and found[1]["main_content"]["id"] == "q"
    assert found[2]["main_content"] is None and found[3]["main_content"] is None


def test_nested_tables(spark):
    dom = parsed(
        spark,
        "<table id=a><tr><td><table id=b><tr><td>1<td>2<tr><td>3</table><td>x<tr><td>y</table><table id=c></table>",
    )
    rows = {r["selector"]: (r["rows"], r["columns"]) for r in analyze.tables(dom).collect()}
    # the first row of the outer table holds its own two cells and the three of the inner table
    assert rows == {"table#a": (4, 5), "table#b": (2, 2), "table#c": (0, 0)}


def test_two_titles_are_read_together(spark):
    dom = parsed(spark, "<title>Shop</title><title>cart</title><meta name=description content='BUY'>")
    row = analyze.page_features(dom).first()
    assert row["title"] == "Shopcart" and row["score_ecommerce"] == 3 + 3 + 2


def test_element_categories(spark):
    dom = parsed(spark, "<h1 class=page-title>x</h1><p class=item-text>y<button class=btn>")
    found = {r["category"]: r["elements"] for r in analyze.element_categories(dom).collect()}
    assert found == {"title": 1, "content": 1, "list": 1, "product": 1, "button": 1}


def test_similarity_brute_force(spark):
    source = "<div class='a b'><p>1</p></div><div class='a a'><p>2</p></div><span class='a b'><p>3</p></span><div class=a></div>"
    rows = similar_elements(parsed(spark, source), css("div"), 0.0).orderBy("node_id")
    scores = {r["node_id"]: round(r["similarity"], 6) for r in rows.collect()}
    assert scores[5] == 0.8  # tag .3 + one of two classes .2 + children .2 + parent .1
    assert scores[7] == 0.7  # other tag, both classes
    assert scores[9] == 0.6  # no child
    assert 3 not in scores


def test_job_selector_comes_from_the_first_page(spark):
    dom = parsed(spark, "<i class=product>x</i>" * 9 + "<title>shop cart</title>", "<p>nothing")
    jobs = spark.createDataFrame(
        [(1, 1, 0, ".x"), (1, 2, 1, ".x"), (2, 1, 1, ".y"), (2, 2, 0, ".y")],
        "job_id long, page_no int, page_id long, item_selector string",
    )
    found = analyze.adapt_jobs(jobs, analyze.analyze_pages(dom)).collect()
    assert {r["job_id"]: r["item_selector"] for r in found} == {1: ".product", 2: ".y"}


def test_confidence_buckets(spark):
    rows = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.39,)], "c double")
    assert [r[0] for r in rows.select(analyze.confidence_bucket(F.col("c"))).collect()] == ["high", "medium", "medium", "low"]


def test_members_of_containers_are_counted_inside_the_page(spark):
    # one mark per container, not one per row, cell, item or input: what leaves a page does not grow with its tables
    page = "<table>" + "<tr><td>1<td>2" * 40 + "</table><ul>" + "<li>x" * 30 + "</ul><form>" + "<input>" * 20 + "</form>"
    dom = parsed(spark, page, page.replace("<td>2", "<td>2<td>3"))
    marks = analyze.page_marks(dom, analyze.container_marks())
    assert marks.count() == 6
    counts = {(r["page_id"], r["box"]): (r["rows"], r["columns"], r["list_items"], r["inputs"]) for r in analyze.container_counts(dom).collect()}
    assert counts == {(i, kind): c for i in (0, 1) for kind, c in (("table", (40, 2 + i, 0, 0)), ("list", (0, 0, 30, 0)), ("form", (0, 0, 0, 20)))}


def test_containers_of_repeated_pages_add_up(spark):
    configure(spark)
    page = "<table id=a><tr><td>1<td>2<tr><td>3</table>"
    dom = parse_pages(spark.createDataFrame([(1, page), (1, page), (None, page)], "page_id long, html string"))
    rows = {r["page_id"]: (r["rows"], r["columns"]) for r in analyze.tables(dom).collect()}
    assert rows == {1: (4, 4), None: (2, 2)}


def test_what_a_page_holds_rules_no_match_out(spark):
    source = ("<div class='x card-big'><p id=content role=main>a</p></div><H2 class='Title post'>b</H2><ul class=item><li>c</ul>"
              "<i id='product'></i><b class=''>d</b>")
    dom = analyze.with_names(parsed(spark, source, "", "<p>x", None))
    listed = [*analyze.suggested_selectors(), *analyze.R.MAIN_CONTENT, *analyze.R.STRUCTURE_FLAGS.values(), *analyze.R.TYPE_BONUS_SELECTORS.values(),
              "p#content", "div > p", "ul li", "[id]", '[id^="prod"]', "*"]
    for row in dom.selectExpr(*[f"struct({css(s).hits()}.node_id AS plain, {analyze._hits(s)}.node_id AS kept) AS `{i}`" for i, s in enumerate(listed)]).collect():
        for name, found in zip(listed, row):
            assert found["plain"] == found["kept"], name
