import pytest
from pyspark.sql import functions as F

from domweave.functions.selectors import css
from domweave.functions.skew import join_per_key
from domweave.operators import crawl_log, jobs, paging, preview
from domweave.operators.dom import parse_pages
from domweave.operators.extract import extract_items
from domweave.session import configure, work_dir
from domweave.sources import jobs as job_files
from domweave.sources import writers
from domweave.sources.pages import read_pages


def test_salted_join_equals_the_plain_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    per_key = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        salted = join_per_key(rows, per_key, ["k"], ["id"], how)
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, rows.join(per_key, "k", how).collect()), key=str)


@pytest.mark.parametrize(("ms", "shown"), [(0, "0с"), (59_999, "59с"), (61_000, "1м 1с"), (3_600_000, "1ч 0м 0с"), (90_061_000, "25ч 1м 1с")])
def test_durations(spark, ms, shown):
    assert spark.range(1).select(jobs.format_duration(F.lit(ms))).first()[0] == shown


def test_quality(spark):
    def score(items, rate, errors, **options):
        return round(spark.range(1).select(jobs.quality_score(F.lit(items), F.lit(rate), F.lit(errors), **options)).first()[0], 6)

    assert score(0, 0.0, 0) == 0
    assert score(51, 0.0, 0) == 0.6
    assert score(1, 0.0, 9) == 0.0
    assert score(1, 50.0, 0) == 1.0
    assert score(1, 50.0, 0, normalized=True) == 0.45


def test_retry_rules(spark):
    rows = spark.createDataFrame(
        [("ETIMEDOUT", None, None), (None, 503, None), (None, 404, "network gone"), (None, 404, "timeout"), ("EPIPE", 400, "x"), (None, None, None)],
        "c string, s int, m string",
    )
    found = [r[0] for r in rows.select(crawl_log.is_retryable(F.col("c"), F.col("s"), F.col("m"))).collect()]
    assert found == [True, True, True, True, False, False]
    waits = spark.range(1, 6).select(crawl_log.retry_delay(F.col("id")), crawl_log.total_wait(F.col("id"))).collect()
    assert [tuple(r) for r in waits] == [(1000, 0), (2000, 1000), (4000, 3000), (8000, 7000), (10000, 15000)]


def test_pages_stop_at_the_first_without_a_marker(spark):
    rows = [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True), (2, 1, False), (2, 2, True), (3, 1, None), (3, 2, True)]
    taken = paging.take_while_next(spark.createDataFrame(rows, "job_id int, page_no int, has_next boolean"))
    assert sorted((r["job_id"], r["page_no"]) for r in taken.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


def test_button_markers(spark):
    configure(spark)
    sources = [
        "<a class=next>", "<a class='next disabled'>", "<a class=next disabled>", "<a class='next disabled'><a class=next>",
        "<a class=next style='display:none'>", "",
    ]
    dom = parse_pages(spark.createDataFrame(list(enumerate(sources)), "page_id int, html string"))

    def flags(**options):
        rows = paging.has_next_page(dom, "button", css(".next"), **options).orderBy("page_id").collect()
        return [r["has_next"] for r in rows]

    assert flags() == [True, False, True, False, True, False]
    assert flags(per_element=True) == [True, False, False, True, False, False]
    assert flags(button=css("b")) == [False] * 6


def test_one_snapshot_per_url(spark):
    pages = spark.createDataFrame([(1, "u"), (5, "u"), (3, "w")], "page_id long, url string")
    front = spark.createDataFrame([(1, 1, "u"), (2, 1, "u"), (2, 2, "gone")], "job_id int, page_no int, url string")
    assert sorted((r["job_id"], r["page_no"], r["page_id"]) for r in paging.visit(front, pages).collect() if r["page_id"]) == [(1, 1, 5), (2, 1, 5)]


def test_forced_and_unknown_extractors(spark):
    configure(spark)
    dom = parse_pages(spark.createDataFrame([(1, 1, "<p>a<p>b")], "job_id int, page_id int, html string"))
    known = jobs.Extractors().register("mine", lambda d: extract_items(d, "p", keys=("job_id", "page_id"), parts=("text",)))
    assert [r["text"] for r in known.run("mine", dom).orderBy("item_id").collect()] == ["a", "b"]
    with pytest.raises(KeyError):
        known.run("other", dom)


def nested(spark):
    return spark.createDataFrame(
        [(1, {"a": "x", "b": "y"}, [("h", "t, \"q\"\nz")], ("s", [1, 2])), (2, {"c": "z"}, None, None)],
        "id int, attrs map<string,string>, links array<struct<href:string,text:string>>, o struct<n:string,l:array<int>>",
    )


def test_flat_names_and_values(spark):
    items = nested(spark)
    keys = {"attrs": writers.map_keys(items, "attrs", ("id",))}
    assert writers.flat_names(items, keys) == ["id", "attrs.a", "attrs.b", "attrs.c", "links", "o.n", "o.l"]
    first = writers.flatten(items, keys).orderBy("id").first()
    assert tuple(first) == (1, "x", "y", None, '{"href":"h","text":"t, \\"q\\"\\nz"}', "s", "1; 2")


def test_exports_come_back(spark):
    items = nested(spark)
    path = work_dir(spark, "t")
    writers.write_items(items, path, "csv")
    back = spark.read.csv(path, header=True, escape='"', multiLine=True).orderBy("id").collect()
    assert back[0]["links"] == '{"href":"h","text":"t, \\"q\\"\\nz"}' and back[0]["o.l"] == "1; 2"
    path = work_dir(spark, "t")
    writers.write_items(items, path, "xml")
    assert spark.read.format("xml").option("rowTag", "item").load(path).count() == 2
    with pytest.raises(ValueError):
        writers.write_items(items, path, "pdf")


def test_missing_keys_are_left_out_of_json(spark):
    path = work_dir(spark, "t")
    writers.write_items(nested(spark), path, "json", summary=spark.range(1))
    lines = [r["value"] for r in spark.read.text(f"{path}/items").collect()]
    assert len(lines) == 2 and any("links" not in line for line in lines)
    assert spark.read.json(f"{path}/run_summary").count() == 1


def test_job_files(spark):
    path = work_dir(spark, "t")
    made = spark.createDataFrame([(1, "http://a", [("//a", "n")])], "job_id long, url string, xpath_selectors array<struct<xpath:string,name:string>>")
    job_files.write_jobs(made, path)
    row = jobs.with_defaults(job_files.read_jobs(spark, path)).first()
    assert (row["max_pages"], row["delay"], row["item_selector"], row["enable_smart_analysis"]) == (1, 1000, "body", True)
    assert row["xpath_selectors"][0]["name"] == "n" and row["tag_selectors"] == []


def test_raw_files_as_pages(spark):
    folder = work_dir(spark, "raw")
    spark.createDataFrame([("<p>a\n</p>",)], "value string").coalesce(1).write.text(folder)
    row = read_pages(spark, f"{folder}/part-*", "files").first()
    assert row["html"].startswith("<p>a") and row["url"].startswith("file:")


def test_preview(spark):
    items = spark.createDataFrame([(1, 1, i, f"t{i}") for i in range(7)] + [(2, 1, 1, None)], "job_id int, page_id int, item_id int, text string")
    rows = preview.preview_items(items).collect()
    assert sorted((r["job_id"], r["rank"]) for r in rows) == [(1, i) for i in range(1, 6)] + [(2, 1)]
    profile = preview.field_profile(items, ("job_id", "page_id", "item_id"), ("job_id", "item_id")).first()
    assert (profile["values"], profile["samples"], profile["types"]) == (7, ["t0", "t1", "t2"], ["text"])
    exported = {r["field"]: r["type"] for r in preview.exported_schema(items).where("job_id = 1").collect()}
    assert exported == {"page_id": "number", "item_id": "number", "text": "text"}


def test_newest_snapshot_by_time(spark):
    pages = spark.sql("SELECT * FROM VALUES (9, 'u', timestamp'2024-01-01'), (3, 'u', timestamp'2024-05-01'), (4, 'v', null), (2, 'w', timestamp'2024-01-01'), "
                      "(5, 'w', timestamp'2024-01-01') AS t(page_id, url, fetched_at)")
    assert {r.url: r.page_id for r in paging.latest_snapshots(pages).collect()} == {"u": 3, "v": 4, "w": 5}
    assert {r.url: r.page_id for r in paging.latest_snapshots(pages.drop("fetched_at")).collect()} == {"u": 9, "v": 4, "w": 5}


def test_exported_configurations(spark):
    texts = [
        '{"jobId": 5, "url": "https://a.org", "maxPages": "7", "enableSmartAnalysis": false, "paginationConfig": {"nextPageXPath": "//a", "nextButtonSelector": ".n"},'
        ' "xpathSelectors": ["//h1", {"xpath": "//a", "name": "l", "multiple": true}], "tagSelectors": [{"name": "n", "tag": "p"}, "h2"], "usePuppeteer": true}',
        "{}", "[1]", "not json", "null", '{"maxPages": "many", "xpathSelectors": "//h1", "spa": "yes"}',
    ]
    rows = job_files.jobs_from_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")).orderBy("n").collect()
    one = rows[0]
    assert (one.job_id, one.max_pages, one.enable_smart_analysis, one.use_puppeteer, one.spa) == (5, 7, False, True, None)
    assert (one.pagination.next_page_xpath, one.pagination.next_button_selector, one.pagination.query_param) == ("//a", ".n", None)
    assert [(s.xpath, s.name, s.multiple) for s in one.xpath_selectors] == [("//h1", None, None), ("//a", "l", True)]
    assert [(s.name, s.tag) for s in one.tag_selectors] == [("n", "p"), (None, "h2")]
    assert [r.corrupt for r in rows] == [None, None, "[1]", "not json", "null", None]
    assert (rows[5].max_pages, rows[5].xpath_selectors, rows[5].spa) == (None, None, None) or rows[5].spa in (True, None)
