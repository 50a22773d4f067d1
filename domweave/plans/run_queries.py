"""Queries of whole runs in which every job brings its own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.operators.extract import extract_items
from domweave.operators.jobs import JOB_SCHEMA, Extractors
from domweave.plans import rendered, scrape
from domweave.plans.page_queries import parsed
from domweave.plans.registry import query, table
from domweave.session import written

#: Pages of the four sites have ids of their own.
SITE = 1_000_000_000


def sites(spark, sf_dir) -> DataFrame:
    """Shop, ledger, forum and notes pages as one table."""
    made = [rendered.catalog, rendered.ledger, rendered.threads, rendered.notes]
    pages = [build(spark, sf_dir).withColumn("page_id", F.col("page_id") + i * SITE) for i, build in enumerate(made)]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return written(out, "sites")


def _selectors(*entries: dict) -> list[dict]:
    names = ("name", "tag", "selector", "attribute")
    return [{n: e.get(n) for n in names} for e in entries]


def _expressions(*entries: dict) -> list[dict]:
    names = ("xpath", "name", "type", "attribute", "multiple", "fallback")
    return [{n: e.get(n) for n in names} for e in entries]


#: One job for each nation, of the kind that its key names; ``$k`` is the job's key.
KINDS = [
    # a list by query, static rules; the first name is taken twice, the later rule wins
    {"url": "https://shop.example.com/list", "item_selector": ".product", "pagination_type": "query", "strategy": "cheerio",
     "pagination": {"next_page_selector": "main > a.next[href]"},
     "tag_selectors": _selectors({"name": "label", "tag": "img"}, {"name": "label", "selector": "h2.title"}, {"tag": "span"}, {"selector": "table"})},
    # pages by path, expressions with a fallback, an attribute and a tag
    {"url": "https://ledger.example.com/", "item_selector": "//tr[@class='row']", "pagination_type": "path", "strategy": "xpath",
     "pagination": {"next_page_xpath": "//table[@id='t']//td[contains(@class,'tot')]"},
     "xpath_selectors": _expressions(
         {"xpath": "/td[1]", "name": "key"}, {"xpath": "//td[@class='none']", "name": "status", "fallback": "//td[@class='status']"},
         {"xpath": "//td", "name": "classes", "type": "attribute", "attribute": "class", "multiple": True}),
     "tag_selectors": _selectors({"tag": "td"})},
    # one page with a button, browser rules: a tag below a selector, an attribute
    {"url": "https://shop.example.com/list?page=$k", "item_selector": "main, .absent", "pagination_type": "button", "strategy": "puppeteer",
     "pagination": {"next_page_selector": ".next", "next_button_selector": "a.next"},
     "tag_selectors": _selectors({"tag": "img", "attribute": "alt"}, {"tag": "a", "selector": "div[data-id]"}, {"tag": "h2", "selector": "h2"})},
    # an expression where the static extractor wants a selector: it fails, and expressions take over
    {"url": "https://notes.example.com/$k", "item_selector": "//div[contains(@class,'hot')]", "pagination_type": "none", "strategy": "cheerio",
     "tag_selectors": _selectors({"tag": "p"})},
    # two failures before the winner; the page of every other job is not stored at all
    {"url": "https://notes.example.com/$h", "item_selector": "//div[@class='note cold']/div", "pagination_type": "none", "strategy": "puppeteer"},
]


def jobs(spark, sf_dir, pages: int = 40) -> DataFrame:
    """A job for each nation; ``KINDS`` tells which."""
    base = {"enable_smart_analysis": False, "max_pages": pages, "delay": 0}
    kinds = [base | kind | {"job_id": i} for i, kind in enumerate(KINDS)]
    rules = spark.createDataFrame(kinds, schema=spark.createDataFrame([], JOB_SCHEMA).schema).withColumnRenamed("job_id", "kind")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("job_id"), (F.col("n_nationkey") % len(KINDS)).cast("bigint").alias("kind"))
    key = F.col("job_id").cast("string")
    other = F.when(F.col("job_id") % 2 == 0, key).otherwise("gone")
    made = nations.join(rules, "kind").drop("kind")
    return made.withColumn("url", F.replace(F.replace("url", F.lit("$k"), key), F.lit("$h"), other))


_MIXED = """
    j AS (SELECT CAST(n_nationkey AS BIGINT) AS job_id, n_nationkey % 5 AS kind FROM nation),
    shop AS (
      SELECT job_id, 'cheerio' AS extractor, p_partkey // 20 + 1 AS page_no, p_partkey AS k,
        p_name || '|$' || printf('%.2f', p_retailprice) AS v
      FROM j JOIN part ON kind = 0 AND p_partkey // 20 < 40),
    ledger AS (
      SELECT job_id, 'xpath', o_orderkey // 25 + 1, o_orderkey,
        o_orderkey || '|' || o_orderstatus || '|status,total|' || o_orderkey || ',' || o_orderstatus || ',' || printf('%.2f', o_totalprice)
      FROM j JOIN orders ON kind = 1 AND o_orderkey // 25 < 40),
    cards AS (
      SELECT job_id, 'puppeteer', 1, 0, string_agg(p_type, ',' ORDER BY p_partkey) || '|' || string_agg(p_brand, ',' ORDER BY p_partkey)
      FROM j JOIN part ON kind = 2 AND p_partkey // 20 = job_id - 1 GROUP BY job_id),
    hot AS (
      SELECT job_id, 'xpath', 1, c_custkey, 'nation ' || c_nationkey || ',balance' FROM j JOIN customer ON kind = 3 AND c_custkey // 30 = job_id AND c_custkey % 3 = 0),
    cold AS (
      SELECT job_id, 'xpath', 1, c_custkey, c_name FROM j JOIN customer ON kind = 4 AND job_id % 2 = 0 AND c_custkey // 30 = job_id AND c_custkey % 3 <> 0),
    every AS (SELECT * FROM shop UNION ALL SELECT * FROM ledger UNION ALL SELECT * FROM cards UNION ALL SELECT * FROM hot UNION ALL SELECT * FROM cold)
"""


def _run(spark, sf_dir):
    return scrape.run_mixed(jobs(spark, sf_dir), sites(spark, sf_dir))


@query("job_run_mixed", f"WITH {_MIXED} SELECT job_id, extractor, CAST(page_no AS INT) AS page_no, v AS value FROM every")
def job_run_mixed(spark, sf_dir):
    """Items of jobs with five rule sets, four paging types and three extractors, one parse."""
    items, _ = _run(spark, sf_dir)

    def all_of(*names):
        return F.concat_ws("|", *[F.array_join(F.try_element_at("fields", F.lit(n)), ",") for n in names])

    # fields of each kind, in the order of its rules; an item without rules shows its text
    value = F.coalesce(F.nullif(all_of("label", "span", "table", "key", "status", "classes", "td", "img", "a", "h2", "p"), F.lit("")), "text")
    return items.select("job_id", "extractor", "page_no", value.alias("value"))


@query(
    "job_run_summary",
    f"""
    WITH {_MIXED},
    items AS (SELECT job_id, any_value(extractor) AS extractor, count(*) AS n, count(DISTINCT page_no) AS pages FROM every GROUP BY job_id),
    d AS (
      SELECT job_id, kind, coalesce(n, 0) AS total_items, coalesce(pages, 0) AS pages,
        CASE kind WHEN 1 THEN 'xpath' WHEN 2 THEN 'puppeteer' WHEN 4 THEN 'puppeteer' ELSE 'cheerio' END AS strategy,
        CASE WHEN kind IN (3, 4) AND n > 0 THEN 'xpath' END AS fallback,
        -- a list ends at its limit of 40 pages or at the first page that is not stored
        CASE WHEN kind >= 3 THEN 1 WHEN kind = 2 THEN CAST(coalesce(pages, 0) = 0 AS INT) ELSE CAST(coalesce(pages, 0) < 40 AS INT) END AS failed
      FROM j LEFT JOIN items USING (job_id))
    SELECT job_id, strategy, fallback, total_items, CAST(pages AS BIGINT) AS pages_processed, CAST(failed AS BIGINT) AS failed_requests,
      CAST(failed AS BIGINT) AS errors, CASE WHEN pages + failed > 0 THEN 100.0::DOUBLE * pages / (pages + failed) ELSE 0.0::DOUBLE END AS success_rate
    FROM d
    """,
)
def job_run_summary(spark, sf_dir):
    """What the jobs of `job_run_mixed` did, one row each."""
    _, summary = _run(spark, sf_dir)
    return summary.select("job_id", "strategy", "fallback", "total_items", "pages_processed", "failed_requests", "errors", "success_rate")


@query(
    "job_run_validated",
    f"""
    -- prices lose their thousands to a length limit that each job sets for itself; notes have several values, which are not checked
    WITH {_MIXED}, shop_items AS (
      SELECT job_id, p_name AS label, '$' || printf('%.2f', p_retailprice) AS span, 7 + (job_id // 5) % 2 AS most
      FROM j JOIN part ON kind = 0 AND p_partkey // 20 < 40),
    good AS (SELECT *, length(span) <= most AS ok, count(*) FILTER (WHERE length(span) <= most) OVER (PARTITION BY job_id) AS n_ok FROM shop_items)
    SELECT job_id, count(*) AS items, string_agg(span, ',' ORDER BY span) AS prices FROM good WHERE ok OR n_ok = 0 GROUP BY job_id
    UNION ALL SELECT job_id, count(*), '' FROM hot GROUP BY job_id
    """,
)
def job_run_validated(spark, sf_dir):
    """Values of mixed jobs, cleaned and checked by rules that are rows of a table."""
    some = jobs(spark, sf_dir).where("strategy = 'cheerio'")
    items, _ = scrape.run_mixed(some, sites(spark, sf_dir))
    most = (7 + F.floor(F.col("job_id") / 5) % 2).cast("int")
    rules = some.select(
        "job_id", F.lit("span").alias("field"), F.lit("price").alias("type"), F.lit(False).alias("required"), F.lit(1).alias("min_length"), most.alias("max_length"))
    kept, _, _ = scrape.validate_mixed(items, some, rules)
    price = F.get(F.try_element_at("fields", F.lit("span")), 0)
    return kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.sort_array(F.collect_list(price)), ",").alias("prices"))


@query(
    "job_preview_mixed",
    """
    WITH j AS (SELECT CAST(n_nationkey AS BIGINT) AS job_id FROM nation WHERE n_nationkey % 5 = 0),
    i AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rank FROM part WHERE p_partkey < 20),
    f AS (
      SELECT rank, unnest(['text', 'links', 'images', 'label', 'span']) AS field, unnest([
        p_name || '$' || printf('%.2f', p_retailprice) || p_brand, p_brand || ' → /p/' || p_partkey, p_type || ' → /i/' || p_partkey || '.png', p_name,
        '$' || printf('%.2f', p_retailprice)]) AS value FROM i WHERE rank <= 5)
    SELECT job_id, field, CASE WHEN field IN ('links', 'images') THEN 'array' ELSE 'text' END AS types,
      string_agg(value, '|' ORDER BY rank) FILTER (WHERE rank <= 3) AS samples, (SELECT count(*) FROM i) AS total_found,
      CASE WHEN (SELECT count(*) FROM i) < 5 THEN 'few_items' END AS advice
    FROM j, f GROUP BY job_id, field
    """,
)
def job_preview_mixed(spark, sf_dir):
    """Fields, types and samples of list jobs, by their own rules."""
    some = jobs(spark, sf_dir).where("job_id % 5 = 0")
    _, structure, totals = scrape.preview_mixed(some, sites(spark, sf_dir))
    return structure.join(totals, "job_id").select(
        "job_id", "field", F.array_join("types", ",").alias("types"), F.array_join("samples", "|").alias("samples"), "total_found", "advice")


@query(
    "forced_extractor",
    """
    -- the static rules find products; the forced ones look for links to more, of which the page has one besides
    SELECT p_partkey // 20 AS page_id, 'links' AS extractor, count(*) + 1 AS items FROM part GROUP BY 1
    """,
)
def forced_extractor(spark, sf_dir):
    """An extractor chosen by name runs alone, whatever its result is worth."""
    known = Extractors().register("cards", lambda dom: extract_items(dom, ".product", parts=("text",))).register(
        "links", lambda dom: extract_items(dom, "a[href]", parts=("text",)))
    return known.run("links", parsed(rendered.catalog(spark, sf_dir))).groupBy("page_id", "extractor").agg(F.count(F.lit(1)).alias("items"))
