"""Queries on jobs, paging, crawl logs, previews, selector strings and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from domweave.functions import selectors as sel
from domweave.functions import text
from domweave.functions.selectors import css, xpath
from domweave.functions.urls import is_valid_url
from domweave.operators import crawl_log, jobs, paging, preview
from domweave.operators.extract import Field, extract_items
from domweave.operators.validate import FieldRule, Schema
from domweave.plans import rendered, scrape
from domweave.plans import rules as R
from domweave.plans.page_queries import parsed
from domweave.plans.registry import query, table
from domweave.session import work_dir, written
from domweave.sources import jobs as job_files
from domweave.sources import writers
from domweave.sources.pages import read_pages, spread

# ---- jobs derived from customers ---------------------------------------------------

RAW_JOBS_SQL = """
  SELECT c_custkey AS job_id,
    CASE c_custkey % 6 WHEN 0 THEN 'https://shop.example.com/list' WHEN 1 THEN 'https://ledger.example.com/'
      WHEN 2 THEN 'https://shop.example.com/list?sort=1' WHEN 3 THEN 'not a url' WHEN 4 THEN '' ELSE 'https://none.example.com/x' END AS url,
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '.item' END AS item_selector,
    CASE c_custkey % 6 WHEN 0 THEN 'query' WHEN 1 THEN 'path' WHEN 2 THEN 'query' WHEN 3 THEN 'button' WHEN 4 THEN 'sideways' ELSE NULL END AS pagination_type,
    CASE WHEN c_custkey % 6 = 2 THEN 'p' ELSE NULL END AS query_param,
    CASE c_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN NULL ELSE 2000 END AS max_pages,
    CASE c_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 2500 ELSE NULL END AS delay,
    CASE c_custkey % 7 WHEN 0 THEN 'cheerio' WHEN 1 THEN 'xpath' WHEN 2 THEN 'smart-puppeteer' WHEN 3 THEN 'magic' WHEN 4 THEN '' ELSE NULL END AS strategy,
    c_custkey % 5 = 0 AS spa, c_custkey % 11 = 0 AS infinite_scrolling,
    CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_custkey % 3 = 1 THEN NULL ELSE true END AS enable_smart_analysis,
    c_custkey % 2 = 0 AS use_puppeteer, c_custkey % 8 AS n_xpath, c_custkey % 60 AS n_tags,
    CASE WHEN c_custkey % 9 = 0 THEN 'doc' WHEN c_custkey % 9 = 1 THEN 'csv' ELSE NULL END AS file_extension,
    CASE WHEN c_custkey % 13 = 0 THEN 'never' ELSE NULL END AS wait_strategy
  FROM customer
"""
JOBS_SQL = f"""
  SELECT job_id, url, coalesce(nullif(item_selector, ''), 'body') AS item_selector, coalesce(nullif(pagination_type, ''), 'query') AS pagination_type,
    query_param, coalesce(nullif(max_pages, 0), 1) AS max_pages, coalesce(nullif(delay, 0), 1000) AS delay, nullif(strategy, '') AS strategy, spa, infinite_scrolling,
    coalesce(enable_smart_analysis, true) AS enable_smart_analysis, use_puppeteer, n_xpath, n_tags, coalesce(file_extension, 'json') AS file_extension,
    coalesce(wait_strategy, 'networkidle2') AS wait_strategy
  FROM ({RAW_JOBS_SQL})
"""


def raw_jobs(spark, sf_dir):
    k = "c_custkey"
    xpath_struct = (
        "named_struct('xpath', CASE i WHEN 1 THEN '//h2' WHEN 2 THEN '' WHEN 3 THEN '//a' ELSE '//p' END, "
        "'name', CASE i WHEN 1 THEN CAST(NULL AS string) WHEN 3 THEN ' ' ELSE concat('f', i) END, "
        "'type', CASE i WHEN 4 THEN 'colour' WHEN 5 THEN 'attribute' ELSE '' END, "
        "'attribute', '', 'multiple', CAST(NULL AS boolean), 'fallback', CAST(NULL AS string))"
    )
    tag_struct = "named_struct('name', CAST(NULL AS string), 'tag', 'a', 'selector', CAST(NULL AS string), 'attribute', 'href')"

    def repeated(n, item):
        return f"CASE WHEN {n} > 0 THEN transform(sequence(1, int({n})), i -> {item}) END"

    none = "CAST(NULL AS string)"
    return table(spark, sf_dir, "customer").selectExpr(
        f"{k} AS job_id",
        f"CASE {k} % 6 WHEN 0 THEN 'https://shop.example.com/list' WHEN 1 THEN 'https://ledger.example.com/' "
        f"WHEN 2 THEN 'https://shop.example.com/list?sort=1' WHEN 3 THEN 'not a url' WHEN 4 THEN '' ELSE 'https://none.example.com/x' END AS url",
        f"CASE WHEN {k} % 4 = 0 THEN '' ELSE '.item' END AS item_selector",
        f"CASE {k} % 6 WHEN 0 THEN 'query' WHEN 1 THEN 'path' WHEN 2 THEN 'query' WHEN 3 THEN 'button' WHEN 4 THEN 'sideways' END AS pagination_type",
        f"named_struct('query_param', CASE WHEN {k} % 6 = 2 THEN 'p' END, 'path_prefix', {none}, 'next_page_selector', '.next', "
        f"'load_more_selector', {none}, 'next_button_selector', {none}, 'next_page_xpath', {none}) AS pagination",
        "CASE c_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 4 THEN 2000 END AS max_pages",
        "CASE c_nationkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 2500 END AS delay",
        f"CASE {k} % 7 WHEN 0 THEN 'cheerio' WHEN 1 THEN 'xpath' WHEN 2 THEN 'smart-puppeteer' WHEN 3 THEN 'magic' WHEN 4 THEN '' END AS strategy",
        f"{k} % 5 = 0 AS spa", f"{k} % 11 = 0 AS infinite_scrolling",
        f"CASE WHEN {k} % 3 = 0 THEN false WHEN {k} % 3 = 2 THEN true END AS enable_smart_analysis",
        f"{k} % 2 = 0 AS use_puppeteer",
        f"{repeated(f'{k} % 8', xpath_struct)} AS xpath_selectors",
        f"{repeated(f'{k} % 60', tag_struct)} AS tag_selectors",
        f"CASE WHEN {k} % 9 = 0 THEN 'doc' WHEN {k} % 9 = 1 THEN 'csv' END AS file_extension",
        f"CASE WHEN {k} % 13 = 0 THEN 'never' END AS wait_strategy",
    )


def ready_jobs(spark, sf_dir):
    return jobs.with_defaults(raw_jobs(spark, sf_dir))


@query(
    "job_defaults",
    f"""SELECT job_id, item_selector, pagination_type, max_pages, delay, strategy, enable_smart_analysis, file_extension, wait_strategy,
        CAST(n_xpath AS BIGINT) AS xpaths, CAST(n_tags AS BIGINT) AS tags FROM ({JOBS_SQL})""",
)
def job_defaults(spark, sf_dir):
    return ready_jobs(spark, sf_dir).select(
        "job_id", "item_selector", "pagination_type", "max_pages", "delay", "strategy", "enable_smart_analysis",
        "file_extension", "wait_strategy", F.size("xpath_selectors").cast("long").alias("xpaths"),
        F.size("tag_selectors").cast("long").alias("tags"),
    )


@query(
    "job_checks",
    f"""
    SELECT job_id, array_to_string(list_filter([
      CASE WHEN url = '' THEN 'url_required' END, CASE WHEN url = 'not a url' THEN 'url_invalid' END,
      CASE WHEN n_tags > 50 THEN 'too_many_selectors' END,
      CASE WHEN n_xpath >= 2 THEN 'xpath_missing:2' END, CASE WHEN n_xpath >= 3 THEN 'xpath_name_missing:3' END,
      CASE WHEN n_xpath >= 4 THEN 'xpath_type:colour' END,
      CASE WHEN max_pages > 1000 THEN 'too_many_pages' END, CASE WHEN file_extension = 'doc' THEN 'file_format' END,
      CASE WHEN pagination_type = 'sideways' THEN 'pagination_type' END, CASE WHEN wait_strategy = 'never' THEN 'wait_strategy' END,
      CASE WHEN strategy = 'magic' THEN 'strategy' END,
      CASE WHEN spa AND NOT use_puppeteer AND coalesce(strategy, '') <> 'smart-puppeteer' THEN 'spa_needs_browser' END,
      CASE WHEN infinite_scrolling AND NOT use_puppeteer AND coalesce(strategy, '') <> 'smart-puppeteer' THEN 'scrolling_needs_browser' END,
      CASE WHEN n_xpath > 0 AND strategy NOT IN ('xpath', 'smart-puppeteer') THEN 'xpath_needs_xpath_strategy' END
    ], lambda x: x IS NOT NULL), ',') AS errors
    FROM ({JOBS_SQL})
    """,
)
def job_checks(spark, sf_dir):
    return ready_jobs(spark, sf_dir).select("job_id", F.array_join(jobs.job_errors(), ",").alias("errors"))


@query(
    "job_warnings",
    f"""
    SELECT job_id, array_to_string(list_filter([
      CASE WHEN enable_smart_analysis AND strategy = 'cheerio' THEN 'analysis_prefers_browser' END,
      CASE WHEN spa AND delay < 2000 THEN 'spa_needs_longer_delay' END,
      CASE WHEN max_pages > 10 AND strategy = 'smart-puppeteer' THEN 'smart_is_slow_on_many_pages' END,
      CASE WHEN infinite_scrolling AND pagination_type <> 'infinite' THEN 'scrolling_prefers_infinite_paging' END
    ], lambda x: x IS NOT NULL), ',') AS warnings
    FROM ({JOBS_SQL})
    """,
)
def job_warnings(spark, sf_dir):
    return ready_jobs(spark, sf_dir).select("job_id", F.array_join(jobs.job_warnings(), ",").alias("warnings"))


CHOICE_SQL = """
  CASE WHEN strategy IN ('cheerio', 'puppeteer', 'xpath', 'smart-puppeteer') THEN strategy
    WHEN use_puppeteer AND (spa OR infinite_scrolling OR enable_smart_analysis) THEN 'smart-puppeteer'
    WHEN use_puppeteer THEN 'puppeteer' WHEN n_xpath > 0 THEN 'xpath'
    WHEN spa OR infinite_scrolling OR enable_smart_analysis THEN 'smart-puppeteer' ELSE 'cheerio' END
"""
SUGGESTION_SQL = """
  CASE WHEN strategy IS NOT NULL THEN strategy WHEN spa OR infinite_scrolling OR enable_smart_analysis THEN 'smart-puppeteer'
    WHEN n_xpath > 0 THEN 'xpath' WHEN use_puppeteer THEN 'puppeteer' ELSE 'cheerio' END
"""


@query("strategy_choice", f"SELECT job_id, {CHOICE_SQL} AS chosen, {SUGGESTION_SQL} AS suggested FROM ({JOBS_SQL})")
def strategy_choice(spark, sf_dir):
    return ready_jobs(spark, sf_dir).select(
        "job_id", jobs.chosen_strategy().alias("chosen"), jobs.suggested_strategy().alias("suggested")
    )


@query(
    "strategy_disagreement",
    f"""WITH c AS (SELECT {CHOICE_SQL} AS chosen, {SUGGESTION_SQL} AS suggested FROM ({JOBS_SQL}))
    SELECT chosen, suggested, count(*) AS jobs FROM c WHERE chosen <> suggested GROUP BY 1, 2""",
)
def strategy_disagreement(spark, sf_dir):
    both = strategy_choice(spark, sf_dir).where(F.col("chosen") != F.col("suggested"))
    return both.groupBy("chosen", "suggested").agg(F.count(F.lit(1)).alias("jobs"))


_ESTIMATE = f"""
  SELECT job_id, chosen, CASE chosen WHEN 'smart-puppeteer' THEN 8000 WHEN 'puppeteer' THEN 5000 WHEN 'xpath' THEN 3000 ELSE 2000 END
    * CAST(max_pages AS BIGINT) + CAST(delay AS BIGINT) * (max_pages - 1) AS ms
  FROM (SELECT *, {CHOICE_SQL} AS chosen FROM ({JOBS_SQL}))
"""


@query(
    "time_estimate",
    f"""
    WITH e AS ({_ESTIMATE}), u AS (SELECT *, ms // 1000 AS s FROM e)
    SELECT job_id, chosen AS strategy, CAST(ms AS BIGINT) AS estimated_ms,
      CASE WHEN s >= 3600 THEN (s // 3600) || 'ч ' || (s // 60 % 60) || 'м ' || (s % 60) || 'с'
           WHEN s >= 60 THEN (s // 60) || 'м ' || (s % 60) || 'с' ELSE s || 'с' END AS shown
    FROM u
    """,
)
def time_estimate(spark, sf_dir):
    chosen = ready_jobs(spark, sf_dir).withColumn("chosen", jobs.chosen_strategy())
    ms = chosen.select("job_id", F.col("chosen").alias("strategy"), jobs.time_estimate(F.col("chosen")).alias("estimated_ms"))
    return ms.withColumn("shown", jobs.format_duration(F.col("estimated_ms")))


@query(
    "strategy_catalogue",
    f"""
    WITH e AS ({_ESTIMATE}), s AS (
      SELECT * FROM (VALUES ('cheerio', 'Cheerio (Быстрый)', 3), ('puppeteer', 'Puppeteer (JavaScript поддержка)', 3),
        ('xpath', 'XPath (Продвинутые селекторы)', 3), ('smart-puppeteer', 'Smart Puppeteer (ИИ + SPA поддержка)', 4)) AS t(strategy, display_name, features))
    SELECT strategy, display_name, CAST(features AS BIGINT) AS features, count(job_id) AS jobs, CAST(coalesce(sum(ms), 0) AS BIGINT) AS estimated_ms
    FROM s LEFT JOIN e ON chosen = strategy GROUP BY 1, 2, 3
    """,
)
def strategy_catalogue(spark, sf_dir):
    totals = time_estimate(spark, sf_dir).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("estimated_ms").alias("estimated_ms")
    )
    joined = jobs.strategy_catalogue(spark).join(totals, "strategy", "left").fillna(0, ["jobs", "estimated_ms"])
    return joined.withColumn("features", F.size("features").cast("long"))


@query(
    "normalized_selectors",
    f"""
    SELECT job_id, CAST(i AS BIGINT) AS i, CASE i WHEN 1 THEN '//h2' WHEN 2 THEN '' WHEN 3 THEN '//a' ELSE '//p' END AS xpath,
      CASE i WHEN 1 THEN 'xpath_field_1' WHEN 3 THEN ' ' ELSE 'f' || i END AS name,
      CASE i WHEN 4 THEN 'colour' WHEN 5 THEN 'attribute' ELSE 'text' END AS type, false AS multiple
    FROM (SELECT job_id, unnest(range(1, n_xpath + 1)) AS i FROM ({JOBS_SQL}))
    """,
)
def normalized_selectors(spark, sf_dir):
    rows = ready_jobs(spark, sf_dir).select("job_id", F.posexplode(sel.normalize_selectors(F.col("xpath_selectors"))).alias("n", "s"))
    return rows.select("job_id", (F.col("n") + 1).cast("long").alias("i"), "s.xpath", "s.name", "s.type", "s.multiple")


@query(
    "job_round_trip",
    f"SELECT job_id, url, strategy, max_pages, spa, CAST(n_tags AS BIGINT) AS tags FROM ({RAW_JOBS_SQL})",
)
def job_round_trip(spark, sf_dir):
    """Jobs written as JSON and read back with the declared schema."""
    path = work_dir(spark, "jobs")
    job_files.write_jobs(raw_jobs(spark, sf_dir), path)
    return job_files.read_jobs(spark, path).select(
        "job_id", "url", "strategy", "max_pages", "spa", F.coalesce(F.size("tag_selectors"), F.lit(0)).cast("long").alias("tags")
    )


@query(
    "exported_configs",
    """
    SELECT CAST(n_nationkey AS BIGINT) AS job_id, 'https://x.org/' || n_name AS url, CAST(n_nationkey + 1 AS INT) AS max_pages, n_nationkey % 2 = 0 AS spa,
      'p' || n_nationkey AS query_param, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '//li[@class="next"]' END AS next_page_xpath,
      CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '//h1 as xpath_field_1 text' WHEN 2 THEN '//h1 as xpath_field_1 text;//a as link attribute'
        ELSE '//a as link attribute;//p "q" as xpath_field_2 text' END AS fields, CAST(n_nationkey % 4 > 1 AS BIGINT) AS tags
    FROM nation
    """,
)
def exported_configs(spark, sf_dir):
    """Configuration files with camel-case names and selectors that are strings or objects, read, written and read again."""
    key = F.col("n_nationkey")
    link = '{"xpath": "//a", "name": "link", "type": "attribute", "attribute": "href"}'
    listed = F.when(key % 4 == 0, "[]").when(key % 4 == 1, '["//h1"]').when(key % 4 == 2, f'["//h1", {link}]').otherwise(
        f'[{link[:-1]}, "multiple": true' + r'}, "//p \"q\""]')
    next_page = F.when(key % 3 != 0, r', "nextPageXPath": "//li[@class=\"next\"]"').otherwise("")
    made = table(spark, sf_dir, "nation").select(F.concat(
        F.format_string('{\n "jobId": %d, "url": "https://x.org/%s", "maxPages": "%d pages", ', key, "n_name", key + 1),
        F.lit('"spa": '), (key % 2 == 0).cast("string"), F.format_string(', "paginationConfig": {"queryParam": "p%d"', key), next_page,
        F.lit('}, "xpathSelectors": '), listed, F.when(key % 4 > 1, ', "tagSelectors": ["h2"]').otherwise(""), F.lit("}")).alias("value"))
    path = work_dir(spark, "configs")
    read = job_files.jobs_from_json(made)
    read.select(job_files.exported_json(read.drop("corrupt")).alias("value")).repartition(25).write.text(path)
    again = job_files.read_exported_jobs(spark, f"{path}/part-*").where("corrupt IS NULL")
    one_line = F.transform(sel.normalize_selectors(F.col("xpath_selectors")), lambda s: F.concat(s["xpath"], F.lit(" as "), s["name"], F.lit(" "), s["type"]))
    return again.select(
        "job_id", "url", "max_pages", "spa", "pagination.query_param", "pagination.next_page_xpath", F.array_join(one_line, ";").alias("fields"),
        F.coalesce(F.size(F.filter("tag_selectors", lambda t: t["tag"] == "h2")), F.lit(0)).cast("long").alias("tags"))


@query(
    "schema_files",
    """
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
    SELECT c_nationkey AS job_id, unnest(['item_id', 'name', 'balance', 'contact', 'note']) AS field, unnest(['number', 'text', 'number',
      CASE c_custkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'email' ELSE 'text' END, CASE WHEN c_custkey % 2 = 0 THEN 'html' ELSE 'text' END]) AS type
    FROM f WHERE rn = 1
    """,
)
def schema_files(spark, sf_dir):
    """A schema file for each job from its first item, read back from the folders."""
    items = table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS job_id", "c_custkey AS item_id", "c_name AS name", "c_acctbal AS balance",
        "CASE c_custkey % 3 WHEN 0 THEN concat('https://x.org/', c_custkey) WHEN 1 THEN concat('c', c_custkey, '@x.org') END AS contact",
        "if(c_custkey % 2 = 0, '<b>x</b>', 'x') AS note")
    path = work_dir(spark, "schemas")
    writers.write_rules(preview.exported_schema(items, "job_id", ("item_id",)), path, by_job="job_id")
    return spark.read.schema("field string, type string, required boolean, job_id int").json(path).select("job_id", "field", "type")


# ---- paging ------------------------------------------------------------------------


@query(
    "frontier_urls",
    f"""
    WITH j AS (SELECT *, CASE WHEN pagination_type IN ('query', 'path') THEN max_pages ELSE 1 END AS last FROM ({JOBS_SQL}) WHERE max_pages <= 1000),
      p AS (SELECT *, unnest(range(1, last + 1)) AS page_no FROM j)
    SELECT job_id, CAST(page_no AS BIGINT) AS page_no, CASE pagination_type
      WHEN 'query' THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || coalesce(query_param, 'page') || '=' || page_no
      WHEN 'path' THEN regexp_replace(url, '/$', '') || '/page/' || page_no ELSE url END AS url
    FROM p
    """,
)
def frontier_urls(spark, sf_dir):
    allowed = ready_jobs(spark, sf_dir).where(F.col("max_pages") <= R.MAX_PAGES)
    return paging.frontier(allowed).withColumn("page_no", F.col("page_no").cast("long"))


_FRONTIER = f"""
  SELECT job_id, page_no, CASE WHEN pagination_type = 'query' AND url = 'https://shop.example.com/list' THEN page_no - 1 END AS shop_page
  FROM (SELECT *, unnest(range(1, CASE WHEN pagination_type IN ('query', 'path') THEN max_pages ELSE 1 END + 1)) AS page_no
        FROM ({JOBS_SQL}) WHERE max_pages <= 1000)
"""


@query(
    "visited_pages",
    f"""
    WITH f AS ({_FRONTIER}), p AS (SELECT DISTINCT p_partkey // 20 AS page_id FROM part)
    SELECT job_id, CAST(page_no AS BIGINT) AS page_no, page_id FROM f LEFT JOIN p ON shop_page = page_id
    """,
)
def visited_pages(spark, sf_dir):
    allowed = ready_jobs(spark, sf_dir).where(F.col("max_pages") <= R.MAX_PAGES)
    found = paging.visit(paging.frontier(allowed), rendered.catalog(spark, sf_dir).select("url", "page_id"))
    return found.select("job_id", F.col("page_no").cast("long").alias("page_no"), "page_id")


@query(
    "paging_takewhile",
    f"""
    WITH f AS ({_FRONTIER}), p AS (SELECT DISTINCT p_partkey // 20 AS page_id FROM part),
      v AS (SELECT job_id, page_no, page_id, page_id IS NOT NULL AND page_id % 7 <> 6 AS has_next FROM f LEFT JOIN p ON shop_page = page_id),
      s AS (SELECT job_id, min(page_no) FILTER (WHERE NOT has_next) AS stop FROM v GROUP BY 1)
    SELECT job_id, CAST(page_no AS BIGINT) AS page_no FROM v JOIN s USING (job_id) WHERE stop IS NULL OR page_no <= stop
    """,
)
def paging_takewhile(spark, sf_dir):
    shop = rendered.catalog(spark, sf_dir)
    allowed = ready_jobs(spark, sf_dir).where(F.col("max_pages") <= R.MAX_PAGES)
    visited = paging.visit(paging.frontier(allowed), shop.select("url", "page_id"))
    markers = paging.has_next_page(parsed(shop), "button", css(".next"))
    taken = paging.take_while_next(visited.join(markers, "page_id", "left"))
    return taken.select("job_id", F.col("page_no").cast("long").alias("page_no"))


@query(
    "next_markers",
    """
    -- every seventh page has a disabled link, every fourth a button for more, every fifth a usable link besides a hidden one
    WITH p AS (SELECT DISTINCT p_partkey // 20 AS page_id FROM part)
    SELECT page_id, true AS by_query, page_id % 7 <> 6 AS by_button, page_id % 7 <> 6 OR page_id % 5 = 0 AS by_element, true AS by_xpath,
      page_id % 4 = 0 AS by_infinite, page_id % 5 = 0 AS by_other_button, false AS unset, false AS by_none FROM p
    """,
)
def next_markers(spark, sf_dir):
    """All kinds of markers in one pass over the pages."""
    key = F.col("page_id")
    extra = F.concat(
        F.when(key % 4 == 0, '<button class="load-more">more</button>').otherwise(""),
        F.when(key % 5 == 0, '<a class="other" style="color: red; display: none">x</a><a class="other">y</a>')
        .otherwise('<a class="other" disabled>x</a><a class="other" style="display:none">y</a>'))
    dom = parsed(rendered.catalog(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</main>"), F.concat(extra, F.lit("</main>")))))
    link, other = css("a.next"), css("a.other")
    markers = {
        "by_query": paging.next_marker("query", link), "by_button": paging.next_marker("button", link),
        "by_element": paging.next_marker("button", css("a.next, a.other"), per_element=True),
        "by_xpath": paging.next_marker("path", xpath("//main/a[contains(@class,'next')]")),
        "by_infinite": paging.next_marker("infinite", link, load_more=css(".load-more")),
        "by_other_button": paging.next_marker("button", link, button=other, per_element=True),
        "unset": paging.next_marker("query", None), "by_none": paging.next_marker("none", link),
    }
    return dom.select("page_id", *[m.alias(n) for n, m in markers.items()])


@query(
    "url_validity",
    f"""
    SELECT job_id AS id, url LIKE 'https://%' AS valid FROM ({RAW_JOBS_SQL})
    UNION ALL SELECT -1 - page_id, true FROM pages
    """,
)
def url_validity(spark, sf_dir):
    made = raw_jobs(spark, sf_dir).select(F.col("job_id").alias("id"), "url")
    stored = read_pages(spark, f"{sf_dir}/pages.parquet").select((-1 - F.col("page_id")).alias("id"), "url")
    return made.unionByName(stored).select("id", is_valid_url(F.col("url")).alias("valid"))


@query(
    "reachability",
    """
    SELECT page_id AS id, true AS well_formed, true AS accessible, CAST(NULL AS VARCHAR) AS error FROM pages
    UNION ALL SELECT -1 - page_id, true, false, 'no_snapshot' FROM pages
    UNION ALL SELECT 1000000000 + page_id, false, false, 'invalid_url' FROM pages
    """,
)
def reachability(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url")
    urls = pages.select(F.col("page_id").alias("id"), "url")
    urls = urls.unionByName(pages.select((-1 - F.col("page_id")).alias("id"), F.concat("url", F.lit("/gone")).alias("url")))
    urls = urls.unionByName(
        pages.select((1000000000 + F.col("page_id")).alias("id"), F.concat(F.lit("no url "), F.col("page_id").cast("string")).alias("url"))
    )
    return paging.reachability(urls, pages).select("id", "well_formed", "accessible", "error")


# ---- crawl log derived from events ---------------------------------------------------

LOG_SQL = """
  SELECT event_id, user_id AS job_id, 'u' || (event_id % 500) AS url, 1 + CAST(props->>'k' AS INTEGER) % 5 AS attempt,
    CASE WHEN event_type = 'error' THEN [404, 408, 429, 500, 503, 403, 200][1 + CAST(props->>'k' AS INTEGER) % 7] ELSE 200 END AS status,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN ['ECONNRESET', 'ENOTFOUND', 'EPIPE'][1 + CAST(props->>'k' AS INTEGER) % 3] END AS error_code,
    CASE WHEN event_type <> 'error' THEN '' ELSE ['timeout of 30000ms', 'network down', 'page not found', 'bad URL', 'broken'][1 + event_id % 5] END AS message,
    length(props) AS bytes, ts
  FROM events
"""


def crawl_rows(events):
    k = "int(get_json_object(props, '$.k'))"
    return events.selectExpr(
        "event_id", "user_id AS job_id", "concat('u', event_id % 500) AS url", f"1 + {k} % 5 AS attempt",
        f"CASE WHEN event_type = 'error' THEN get(array(404, 408, 429, 500, 503, 403, 200), {k} % 7) ELSE 200 END AS status",
        f"CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN get(array('ECONNRESET', 'ENOTFOUND', 'EPIPE'), {k} % 3) END AS error_code",
        "CASE WHEN event_type <> 'error' THEN '' ELSE get(array('timeout of 30000ms', 'network down', 'page not found', 'bad URL', 'broken'), int(event_id % 5)) END AS message",
        "length(props) AS bytes", "ts",
    )


def log(spark, sf_dir):
    return crawl_rows(table(spark, sf_dir, "events"))


@query(
    "retry_classes",
    f"""
    SELECT event_id, coalesce(error_code IN ('ECONNRESET', 'ETIMEDOUT', 'ENOTFOUND', 'EAI_AGAIN', 'ECONNREFUSED'), false)
      OR status IN (408, 429, 500, 502, 503, 504) OR contains(message, 'timeout') OR contains(message, 'network') AS retryable
    FROM ({LOG_SQL})
    """,
)
def retry_classes(spark, sf_dir):
    flag = crawl_log.is_retryable(F.col("error_code"), F.col("status"), F.col("message"))
    return log(spark, sf_dir).select("event_id", flag.alias("retryable"))


@query(
    "backoff",
    f"""
    SELECT event_id, CAST(least(1000 * pow(2, attempt - 1), 10000) AS BIGINT) AS delay_ms,
      CAST([0, 1000, 3000, 7000, 15000][attempt] AS BIGINT) AS total_wait_ms FROM ({LOG_SQL})
    """,
)
def backoff(spark, sf_dir):
    return log(spark, sf_dir).select(
        "event_id", crawl_log.retry_delay(F.col("attempt")).alias("delay_ms"),
        crawl_log.total_wait(F.col("attempt")).alias("total_wait_ms"),
    )


_FAILED = "(error_code IS NOT NULL OR status >= 400)"


@query(
    "request_counters",
    f"""
    SELECT job_id, count(*) AS attempts, count(*) FILTER (WHERE NOT {_FAILED}) AS successful_requests,
      count(*) FILTER (WHERE {_FAILED}) AS failed_requests, count(*) - count(DISTINCT url) AS retry_attempts,
      CAST(sum(bytes) AS BIGINT) AS bytes_processed, round(count(*) FILTER (WHERE NOT {_FAILED}) / count(*) * 100, 6) AS success_rate,
      epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms
    FROM ({LOG_SQL}) GROUP BY 1
    """,
)
def request_counters(spark, sf_dir):
    counters = crawl_log.request_counters(log(spark, sf_dir))
    return counters.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "error_categories",
    f"""
    SELECT CASE WHEN event_id % 100 = 4 THEN 400 WHEN contains(message, 'URL') THEN 400 WHEN contains(message, 'timeout') THEN 408
      WHEN contains(message, 'not found') OR coalesce(error_code = 'ENOTFOUND', false) THEN 404 ELSE 500 END AS category, count(*) AS errors
    FROM ({LOG_SQL}) WHERE {_FAILED} GROUP BY 1
    """,
)
def error_categories(spark, sf_dir):
    failed = log(spark, sf_dir).where(_FAILED)
    name = F.when(F.col("event_id") % 100 == 4, "ValidationError").otherwise("Error")
    category = crawl_log.error_status(name, F.col("error_code"), F.col("message"))
    return failed.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("errors"))


@query(
    "request_summary",
    f"""
    SELECT CASE WHEN job_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, status, count(*) AS requests,
      round(avg(bytes * attempt), 6) AS mean_ms, max(bytes * attempt) AS max_ms,
      list_sort(list(bytes * attempt))[CAST(ceil(count(*) / 2) AS BIGINT)] AS median_ms
    FROM ({LOG_SQL}) GROUP BY 1, 2
    """,
)
def request_summary(spark, sf_dir):
    access = log(spark, sf_dir).selectExpr(
        "CASE WHEN job_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method", "status", "bytes * attempt AS duration_ms"
    )
    return crawl_log.request_summary(access).withColumn("mean_ms", F.round("mean_ms", 6))


_QUALITY = """
  round(greatest(0, least(1, CASE WHEN items > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN items > 10 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN items > 50 THEN 0.1::DOUBLE ELSE 0 END + rate {scale} * 0.3::DOUBLE - least(errors * 0.1::DOUBLE, 0.3::DOUBLE))), 6)
"""
_RUNS_SQL = f"""
  SELECT job_id, count(*) FILTER (WHERE event_id % 4 = 0) AS items, count(*) FILTER (WHERE {_FAILED}) // 4 AS errors,
    count(*) FILTER (WHERE NOT {_FAILED}) / count(*) * 100 AS rate FROM ({LOG_SQL}) GROUP BY 1
"""


def runs(spark, sf_dir):
    return log(spark, sf_dir).groupBy("job_id").agg(
        F.count_if(F.col("event_id") % 4 == 0).alias("items"),
        F.expr(f"count_if({_FAILED}) div 4").alias("errors"),
        F.expr(f"count_if(NOT {_FAILED}) / count(*) * 100").alias("rate"),
    )


@query(
    "quality_score",
    f"""SELECT job_id, {_QUALITY.format(scale='')} AS quality, {_QUALITY.format(scale='/ 100')} AS normalized FROM ({_RUNS_SQL})""",
)
def quality_score(spark, sf_dir):
    args = (F.col("items"), F.col("rate"), F.col("errors"))
    return runs(spark, sf_dir).select(
        "job_id", F.round(jobs.quality_score(*args), 6).alias("quality"),
        F.round(jobs.quality_score(*args, normalized=True), 6).alias("normalized"),
    )


_OUTCOMES_SQL = """
  SELECT c_custkey AS job_id, e AS extractor, e = p AS is_primary, (c_custkey * n + c_nationkey) % 20 AS items,
    CASE WHEN c_custkey % 3 = 0 THEN 0.1 ELSE 0.9 END::DOUBLE AS quality, c_custkey % 10 = 1 AS failed, p
  FROM (SELECT *, ['cheerio', 'puppeteer', 'xpath', 'smart-puppeteer'][1 + c_custkey % 4] AS p FROM customer),
    (VALUES ('cheerio', 1), ('puppeteer', 2), ('xpath', 3), ('smart-puppeteer', 4)) AS t(e, n)
"""


def outcomes(spark, sf_dir):
    rows = (
        "inline(array(named_struct('e', 'cheerio', 'n', 1), named_struct('e', 'puppeteer', 'n', 2), "
        "named_struct('e', 'xpath', 'n', 3), named_struct('e', 'smart-puppeteer', 'n', 4)))"
    )
    wide = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", rows)
    return wide.selectExpr(
        "c_custkey AS job_id", "e AS extractor",
        "e = get(array('cheerio', 'puppeteer', 'xpath', 'smart-puppeteer'), int(c_custkey % 4)) AS is_primary",
        "(c_custkey * n + c_nationkey) % 20 AS items", "CASE WHEN c_custkey % 3 = 0 THEN 0.1D ELSE 0.9D END AS quality",
        "c_custkey % 10 = 1 AS failed",
    )


@query(
    "fallback_pick",
    f"""
    WITH o AS ({_OUTCOMES_SQL}), c AS (SELECT * FROM (VALUES ('cheerio', 1, 'xpath'), ('puppeteer', 1, 'cheerio'), ('puppeteer', 2, 'xpath'),
        ('xpath', 1, 'cheerio'), ('smart-puppeteer', 1, 'puppeteer'), ('smart-puppeteer', 2, 'cheerio')) AS t(p, i, f)),
      m AS (SELECT * FROM o WHERE is_primary),
      w AS (SELECT m.job_id, arg_min(c.f, c.i) AS fallback FROM m JOIN c ON m.p = c.p JOIN o ON o.job_id = m.job_id AND o.extractor = c.f
            WHERE o.items > m.items AND (m.failed OR m.quality < 0.3) GROUP BY 1)
    SELECT m.job_id, m.extractor AS primary, CAST(m.items AS BIGINT) AS primary_items, w.fallback FROM m LEFT JOIN w ON m.job_id = w.job_id
    """,
)
def fallback_pick(spark, sf_dir):
    return jobs.fallback_choice(outcomes(spark, sf_dir))


@query(
    "extractor_fallback",
    """
    -- the first extractor finds table rows only on ledger pages with totals; the second finds list entries
    WITH o AS (SELECT o_orderkey // 25 AS page_id, count(*) AS n FROM orders GROUP BY 1),
      j AS (SELECT page_id % 50 AS job_id, sum(CASE WHEN page_id % 6 = 5 THEN 1 ELSE 0 END) AS a, sum(page_id % 6) AS b FROM o GROUP BY 1)
    SELECT job_id, 'cheerio' AS extractor, CAST(a AS BIGINT) AS items FROM j WHERE a > 0
    UNION ALL SELECT job_id, 'xpath', CAST(b AS BIGINT) FROM j WHERE b > a AND job_id % 2 = 0
    """,
)
def extractor_fallback(spark, sf_dir):
    pages = rendered.ledger(spark, sf_dir).withColumn("job_id", F.col("page_id") % 50)
    keys = ("job_id", "page_id")
    known = jobs.Extractors()
    known.register("cheerio", lambda d: extract_items(d, "ul > li:nth-of-type(5)", keys=keys, parts=("text",)))
    known.register("xpath", lambda d: extract_items(d, xpath("//ul//li"), keys=keys, parts=("text",)))
    summary = pages.select("job_id").distinct().select(
        "job_id", F.lit(0.0).alias("success_rate"), F.lit(5).alias("errors"), (F.col("job_id") % 2 == 0).alias("failed")
    ).withColumn("success_rate", F.when(F.col("failed"), 0.0).otherwise(100.0))
    found = known.run_with_fallback("cheerio", spread(pages.select(*keys, "html")), summary)
    return found.groupBy("job_id", "extractor").agg(F.count(F.lit(1)).alias("items"))


@query(
    "run_summary",
    f"""
    WITH c AS (SELECT job_id, count(*) FILTER (WHERE NOT {_FAILED}) AS successful_requests, count(*) AS attempts, count(*) FILTER (WHERE {_FAILED}) AS errors,
        count(*) FILTER (WHERE NOT {_FAILED}) / count(*) * 100 AS rate, count(*) FILTER (WHERE event_id % 4 = 0) AS items FROM ({LOG_SQL}) GROUP BY 1)
    SELECT job_id, attempts, successful_requests, items AS total_items, errors, {_QUALITY.format(scale='')} AS quality FROM c
    """,
)
def run_summary(spark, sf_dir):
    rows = log(spark, sf_dir)
    items = rows.where("event_id % 4 = 0").select("job_id")
    summary = jobs.run_summary(items, crawl_log.request_counters(rows), rows.where(_FAILED).select("job_id"))
    return summary.select(
        "job_id", "attempts", "successful_requests", "total_items", "errors", F.round("quality", 6).alias("quality")
    )


# ---- previews ------------------------------------------------------------------------


def shop_items(spark, sf_dir):
    return extract_items(
        parsed(rendered.catalog(spark, sf_dir)), ".product", parts=("text", "attributes", "links", "images")
    )


@query(
    "preview_rows",
    """
    WITH r AS (SELECT p_partkey // 20 AS page_id, p_name || '$' || printf('%.2f', p_retailprice) || p_brand AS text,
      row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS rank, count(*) OVER (PARTITION BY p_partkey // 20) AS total_found FROM part)
    SELECT page_id, text, rank, total_found FROM r WHERE rank <= 5
    """,
)
def preview_rows(spark, sf_dir):
    items = shop_items(spark, sf_dir)
    first = preview.preview_items(items, "page_id", ("item_id",))
    return first.join(preview.total_found(items, "page_id"), "page_id").select(
        "page_id", "text", F.col("rank").cast("long").alias("rank"), "total_found"
    )


@query(
    "preview_format",
    """
    SELECT p_partkey // 20 AS page_id, p_brand || ' → /p/' || p_partkey AS links, p_type || ' → /i/' || p_partkey || '.png' AS images,
      '{"class":"product card","id":"p-' || p_partkey || '","data-id":"' || p_partkey || '","data-size":"' || p_size || '"}' AS attributes
    FROM part
    """,
)
def preview_format(spark, sf_dir):
    shown = preview.format_items(shop_items(spark, sf_dir))
    return shown.select("page_id", "links", "images", "attributes")


@query(
    "preview_placeholders",
    """
    SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Нет ссылок' END AS links,
      'Изображение → /s/' || s_suppkey AS images FROM supplier
    """,
)
def preview_placeholders(spark, sf_dir):
    made = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS page_id",
        "CASE WHEN s_suppkey % 2 = 0 THEN cast(array() AS array<struct<href:string,text:string>>) END AS links",
        "array(named_struct('src', concat('/s/', s_suppkey), 'alt', '')) AS images",
    )
    return preview.format_items(made, ("page_id",))


@query(
    "field_profile",
    """
    WITH v AS (
      SELECT conv_id, turn, 'role' AS field, role AS value FROM conversations UNION ALL SELECT conv_id, turn, 'body', text FROM conversations
      UNION ALL SELECT conv_id, turn, 'link', 'https://x.org/' || conv_id FROM conversations UNION ALL SELECT conv_id, turn, 'number', CAST(turn AS VARCHAR) FROM conversations
      UNION ALL SELECT conv_id, turn, 'mixed', CASE turn % 4 WHEN 0 THEN '<b>' WHEN 1 THEN 'a@b.c' WHEN 2 THEN '12' END FROM conversations
    ), t AS (
      SELECT *, CASE WHEN contains(value, '<') AND contains(value, '>') THEN 'html' WHEN regexp_matches(value, '^[0-9]+$') THEN 'number'
        WHEN regexp_matches(value, '^https?://') THEN 'url' WHEN value = 'a@b.c' THEN 'email' ELSE 'text' END AS type,
        row_number() OVER (PARTITION BY field ORDER BY conv_id, turn) AS rn FROM v WHERE value IS NOT NULL
    )
    SELECT field, count(*) AS values, string_agg(DISTINCT type, ',' ORDER BY type) AS types,
      string_agg(value, '|' ORDER BY rn) FILTER (WHERE rn <= 3) AS samples FROM t GROUP BY 1
    """,
)
def field_profile(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "text AS body", "concat('https://x.org/', conv_id) AS link", "string(turn) AS number",
        "CASE turn % 4 WHEN 0 THEN '<b>' WHEN 1 THEN 'a@b.c' WHEN 2 THEN '12' END AS mixed",
    )
    found = preview.field_profile(made, ("conv_id", "turn"), ("conv_id", "turn"))
    return found.select("field", "values", F.array_join("types", ",").alias("types"), F.array_join("samples", "|").alias("samples"))


@query(
    "preview_advice",
    """
    WITH n AS (SELECT n_nationkey AS job_id, count(c_custkey) FILTER (WHERE c_custkey % 5 < n_nationkey % 5) * (n_nationkey % 3) AS n
               FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
    SELECT job_id, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'nothing_found' WHEN n < 5 THEN 'few_items' WHEN n > 100 THEN 'many_items' END AS advice FROM n
    """,
)
def preview_advice(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    chosen = customers.where(F.col("c_custkey") % 5 < F.col("n_nationkey") % 5).groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("c"))
    counted = table(spark, sf_dir, "nation").join(chosen, "n_nationkey", "left").select(
        F.col("n_nationkey").cast("int").alias("job_id"), (F.coalesce("c", F.lit(0)) * (F.col("n_nationkey") % 3)).alias("n")
    )
    return counted.withColumn("advice", preview.preview_advice(F.col("n")))


@query(
    "value_types",
    """
    WITH v AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN 'https://' || doc_id || '.org/<b>' WHEN 2 THEN CAST(doc_id AS VARCHAR)
      WHEN 3 THEN 'a' || doc_id || '@x.org' WHEN 4 THEN '<p>' || doc_id END AS value FROM documents)
    SELECT doc_id, CASE WHEN value IS NULL THEN 'null' WHEN contains(value, '<') AND contains(value, '>') THEN 'html' WHEN regexp_matches(value, '^[0-9]+$') THEN 'number'
        WHEN regexp_matches(value, '^https?://') THEN 'url' WHEN regexp_matches(value, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email' ELSE 'text' END AS preview,
      CASE WHEN regexp_matches(value, '^https?://') THEN 'url' WHEN regexp_matches(value, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email'
        WHEN contains(value, '<') AND contains(value, '>') THEN 'html' ELSE 'text' END AS display,
      CASE WHEN length(value) > 100 THEN substr(value, 1, 100) || '...' ELSE value END AS short
    FROM v
    """,
)
def value_types(spark, sf_dir):
    made = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN concat('https://', doc_id, '.org/<b>') WHEN 2 THEN string(doc_id) "
        "WHEN 3 THEN concat('a', doc_id, '@x.org') WHEN 4 THEN concat('<p>', doc_id) END AS value",
    )
    value = F.col("value")
    return made.select(
        "doc_id", text.preview_type(value).alias("preview"), text.display_type(value).alias("display"),
        text.shorten(value).alias("short"),
    )


# ---- selector strings ------------------------------------------------------------------

_SELECTORS = """
  SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN '#p-' || p_partkey WHEN 1 THEN '.s' || p_size || ' .x' WHEN 2 THEN 'div[data-id="' || p_partkey || '"]'
    WHEN 3 THEN '[data-id]' WHEN 4 THEN 'div.c' || p_size || '[a]' WHEN 5 THEN 'div > p  >a' WHEN 6 THEN 'div  p a' WHEN 7 THEN 'h' || p_size
    WHEN 8 THEN 'div.card' ELSE 'a[href=/p/' || p_partkey || ']' END AS css FROM part
"""


def selector_table(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 10 WHEN 0 THEN concat('#p-', p_partkey) WHEN 1 THEN concat('.s', p_size, ' .x') WHEN 2 THEN concat('div[data-id=\"', p_partkey, '\"]') "
        "WHEN 3 THEN '[data-id]' WHEN 4 THEN concat('div.c', p_size, '[a]') WHEN 5 THEN 'div > p  >a' WHEN 6 THEN 'div  p a' WHEN 7 THEN concat('h', p_size) "
        "WHEN 8 THEN 'div.card' ELSE concat('a[href=/p/', p_partkey, ']') END AS css",
    )


@query(
    "css_to_xpath",
    f"""
    SELECT id, css, CASE id % 10 WHEN 0 THEN '//*[@id=''' || css[2:] || ''']' WHEN 1 THEN '//*[contains(@class,''' || css[2:] || ''')]'
      WHEN 2 THEN '//div[@data-id=''' || id || ''']' WHEN 3 THEN '//*[@data-id]' WHEN 4 THEN '' WHEN 5 THEN '//div/p/a' WHEN 6 THEN '//div//p//a'
      WHEN 7 THEN '//' || css WHEN 8 THEN '//div.card' ELSE '//a[@href=''/p/' || id || ''']' END AS xpath,
      CASE WHEN id % 10 = 4 THEN 'not_a_string' END AS error
    FROM ({_SELECTORS})
    """,
)
def css_to_xpath(spark, sf_dir):
    converted = selector_table(spark, sf_dir).withColumn("xpath", sel.css_to_xpath(F.col("css")))
    return converted.withColumn("error", sel.xpath_error(F.col("xpath")))


_XPATHS = """
  SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN '////div[@class=''c' || p_size || ''']' WHEN 1 THEN '//a[position()=1]/b[' WHEN 2 THEN 'div' WHEN 3 THEN ''
    WHEN 4 THEN '//a[@x=''1]' WHEN 5 THEN '/html//p[position()=1][@class=''q''][position()=1]' WHEN 6 THEN '//a[@x="' || p_size || '"]' ELSE '//p["]' END AS xpath FROM part
"""


@query(
    "xpath_check",
    f"""
    SELECT id, CASE id % 8 WHEN 1 THEN 'unbalanced_brackets' WHEN 2 THEN 'no_leading_slash' WHEN 3 THEN 'not_a_string' WHEN 4 THEN 'unbalanced_quotes' WHEN 7 THEN 'unbalanced_quotes' END AS error,
      CASE id % 8 WHEN 0 THEN '//div[contains(@class,''' || regexp_extract(xpath, 'c[0-9]+') || ''')]' WHEN 5 THEN '/html//p[1][contains(@class,''q'')][1]' WHEN 6 THEN xpath END AS optimized
    FROM ({_XPATHS})
    """,
)
def xpath_check(spark, sf_dir):
    made = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 8 WHEN 0 THEN concat('////div[@class=\\'c', p_size, '\\']') WHEN 1 THEN '//a[position()=1]/b[' WHEN 2 THEN 'div' WHEN 3 THEN '' "
        "WHEN 4 THEN '//a[@x=\\'1]' WHEN 5 THEN '/html//p[position()=1][@class=\\'q\\'][position()=1]' WHEN 6 THEN concat('//a[@x=\"', p_size, '\"]') ELSE '//p[\"]' END AS xpath",
    )
    error = sel.xpath_error(F.col("xpath"))
    return made.select("id", error.alias("error"), F.when(error.isNull(), sel.rewrite_xpath(F.col("xpath"))).alias("optimized"))


# ---- exports ---------------------------------------------------------------------------


@query(
    "flatten_export",
    """
    SELECT p_partkey // 20 AS page_id, 'product card' AS "attributes.class", CAST(p_partkey AS VARCHAR) AS "attributes.data-id",
      CAST(p_size AS VARCHAR) AS "attributes.data-size", 'p-' || p_partkey AS "attributes.id",
      '{"href":"/p/' || p_partkey || '","text":"' || p_brand || '"}' AS links FROM part
    """,
)
def flatten_export(spark, sf_dir):
    items = shop_items(spark, sf_dir).select("page_id", "item_id", "attributes", "links")
    keys = writers.map_keys(items, "attributes", ("page_id", "item_id"))
    return writers.flatten(items, {"attributes": keys}).drop("item_id")


@query(
    "open_export",
    """
    -- a name for every order, five items; names in the order in which items bring them
    WITH o AS (
      SELECT o_orderpriority AS item, o_orderkey AS k, CASE o_orderkey % 50 WHEN 0 THEN '"a ""b"", c"' ELSE o_orderstatus || printf('%.2f', o_totalprice) END AS cell,
        'prices.' || o_orderkey AS name, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders
    ), i AS (SELECT DISTINCT item FROM o)
    SELECT i.item, string_agg(CASE WHEN o.item = i.item THEN o.cell ELSE '' END, ',' ORDER BY place) AS line FROM i, o GROUP BY i.item
    UNION ALL SELECT '(names)', string_agg(name, ',' ORDER BY place) FROM o
    """,
)
def open_export(spark, sf_dir):
    """Items whose maps have as many names as there are orders."""
    cell = F.when(F.col("o_orderkey") % 50 == 0, F.lit('a "b", c')).otherwise(F.concat("o_orderstatus", F.format_string("%.2f", "o_totalprice")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item"), F.struct(F.col("o_orderkey").alias("k"), cell.alias("v")).alias("e"))
    prices = F.map_from_entries(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["k"].cast("string").alias("k"), e["v"].alias("v"))))
    items = rows.groupBy("item").agg(prices.alias("prices"))
    path = work_dir(spark, "open-csv")
    writers.write_open_csv(items, path, ("prices",), ("item",))
    names = spark.read.schema("name string, place int").json(f"{path}/header")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda n: n["name"]), ",")
    return writers.open_lines(items, ("prices",), ("item",), names).union(names.agg(F.lit("(names)").alias("item"), listed.alias("line")))


@query(
    "nested_flatten",
    """
    SELECT c_custkey AS id, c_name AS "who.name", c_mktsegment AS "who.work.segment", c_nationkey || '; ' || (c_nationkey + 1) AS codes, c_acctbal AS balance FROM customer
    """,
)
def nested_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "named_struct('name', c_name, 'work', named_struct('segment', c_mktsegment)) AS who",
        "array(c_nationkey, c_nationkey + 1) AS codes", "c_acctbal AS balance",
    )
    return writers.flatten(nested)


_SCHEMA = "conv_id long, turn long, role string, text string"


def _export(format_):
    def build(spark, sf_dir):
        path = work_dir(spark, f"export-{format_}")
        # every fourth text begins and ends with blanks and line ends
        rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "if(conv_id % 4 = 0, concat(' \\n', text, '\\n  '), text) AS text")
        writers.write_items(rows, path, format_)
        return writers.read_items(spark, path, _SCHEMA, format_)

    return build


_SOURCE = "SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 0 THEN ' ' || chr(10) || text || chr(10) || '  ' ELSE text END AS text FROM conversations"
for _format in ("json", "csv", "xml"):
    query(f"export_{_format}", _SOURCE)(_export(_format))


@query(
    "export_by_strategy",
    f"""SELECT chosen AS strategy, count(*) AS jobs FROM (SELECT {CHOICE_SQL} AS chosen FROM ({JOBS_SQL})) GROUP BY 1""",
)
def export_by_strategy(spark, sf_dir):
    """Items with a run summary, in one folder per strategy, read back from the folders."""
    path = work_dir(spark, "export-strategy")
    rows = strategy_choice(spark, sf_dir).withColumnRenamed("chosen", "strategy")
    summary = rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("total_items"))
    writers.write_items(rows, path, "json", summary=summary, by_strategy="strategy")
    items = spark.read.schema("job_id long, suggested string, strategy string").json(f"{path}/items")
    totals = spark.read.schema("strategy string, total_items long").json(f"{path}/run_summary")
    counted = items.groupBy("strategy").agg(F.count("job_id").alias("jobs"))
    return counted.join(totals.where("total_items > 0").select("strategy"), "strategy")


@query(
    "observed_totals",
    f"""
    SELECT count(*) AS total_requests, count(*) FILTER (WHERE NOT {_FAILED}) AS successful_requests, count(*) FILTER (WHERE {_FAILED}) AS failed_requests,
      count(*) AS written FROM ({LOG_SQL})
    """,
)
def observed_totals(spark, sf_dir):
    """Totals of a log that come along with writing it, without a pass of their own."""
    log, totals = crawl_log.observed(crawl_rows(table(spark, sf_dir, "events")))
    stored = written(log, "log")
    found = totals.get
    return stored.agg(F.count(F.lit(1)).alias("written")).select(*[F.lit(v).cast("long").alias(k) for k, v in found.items()], "written")


# ---- whole runs --------------------------------------------------------------------------


def shop_jobs(spark, sf_dir):
    """One listing job per region, over the shop pages."""
    regions = table(spark, sf_dir, "region").selectExpr(
        "CAST(r_regionkey AS bigint) AS job_id", "'https://shop.example.com/list' AS url", "'query' AS pagination_type",
        "200 + int(r_regionkey) * 200 AS max_pages", "'cheerio' AS strategy", "false AS enable_smart_analysis",
        "named_struct('query_param', CAST(NULL AS string), 'path_prefix', CAST(NULL AS string)) AS pagination",
    )
    return regions.selectExpr(
        "*", "'' AS item_selector", "0 AS delay", "false AS spa", "false AS infinite_scrolling", "false AS use_puppeteer",
        "CAST(NULL AS array<struct<xpath:string,name:string,type:string>>) AS xpath_selectors",
        "CAST(NULL AS array<struct<tag:string>>) AS tag_selectors", "'' AS file_extension", "'' AS wait_strategy",
    )


_TAKEN = """
  j AS (SELECT CAST(r_regionkey AS BIGINT) AS job_id, 200 + r_regionkey * 200 AS max_pages FROM region),
  p AS (SELECT DISTINCT p_partkey // 20 AS page_id FROM part),
  t AS (SELECT job_id, page_id FROM j JOIN p ON page_id < max_pages AND page_id <= 6)
"""


@query(
    "job_run",
    f"""
    -- the next link of the seventh page is disabled, so every job stops there
    WITH {_TAKEN}
    SELECT job_id, page_id, p_name AS title, '$' || printf('%.2f', p_retailprice) AS price FROM t JOIN part ON p_partkey // 20 = page_id
    """,
)
def job_run(spark, sf_dir):
    schema = Schema({"title": FieldRule("text", required=True), "price": FieldRule("price")})
    fields = [Field(n, css(f".{n}"), multiple=False) for n in ("title", "price")]
    items, _, _ = scrape.run_jobs(
        shop_jobs(spark, sf_dir), spread(rendered.catalog(spark, sf_dir)), ".product", fields, schema, css(".next"), "button", parts=(),
    )
    return items.select("job_id", "page_id", "title", "price")


@query(
    "job_preview",
    """
    SELECT CAST(r_regionkey AS BIGINT) AS job_id, p_brand || ' → /p/' || p_partkey AS links, CAST(n AS BIGINT) AS total_found,
      CASE WHEN n < 5 THEN 'few_items' WHEN n > 100 THEN 'many_items' END AS advice
    FROM region, (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rank, count(*) OVER () AS n FROM part WHERE p_partkey < 20) WHERE rank <= 5
    """,
)
def job_preview(spark, sf_dir):
    shown, totals = scrape.preview_jobs(shop_jobs(spark, sf_dir), spread(rendered.catalog(spark, sf_dir)), ".product")
    return shown.join(totals, "job_id").select("job_id", "links", "total_found", "advice")


@query(
    "job_run_gaps",
    f"""
    -- page 3 is not stored: no job goes beyond page 2
    WITH {_TAKEN}
    SELECT job_id, page_id, p_name AS title FROM t JOIN part ON p_partkey // 20 = page_id WHERE page_id < 3
    """,
)
def job_run_gaps(spark, sf_dir):
    schema = Schema({"title": FieldRule("text", required=True)})
    stored = rendered.catalog(spark, sf_dir).where("page_id != 3")
    items, _, _ = scrape.run_jobs(
        shop_jobs(spark, sf_dir), stored, ".product", [Field("title", css(".title"), multiple=False)], schema, css(".next"), "button", parts=(),
    )
    return items.select("job_id", "page_id", "title")
