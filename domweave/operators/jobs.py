"""Job tables: defaults, rule checks, extractor choice, estimates, quality and fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.functions.skew import join_per_key
from domweave.functions.text import trim
from domweave.functions.urls import is_valid_url
from domweave.operators.dom import parse_pages
from domweave.plans import rules as R
from domweave.session import written

JOB_SCHEMA = """
job_id long, url string, item_selector string, pagination_type string,
pagination struct<query_param:string,path_prefix:string,next_page_selector:string,load_more_selector:string,
  next_button_selector:string,next_page_xpath:string>,
max_pages int, delay int, strategy string, spa boolean, infinite_scrolling boolean,
enable_smart_analysis boolean, use_puppeteer boolean,
xpath_selectors array<struct<xpath:string,name:string,type:string,attribute:string,multiple:boolean,fallback:string>>,
tag_selectors array<struct<name:string,tag:string,selector:string,attribute:string>>,
file_extension string, wait_strategy string, enable_data_validation boolean, include_metadata boolean
"""


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Fill unset options.  Empty text and 0 count as unset."""

    def text(name, default):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    def number(name, default):
        return F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(default))

    def flag(name, default):
        return F.coalesce(F.col(name), F.lit(default))

    filled = {
        "item_selector": text("item_selector", R.DEFAULT_SELECTOR),
        "pagination_type": text("pagination_type", R.DEFAULT_PAGING),
        "file_extension": text("file_extension", R.DEFAULT_FORMAT),
        "max_pages": number("max_pages", R.DEFAULT_MAX_PAGES),
        "delay": number("delay", R.DEFAULT_DELAY),
        "wait_strategy": text("wait_strategy", R.DEFAULT_WAIT),
        "strategy": F.nullif(F.col("strategy"), F.lit("")),
        "use_puppeteer": flag("use_puppeteer", False),
        "spa": flag("spa", False),
        "infinite_scrolling": flag("infinite_scrolling", False),
        "include_metadata": flag("include_metadata", False),
        "enable_smart_analysis": flag("enable_smart_analysis", True),
        "enable_data_validation": flag("enable_data_validation", True),
        "xpath_selectors": F.coalesce("xpath_selectors", F.array()),
        "tag_selectors": F.coalesce("tag_selectors", F.array()),
    }
    return jobs.withColumns({name: column for name, column in filled.items() if name in jobs.columns})


def job_errors() -> Column:
    """Codes of the rules a job (with defaults) breaks, in rule order."""
    c = F.col

    def code(condition, name):
        return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(name))).otherwise(
            F.array().cast("array<string>")
        )

    blank = lambda v: trim(F.coalesce(v, F.lit(""))) == ""
    has_browser = c("use_puppeteer") | F.coalesce(c("strategy") == "smart-puppeteer", F.lit(False))

    def selector_errors(s, i):
        number = (i + 1).cast("string")
        return F.filter(
            F.array(
                F.when(s["xpath"].isNull() & s["name"].isNull(), F.concat(F.lit("xpath_format:"), number)),
                F.when(
                    blank(s["xpath"]) & (s["xpath"].isNotNull() | s["name"].isNotNull()),
                    F.concat(F.lit("xpath_missing:"), number),
                ),
                F.when(s["name"].isNotNull() & blank(s["name"]), F.concat(F.lit("xpath_name_missing:"), number)),
                F.when(
                    (s["type"] != "") & ~s["type"].isin(R.ALLOWED_SELECTOR_TYPES),
                    F.concat(F.lit("xpath_type:"), s["type"]),
                ),
            ),
            lambda e: e.isNotNull(),
        )

    no_url = F.coalesce(c("url"), F.lit("")) == ""
    return F.concat(
        code(no_url, "url_required"),
        code(~no_url & (F.length("url") > R.MAX_URL_LENGTH), "url_too_long"),
        code(~no_url & (F.length("url") <= R.MAX_URL_LENGTH) & ~is_valid_url(c("url")), "url_invalid"),
        code(F.size("tag_selectors") > R.MAX_SELECTORS, "too_many_selectors"),
        code(F.size("xpath_selectors") > R.MAX_SELECTORS, "too_many_xpath_selectors"),
        F.coalesce(F.flatten(F.transform("xpath_selectors", selector_errors)), F.array().cast("array<string>")),
        code(c("max_pages") > R.MAX_PAGES, "too_many_pages"),
        code(~c("file_extension").isin(R.ALLOWED_FORMATS), "file_format"),
        code(~c("pagination_type").isin(R.ALLOWED_PAGING), "pagination_type"),
        code(~c("wait_strategy").isin(R.ALLOWED_WAITS), "wait_strategy"),
        code(~c("strategy").isin(list(R.STRATEGIES)), "strategy"),
        code(c("spa") & ~has_browser, "spa_needs_browser"),
        code(c("infinite_scrolling") & ~has_browser, "scrolling_needs_browser"),
        code(
            (F.size("xpath_selectors") > 0) & ~c("strategy").isin("xpath", "smart-puppeteer"),
            "xpath_needs_xpath_strategy",
        ),
    )


def job_warnings() -> Column:
    """Codes of option combinations that work badly together."""
    c = F.col
    found = F.array(
        F.when(c("enable_smart_analysis") & (c("strategy") == "cheerio"), F.lit("analysis_prefers_browser")),
        F.when(c("spa") & (c("delay") < 2000), F.lit("spa_needs_longer_delay")),
        F.when((c("max_pages") > 10) & (c("strategy") == "smart-puppeteer"), F.lit("smart_is_slow_on_many_pages")),
        F.when(
            c("infinite_scrolling") & (c("pagination_type") != "infinite"), F.lit("scrolling_prefers_infinite_paging")
        ),
    )
    return F.array_compact(found)


def chosen_strategy() -> Column:
    """Extractor a job runs with."""
    c = F.col
    smart = c("spa") | c("infinite_scrolling") | c("enable_smart_analysis")
    return (
        F.when(c("strategy").isin(list(R.STRATEGIES)), c("strategy"))
        .when(c("use_puppeteer") & smart, "smart-puppeteer")
        .when(c("use_puppeteer"), "puppeteer")
        .when(F.size("xpath_selectors") > 0, "xpath")
        .when(smart, "smart-puppeteer")
        .otherwise("cheerio")
    )


def suggested_strategy() -> Column:
    """Extractor a job would be advised to use (other order than ``chosen_strategy``)."""
    c = F.col
    return (
        F.when(c("strategy").isNotNull(), c("strategy"))
        .when(c("spa") | c("infinite_scrolling") | c("enable_smart_analysis"), "smart-puppeteer")
        .when(F.size("xpath_selectors") > 0, "xpath")
        .when(c("use_puppeteer"), "puppeteer")
        .otherwise("cheerio")
    )


def time_estimate(strategy: Column) -> Column:
    """Estimated milliseconds: time per page plus the delays between pages."""
    per_page = F
    for name, milliseconds in R.MS_PER_PAGE.items():
        per_page = per_page.when(strategy == name, milliseconds)
    pages = F.col("max_pages").cast("long")
    return per_page.otherwise(R.MS_PER_PAGE["cheerio"]) * pages + F.col("delay").cast("long") * (pages - 1)


def format_duration(milliseconds: Column) -> Column:
    """Hours, minutes and seconds, leading zero units left out."""
    seconds = F.floor(milliseconds / 1000)
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    rest_s = F.concat((seconds % 60).cast("string"), F.lit(R.SECONDS))
    rest_m = F.concat((minutes % 60).cast("string"), F.lit(R.MINUTES + " "), rest_s)
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(R.HOURS + " "), rest_m))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit(R.MINUTES + " "), rest_s))
        .otherwise(F.concat(seconds.cast("string"), F.lit(R.SECONDS)))
    )


def strategy_catalogue(spark) -> DataFrame:
    """Name, display name and features of the extractors."""
    rows = [(n, title, features) for n, (title, features) in R.STRATEGIES.items()]
    return spark.createDataFrame(rows, "strategy string, display_name string, features array<string>")


def quality_score(items: Column, rate: Column, errors: Column, normalized: bool = False) -> Column:
    """Score 0..1 of a run.  ``rate`` is a percentage, as the success rate is.

    As the percentage is used unscaled, most runs with any success score 1;
    ``normalized=True`` divides it by 100.
    """
    share = rate / 100 if normalized else rate
    score = (
        F.when(items > 0, 0.3).otherwise(0.0)
        + F.when(items > 10, 0.2).otherwise(0.0)
        + F.when(items > 50, 0.1).otherwise(0.0)
        + share * 0.3
        - F.least(errors * 0.1, F.lit(0.3))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def run_summary(items: DataFrame, counters: DataFrame, errors: DataFrame, job: str = "job_id") -> DataFrame:
    """One row per job: request counters, item count, error count and quality."""
    counted = items.groupBy(job).agg(F.count(F.lit(1)).alias("total_items"))
    failures = errors.groupBy(job).agg(F.count(F.lit(1)).alias("errors"))
    joined = counters.join(counted, job, "left").join(failures, job, "left").fillna(0, ["total_items", "errors"])
    return joined.withColumn(
        "quality", quality_score(F.col("total_items"), F.col("success_rate"), F.col("errors"))
    )


def fallback_choice(outcomes: DataFrame) -> DataFrame:
    """Extractor whose items are added to a job's own, if any.

    ``outcomes`` has job_id, extractor, items, is_primary, quality and failed, one row
    per job and extractor (at most four per job).  A fallback is looked for when the
    primary failed or its quality is low; the first of its chain with more items wins.
    """
    chains = F.create_map(*[
        part for name, chain in R.FALLBACKS.items() for part in (F.lit(name), F.array(*[F.lit(x) for x in chain]))
    ])
    per_job = outcomes.groupBy("job_id").agg(
        F.max(F.when(F.col("is_primary"), F.struct("extractor", "items", "quality", "failed"))).alias("own"),
        F.map_from_entries(F.collect_list(F.struct("extractor", "items"))).alias("counts"),
    )
    primary = F.col("own")
    needed = F.coalesce(primary["failed"], F.lit(True)) | (primary["quality"] < R.LOW_QUALITY)
    better = F.filter(
        F.try_element_at(chains, primary["extractor"]),
        lambda name: F.coalesce(F.try_element_at(F.col("counts"), name), F.lit(0)) > primary["items"],
    )
    return per_job.select(
        "job_id",
        primary["extractor"].alias("primary"),
        primary["items"].alias("primary_items"),
        F.when(needed, F.get(better, 0)).alias("fallback"),
    )


class Extractors:
    """Named extractors, each a function from parsed pages to items."""

    def __init__(self):
        self._known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, extractor: Callable[[DataFrame], DataFrame]) -> Extractors:
        self._known[name] = extractor
        return self

    def run(self, name: str, dom: DataFrame) -> DataFrame:
        """Items of one extractor, without fallback."""
        if name not in self._known:
            raise KeyError(f"no extractor named {name!r}")
        return dom.transform(self._known[name]).withColumn("extractor", F.lit(name))

    def run_with_fallback(
        self, primary: str, pages: DataFrame, summary: DataFrame, order: tuple[str, ...] = ("page_id", "item_id")
    ) -> DataFrame:
        """Items of the primary extractor plus those of the winning fallback of each job.

        ``pages`` (job_id, page_id, html) are parsed here, for a fallback only those of
        the jobs that still need one.  ``summary`` has job_id, success_rate, errors and
        failed.  Each extractor's items are written once and then counted and returned
        from there.
        """
        result = written(self.run(primary, parse_pages(pages)), f"items-{primary}")
        counted = result.groupBy("job_id").agg(F.count(F.lit(1)).alias("own_items"))
        own = summary.join(counted, "job_id", "left").fillna(0, ["own_items"])
        quality = quality_score(F.col("own_items"), F.col("success_rate"), F.col("errors"))
        waiting = own.where(F.col("failed") | (quality < R.LOW_QUALITY)).select("job_id", "own_items")
        for name in R.FALLBACKS.get(primary, []):
            if name not in self._known:
                continue
            some = join_per_key(pages, waiting.select("job_id"), ["job_id"], ["page_id"], "left_semi")
            items = written(self.run(name, parse_pages(some)), f"items-{name}")
            tried = waiting.join(items.groupBy("job_id").agg(F.count(F.lit(1)).alias("items")), "job_id", "left")
            won = tried.where(F.coalesce("items", F.lit(0)) > F.col("own_items")).select("job_id")
            added = join_per_key(items, won, ["job_id"], list(order), "left_semi")
            result = result.unionByName(added, allowMissingColumns=True)
            waiting = waiting.join(won, "job_id", "left_anti")
        return result
