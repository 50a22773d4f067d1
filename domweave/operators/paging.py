"""Listing pages of a job: URLs to visit, next-page markers, where to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domweave.functions.selectors import Selector
from domweave.functions.urls import is_valid_url, page_url
from domweave.plans import rules as R


def frontier(jobs: DataFrame) -> DataFrame:
    """Jobs to (job_id, page_no, url), one row per page a job may visit.

    Paging types that do not build URLs have one page only, because one snapshot is
    kept per URL.  ``max_pages`` is limited by the job rules, so a job stays small.
    """
    builds = F.col("pagination_type").isin("query", "path")
    last = F.when(builds, F.greatest(F.coalesce("max_pages", F.lit(R.DEFAULT_MAX_PAGES)), F.lit(1))).otherwise(1)
    pages = jobs.withColumn("page_no", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    url = page_url(
        F.col("url"), F.col("page_no"), F.col("pagination_type"),
        F.col("pagination.query_param"), F.col("pagination.path_prefix"),
    )
    return pages.select("job_id", "page_no", url.alias("url"))


def latest_snapshots(pages: DataFrame) -> DataFrame:
    """One (url, page_id) per URL: the newest snapshot, chosen without moving the source.

    Newest by ``fetched_at`` if the pages have it, equal times and pages without it by the larger page_id.
    """
    age = F.struct("fetched_at", "page_id") if "fetched_at" in pages.columns else F.col("page_id")
    return pages.groupBy("url").agg(F.max_by("page_id", age).alias("page_id"))


def snapshot_keys(pages: DataFrame) -> DataFrame:
    """The columns that tell snapshots apart, without their source."""
    return pages.select(*[c for c in ("url", "page_id", "fetched_at") if c in pages.columns])


def visit(front: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows with the snapshot of their URL; null where there is none.

    Snapshots are as many as pages, so they are not repeated for salting; a URL that is
    in very many jobs is split by adaptive execution (skew join), which repeats only
    the one partition it needs.
    """
    return front.join(latest_snapshots(pages), "url", "left")


def next_marker(
    paging: str, next_page: Selector | None, button: Selector | None = None, load_more: Selector | None = None, per_element: bool = False,
) -> Column:
    """Marker of a parsed page: does the listing go on?

    ``per_element`` is the stricter button test: some match must be enabled, without a
    disabled class and not hidden by its inline style.
    """
    chosen = {"button": button or next_page, "infinite": load_more or next_page}.get(paging, next_page)
    if next_page is None or chosen is None or paging not in ("query", "path", "button", "infinite"):
        return F.lit(False)
    found = f"size({chosen.hits()}) > 0"
    if paging == "button" and per_element:
        found = f"exists({chosen.hits()}, n -> {_USABLE})"
    elif paging == "button":
        found = f"({found} AND NOT exists({chosen.hits()}, n -> array_contains(n.classes, 'disabled')))"
    return F.expr(found)


def has_next_page(
    dom: DataFrame, paging: str, next_page: Selector | None, button: Selector | None = None,
    load_more: Selector | None = None, per_element: bool = False, keys: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """`next_marker` of every page."""
    return dom.select(*keys, next_marker(paging, next_page, button, load_more, per_element).alias("has_next"))


_USABLE = (
    "NOT map_contains_key(n.attrs, 'disabled') AND NOT array_contains(n.classes, 'disabled') "
    r"AND NOT rlike(coalesce(try_element_at(n.attrs, 'style'), ''), r'(?i)(^|;)\s*display:\s*none')"
)


def take_while_next(visited: DataFrame) -> DataFrame:
    """Pages of a job up to the first one without a marker.

    Needs job_id, page_no and has_next; a missing page counts as no marker.  The window
    spans one job's pages, at most the page limit of a job.
    """
    before = W.partitionBy("job_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)
    goes_on = F.min(F.coalesce("has_next", F.lit(False))).over(before)
    return visited.withColumn("_on", F.coalesce(goes_on, F.lit(True))).where("_on").drop("_on")


def reachability(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Syntax and availability of URLs: valid, accessible and an error code."""
    found = urls.join(latest_snapshots(pages), "url", "left")
    ok = is_valid_url(F.col("url"))
    accessible = ok & F.col("page_id").isNotNull()
    return found.select(
        *urls.columns,
        ok.alias("well_formed"),
        accessible.alias("valid"),
        accessible.alias("accessible"),
        F.when(~ok, "invalid_url").when(~accessible, "no_snapshot").alias("error"),
    )

