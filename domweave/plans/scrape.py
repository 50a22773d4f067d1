"""Whole runs: jobs to validated items, and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domweave.functions import text
from domweave.functions.selectors import Selector
from domweave.functions.skew import join_per_key
from domweave.operators import jobs as job_ops
from domweave.operators import analyze, crawl_log, paging, preview
from domweave.operators.dom import parse_pages
from domweave.operators.extract import Field, drop_empty, extract_items
from domweave.operators.field_rules import apply_rules
from domweave.operators.rule_sets import MARK, evaluate, rule_sets
from domweave.operators.validate import Schema, apply_validation
from domweave.plans import rules as R
from domweave.session import written


def job_visits(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """(job_id, page_no, page_id) of every page the accepted jobs may visit; page_id is null where none is stored.

    Jobs that break a rule are left out.
    """
    ready = job_ops.with_defaults(jobs).where(F.size(job_ops.job_errors()) == 0)
    return paging.visit(paging.frontier(ready), paging.snapshot_keys(pages)).select("job_id", "page_no", "page_id")


def job_pages(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """The stored pages among the visits."""
    return job_visits(jobs, pages).where(F.col("page_id").isNotNull())


def _parsed(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Each visited page once, however many jobs visit it."""
    wanted = visits.select("page_id").where(F.col("page_id").isNotNull()).distinct()
    return parse_pages(pages.select("page_id", "html").join(wanted, "page_id", "left_semi"))


def run_jobs(
    jobs: DataFrame, pages: DataFrame, item_selector: str | Selector, fields: list[Field] = (),
    schema: Schema | None = None, next_page: Selector | None = None, paging_type: str = "query",
    parts: tuple[str, ...] = ("text", "links", "images"),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, messages, stats) of jobs over stored pages.

    Pages are taken while the one before had a next-page marker and none was missing, items are extracted
    and cleaned.  Without a schema the first item decides its types.  Markers and items
    are found per page and only then handed to the jobs that visit it.
    """
    visits = job_visits(jobs, pages)
    dom = _parsed(visits, pages)
    markers = paging.has_next_page(dom, paging_type, next_page)
    # missing pages stay until the stop rule has seen them: a job ends there
    taken = paging.take_while_next(visits.join(markers, "page_id", "left")).drop("has_next").where(F.col("page_id").isNotNull())
    items = drop_empty(extract_items(dom, item_selector, fields, parts=parts))
    return apply_validation(taken.join(items, "page_id"), schema, "job_id", ("page_no", "page_id", "item_id"))


def _stage(jobs: DataFrame, visits: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, counters) of jobs with the extractor in ``strategy``, over pages that are parsed already.

    Where the item selector cannot be read the first page fails, except for expressions, which then find nothing.
    """
    job_sets, sets = rule_sets(jobs)
    known = written(
        job_sets.join(sets.select("set_id", "readable"), "set_id").join(jobs.select("job_id", "strategy"), "job_id")
        .withColumn("broken", ~F.col("readable") & (F.col("strategy") != "xpath")).drop("readable"), "job-sets")
    own = written(visits.join(known, "job_id"), "own-visits")
    found = evaluate(dom, own.where(F.col("page_id").isNotNull() & ~F.col("broken")).select("page_id", "set_id"), sets)
    marks = found.where(F.col("item_id") == MARK).select("page_id", "set_id", "has_next")
    taken = written(paging.take_while_next(own.join(marks, ["page_id", "set_id"], "left")).drop("has_next"), "taken")
    good = F.col("page_id").isNotNull() & ~F.col("broken")
    sizes = dom.select("page_id", "bytes")
    counters = taken.join(sizes, "page_id", "left").groupBy("job_id").agg(
        F.count_if(good).alias("successful_requests"), F.count_if(~good).alias("failed_requests"),
        F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes_processed"))
    items = taken.where(good).drop("broken").join(found.where(F.col("item_id") != MARK).drop("has_next"), ["page_id", "set_id"])
    return written(items.drop("set_id").withColumnRenamed("strategy", "extractor"), "items"), counters


def run_mixed(jobs: DataFrame, pages: DataFrame, normalized: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, summary) of jobs that each bring their own rules, paging and extractor.

    Every page is parsed once, whichever and however many jobs visit it; all extractors and stages read
    the same elements, and jobs with equal rules share their results.  Jobs of the smart extractor take the item selector
    that suits their first page.  A job whose result is poor, or whose primary extractor
    fails, tries its fallbacks in order, only those jobs go on, and the first fallback with more
    items is added to what the job has.

    ``items`` has job_id, page_no, page_id, item_id, extractor, tag_name, text, html, attributes, links, images and fields (a map of
    arrays).  ``summary`` is one row per accepted job: extractor, winning fallback, totals, requests, errors, bytes, success rate
    and quality (`quality_score`; ``normalized`` as there).  A page that is not stored, or a first page whose item selector cannot be
    read, is a failed request and an error, and ends the job.
    """
    ready = job_ops.with_defaults(jobs).where(F.size(job_ops.job_errors()) == 0)
    ready = written(ready.withColumn("strategy", job_ops.chosen_strategy()), "jobs")
    visits = written(paging.visit(paging.frontier(ready), paging.snapshot_keys(pages)).select("job_id", "page_no", "page_id"), "visits")
    wanted = visits.select("page_id").where(F.col("page_id").isNotNull()).distinct()
    source = pages.select("page_id", "html").join(wanted, "page_id", "left_semi").withColumn("bytes", F.octet_length("html"))
    dom = written(parse_pages(source), "parsed")

    smart = ready.where((F.col("strategy") == "smart-puppeteer") & F.col("enable_smart_analysis")).select("job_id")
    first = visits.where("page_no = 1").join(smart, "job_id", "left_semi").select("job_id", "page_id")
    typed = analyze.page_features(dom.join(first.select("page_id").distinct(), "page_id", "left_semi"), "page_id", "nodes")
    suggested = first.join(typed.select("page_id", analyze.suggested_item_selector().alias("suggested")), "page_id").select("job_id", "suggested")
    adapted = written(
        ready.join(suggested, "job_id", "left").withColumn("item_selector", F.coalesce("suggested", "item_selector")).drop("suggested"), "adapted")

    items, counters = _stage(adapted, visits, dom)
    totals = items.groupBy("job_id").agg(F.count(F.lit(1)).alias("total_items"))
    zero = ["total_items", "successful_requests", "failed_requests", "bytes_processed"]
    summary = ready.select("job_id", "strategy").join(counters, "job_id", "left").join(totals, "job_id", "left").fillna(0, zero)
    quality = job_ops.quality_score(F.col("total_items"), crawl_log.success_rate(F.col("successful_requests"), F.col("failed_requests")), F.col("failed_requests"), normalized)
    summary = written(summary.withColumn("quality", quality).withColumn("errors", F.col("failed_requests")), "summary")

    # staged: the k-th fallback of every job that still waits, whatever its primary is
    chains = F.create_map(*[part for name, chain in R.FALLBACKS.items() for part in (F.lit(name), F.array(*[F.lit(c) for c in chain]))])
    waiting = summary.where(F.col("quality") < R.LOW_QUALITY).select("job_id", F.try_element_at(chains, "strategy").alias("chain"), "total_items")
    results, wins = [items], []
    for k in range(max(map(len, R.FALLBACKS.values()))):
        now = waiting.select("job_id", F.get("chain", k).alias("fallback"), F.col("total_items").alias("own")).where(F.col("fallback").isNotNull())
        if now.isEmpty():
            break
        next_jobs = written(ready.join(now, "job_id").withColumn("strategy", F.col("fallback")).drop("fallback", "own"), "fallback-jobs")
        own = visits.join(next_jobs.select("job_id"), "job_id", "left_semi")
        some = dom.join(own.select("page_id").distinct(), "page_id", "left_semi")
        more, requests = _stage(next_jobs, own, some)
        counted = more.groupBy("job_id").agg(F.count(F.lit(1)).alias("added"))
        won = written(
            now.join(counted, "job_id").where(F.col("added") > F.col("own")).join(requests, "job_id")
            .select("job_id", "fallback", "added", F.col("successful_requests").alias("more_pages")), "won")
        results.append(more.join(won.select("job_id"), "job_id", "left_semi"))
        wins.append(won)
        waiting = waiting.join(won.select("job_id"), "job_id", "left_anti")
    for name in ("fallback", "added", "more_pages"):
        summary = summary if wins else summary.withColumn(name, F.lit(None).cast("string" if name == "fallback" else "long"))
    if wins:
        summary = summary.join(reduce(DataFrame.unionByName, wins), "job_id", "left")
    pages_ok = F.col("successful_requests") + F.coalesce("more_pages", F.lit(0))
    summary = summary.withColumns({
        "total_items": F.col("total_items") + F.coalesce("added", F.lit(0)), "pages_processed": pages_ok, "successful_requests": pages_ok}).drop("added", "more_pages")
    return reduce(DataFrame.unionByName, results), summary.withColumn(
        "success_rate", crawl_log.success_rate(F.col("successful_requests"), F.col("failed_requests")))


_KEYS = ("page_no", "page_id", "item_id")


def item_values(items: DataFrame) -> DataFrame:
    """(job_id, page_no, page_id, item_id, field, value): the text of every item and its fields with one value."""
    single = F.transform(
        F.filter(F.map_entries("fields"), lambda e: F.size(e["value"]) == 1), lambda e: F.struct(e["key"].alias("field"), F.get(e["value"], 0).alias("value")))
    own = F.filter(F.array(F.when(F.col("text").isNotNull(), F.struct(F.lit("text").alias("field"), F.col("text").alias("value")))), lambda e: e.isNotNull())
    none = F.array().cast("array<struct<field:string,value:string>>")
    # a field that is called text as well wins over the item's own text
    named = F.coalesce(single, none)
    all_of = F.concat(F.filter(own, lambda e: ~F.exists(named, lambda f: f["field"] == "text")), named)
    return items.select("job_id", *_KEYS, F.inline(all_of))


def validate_mixed(items: DataFrame, jobs: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, messages, stats) of a mixed run: values cleaned and checked by the rules of their job, or by its first item.

    Jobs that switch validation off keep their items.  Fields with several values and the other parts of an item stay as they are.
    """
    checks = job_ops.with_defaults(jobs).where("enable_data_validation").select("job_id").distinct()
    checked = written(join_per_key(items, checks, ["job_id"], list(_KEYS), "left_semi"), "to-check")
    values, messages, stats = apply_rules(item_values(checked), rules, "job_id", _KEYS)
    cleaned = checked.join(values.select("job_id", *_KEYS, F.col("fields").alias("values")), ["job_id", *_KEYS])
    others = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,array<string>>")), lambda k, v: ~F.map_contains_key("values", k))
    single = F.map_filter("values", lambda k, v: (k != "text") | F.coalesce(F.map_contains_key("fields", k), F.lit(False)))
    merged = F.map_concat(others, F.transform_values(single, lambda k, v: F.array(v)))
    own_text = F.when(F.coalesce(F.map_contains_key("fields", "text"), F.lit(False)), F.col("text")).otherwise(F.try_element_at("values", F.lit("text")))
    out = cleaned.withColumn("new_text", own_text).withColumn("fields", F.when(F.size(merged) > 0, merged)).withColumn("text", F.col("new_text")).drop("new_text", "values")
    unchecked = join_per_key(items, checks, ["job_id"], list(_KEYS), "left_anti")
    return out.select(*items.columns).unionByName(unchecked), messages, stats


def _shown_entries(items: DataFrame) -> Column:
    """Keys of an item with the type and the readable form of their values, in order."""
    def entry(name, kind, shown, place):
        return F.struct(F.lit(place).alias("place"), F.lit(name).alias("field") if isinstance(name, str) else name.alias("field"), kind.alias("type"), shown.alias("value"))

    shown = preview.format_items(items.select("text", "html", "attributes", "links", "images")).columns
    forms = {f: preview._shown(F.col(f), items.schema[f].dataType, f) for f in shown}
    own = [
        F.when(F.col(f).isNotNull(), entry(f, text.preview_type(F.col(f), items.schema[f].dataType), forms[f], i))
        for i, f in enumerate(("tag_name", "text", "html", "attributes", "links", "images")) if f in forms]
    single = lambda e: F.size(e["value"]) == 1
    fields = F.transform(F.coalesce(F.map_entries("fields"), F.array().cast("array<struct<key:string,value:array<string>>>")), lambda e: entry(
        e["key"], F.when(single(e), text.preview_type(F.get(e["value"], 0))).otherwise("array"), F.array_join(e["value"], "; "), 9))
    return F.concat(F.filter(F.array(*own), lambda e: e.isNotNull()), fields)


def preview_mixed(jobs: DataFrame, pages: DataFrame, limit: int = R.PREVIEW_ITEMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, structure, totals) of the first page of jobs that each bring their own rules.

    ``values``: job_id, rank, field, type, value of the first ``limit`` items; ``structure``: the types and first three values
    of each field of a job; ``totals``: items found, advice, and what validation by the first item's types finds: number of
    errors, errors by type, the first three.  Only first pages are parsed.
    """
    ready = job_ops.with_defaults(jobs).where(F.size(job_ops.job_errors()) == 0)
    ready = written(ready.withColumn("strategy", job_ops.chosen_strategy()), "jobs")
    visits = written(preview.first_pages(paging.visit(paging.frontier(ready), paging.snapshot_keys(pages))).select("job_id", "page_no", "page_id"), "visits")
    dom = written(_parsed(visits, pages).withColumn("bytes", F.octet_length("html")), "parsed")
    items, _ = _stage(ready, visits, dom)
    first = preview.preview_items(items, "job_id", _KEYS, limit)
    values = written(first.select("job_id", "rank", F.inline(_shown_entries(items))), "values")
    nth = F.row_number().over(Window.partitionBy("job_id", "field").orderBy("rank"))
    held = values.withColumn("nth", nth)  # at most ``limit`` values of a field
    structure = held.groupBy("job_id", "field").agg(
        F.min("place").alias("place"), F.sort_array(F.collect_set("type")).alias("types"),
        F.sort_array(F.collect_list(F.when(F.col("nth") <= R.SAMPLE_COUNT, F.struct("nth", "value")))).alias("samples"),
    ).withColumn("samples", F.transform("samples", lambda s: s["value"])).drop("place")
    _, messages, _ = validate_mixed(items, jobs)
    errors = messages.where("severity = 'error'")
    by_type = errors.groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("job_id").agg(
        F.sum("n").alias("errors"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "type", "n"))), ", ").alias("error_types"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.col("issue_no") != -2, *_KEYS, "issue_no"))
    examples = errors.withColumn("place", place).where(F.col("place") <= R.SAMPLE_COUNT).groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "type", "field", "value"))).alias("examples"))
    totals = ready.select("job_id").join(preview.total_found(items), "job_id", "left").fillna(0, ["total_found"])
    totals = totals.join(by_type, "job_id", "left").join(examples, "job_id", "left").fillna(0, ["errors"])
    return values.drop("place"), structure, totals.withColumn("advice", preview.preview_advice(F.col("total_found")))


def preview_jobs(
    jobs: DataFrame, pages: DataFrame, item_selector: str | Selector, fields: list[Field] = (), limit: int = R.PREVIEW_ITEMS,
) -> tuple[DataFrame, DataFrame]:
    """(readable first items, totals and advice) per job, from its first page only.

    The page limit comes before parsing, since the parser is a barrier for filters.
    """
    first = preview.first_pages(job_pages(jobs, pages))
    items = drop_empty(extract_items(_parsed(first, pages), item_selector, fields, parts=("text", "links", "images")))
    found = first.join(items, "page_id")
    keys = ("job_id", "page_no", "page_id")
    shown = preview.format_items(preview.preview_items(found, "job_id", ("page_no", "page_id", "item_id"), limit), keys)
    totals = first.select("job_id").join(preview.total_found(found), "job_id", "left").fillna(0, ["total_found"])
    return shown, totals.withColumn("advice", preview.preview_advice(F.col("total_found")))
