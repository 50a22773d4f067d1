"""Element similarity and locators.  Both stay inside the page row: no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.functions.selectors import Selector
from domweave.operators.dom import unnest
from domweave.plans import rules as R

def similarity(one: Column) -> Column:
    """Weighted likeness of an element struct and the flat element columns, at most 1."""
    part = F.col
    first, second = one["classes"], part("classes")
    common = F.size(F.filter(first, lambda c: F.array_contains(second, c)))
    classes = F.when(
        (F.size(first) > 0) & (F.size(second) > 0),
        common / F.greatest(F.size(first), F.size(second)) * R.COMMON_CLASSES,
    ).otherwise(0.0)
    score = (
        F.when(one["tag"] == part("tag"), R.SAME_TAG).otherwise(0.0)
        + classes
        + F.when(one["n_children"] == part("n_children"), R.SAME_CHILD_COUNT).otherwise(0.0)
        + F.when(one["parent_tag"] == part("parent_tag"), R.SAME_PARENT_TAG).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def path_locator_sql(node: str = "n") -> str:
    """Steps from at most five levels up, starting below body, numbered among like siblings."""

    def label(n):
        return f"concat({n}.tag, if({n}.type_count > 1, concat('[', {n}.type_index, ']'), ''))"

    # body, if it is above the element, is always its second ancestor
    up = "w.up"
    body = f"(w.body OR {up}.depth = 1 AND {up}.tag = 'body')"
    near = (
        f"aggregate(array_repeat(0, least({node}.depth, {R.LOCATOR_DEPTH - 1})), "
        f"named_struct('up', get(nodes, {node}.parent_id), 'body', false, 'steps', array({label(node)})), "
        f"(w, k) -> named_struct('up', get(nodes, {up}.parent_id), 'body', {body}, "
        f"'steps', if({body}, w.steps, concat(array({label(up)}), w.steps))), w -> w.steps)"
    )
    return f"concat('//', array_join({near}, '/'))"


def smart_locator_sql(node: str = "n", path: str | None = None) -> str:
    """By id, else by an identifying attribute, else by classes, else by ``path`` (default: the path locator)."""
    cases = [f"WHEN {node}.id <> '' THEN concat('//', {node}.tag, '[@id=\\'', {node}.id, '\\']')"]
    for name in R.LOCATOR_ATTRIBUTES:
        value = f"try_element_at({node}.attrs, '{name}')"
        cases.append(f"WHEN {value} <> '' THEN concat('//', {node}.tag, '[@{name}=\\'', {value}, '\\']')")
    tests = f"transform({node}.classes, c -> concat('contains(@class,\\'', c, '\\')'))"
    cases.append(f"WHEN size({node}.classes) > 0 THEN concat('//', {node}.tag, '[', array_join({tests}, ' and '), ']')")
    return f"CASE {' '.join(cases)} ELSE {path or path_locator_sql(node)} END"


def locators(dom: DataFrame, *keep: str) -> DataFrame:
    """Every element with its smart and its path locator."""
    keep = keep or ("page_id",)
    rows = F.expr(
        "transform(nodes, n -> named_struct('node_id', n.node_id, 'tag', n.tag, "
        f"'locator', {smart_locator_sql(path='NULL')}, 'path', {path_locator_sql()}))"
    )
    return unnest(dom, rows, *keep).withColumn("locator", F.coalesce("locator", "path"))  # a path is made once


def similar_elements(
    dom: DataFrame, selector: Selector, threshold: float = R.SIMILARITY_THRESHOLD, *keep: str
) -> DataFrame:
    """Elements like the first match of ``selector`` on their page.

    The base element travels with its own page, so nothing is compared across pages
    and the pass is linear in the number of elements.  Order a page's rows by
    ``similarity`` descending and ``node_id`` for the ranking.
    """
    keep = keep or ("page_id",)
    base = F.expr(f"get({selector.hits()}, 0)").alias("base")
    narrow = ", ".join(f"'{c}', n.{c}" for c in ("node_id", "tag", "parent_tag", "classes", "n_children"))
    candidates = F.expr(f"transform(nodes, n -> named_struct({narrow}, 'locator', {smart_locator_sql()}))")
    pages = dom.select(*keep, base, candidates.alias("candidates")).where(F.col("base").isNotNull())
    rows = unnest(pages, F.col("candidates"), *keep, "base")
    scored = rows.where(F.col("node_id") != F.col("base.node_id")).select(
        *keep, "node_id", "tag", similarity(F.col("base")).alias("similarity"), "locator"
    )
    return scored.where(F.col("similarity") >= threshold)

