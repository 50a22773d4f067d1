"""Items of a page: texts, links, images, attributes and named fields.

One pass: every element that can contribute to an item (the item roots, their
links, images and field matches) is tagged with its role and the ids of the item
roots above it, by array lookups inside the page row.  Only those elements are
unnested and grouped by (page, item), with map-side partial aggregation; a group
never exceeds one page.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domweave.functions.selectors import Selector, css, literal, xpath
from domweave.functions.text import trim
from domweave.operators.dom import above_sql, inner_html, text_of, text_sql, unnest

ROLE = "struct<role:int,item_id:int>"


@dataclass(frozen=True)
class Field:
    """A named value of an item.

    ``within`` narrows the search to descendants of matching elements inside the
    item.  ``fallback`` is used for items where ``selector`` matches nothing.
    """

    name: str
    selector: Selector
    kind: str = "text"  # text | html | attribute
    attribute: str | None = None
    within: Selector | None = None
    fallback: Selector | None = None
    trimmed: bool = True
    keep_empty: bool = False
    multiple: bool = True

    @staticmethod
    def static(tag: str | None = None, selector: str | None = None, name: str | None = None) -> Field:
        """Tag rule of the static extractor: every match counts, empty texts too."""
        return Field(name or tag or selector, css(selector or tag), keep_empty=True)

    @staticmethod
    def scoped(tag: str, selector: str | None = None, attribute: str | None = None) -> Field:
        """Tag rule with an outer selector and an optional attribute; empties dropped."""
        return Field(
            tag, css(tag), "attribute" if attribute else "text", attribute, css(selector) if selector else None
        )

    @staticmethod
    def by_xpath(expression, name, kind="text", attribute=None, multiple=False, fallback=None) -> Field:
        return Field(
            name, xpath(expression), kind, attribute, None, xpath(fallback) if fallback else None,
            trimmed=False, multiple=multiple,
        )


def _value(field: Field) -> Column:
    if field.kind == "attribute":
        return F.try_element_at("attrs", F.lit(field.attribute))
    if field.kind == "html":
        return inner_html()
    return text_of(raw=not field.trimmed)


def _ordered(condition: Column, *parts: Column) -> Column:
    """Values of the matching rows of a group, in document order."""
    return F.sort_array(F.collect_list(F.when(condition, F.struct("node_id", *parts))))


def extract_items(
    dom: DataFrame,
    item_selector: str | Selector = "body",
    fields: list[Field] = (),
    keys: tuple[str, ...] = ("page_id",),
    parts: tuple[str, ...] = ("text", "own_text", "html", "attributes", "links", "images"),
) -> DataFrame:
    """One row per item: ``keys``, ``item_id``, ``tag_name``, ``parts`` and the fields.

    A missing key of the item is a null column; fields are arrays of strings
    (``multiple=False``: the first value).  ``html`` and html fields need the page
    source in ``dom``; leave them out of ``parts`` and the source is never carried.
    """
    root = css(item_selector) if isinstance(item_selector, str) else item_selector

    # roles: 0 the item itself, 1 link, 2 image, then two per field (selector, fallback)
    searches = []
    if "links" in parts:
        searches.append((1, css("a[href]"), None))
    if "images" in parts:
        searches.append((2, css("img[src]"), None))
    for i, field in enumerate(fields):
        searches.append((3 + 2 * i, field.selector, field.within))
        if field.fallback is not None:
            searches.append((4 + 2 * i, field.fallback, field.within))

    none = f"cast(array() AS array<{ROLE}>)"
    is_root = root.sql("n")
    roles = [f"if({is_root}, array(named_struct('role', 0, 'item_id', n.node_id)), {none})"]
    for role, selector, within in searches:
        inside = f"transform({above_sql(root, 'n', within)}, up -> named_struct('role', {role}, 'item_id', up))"
        roles.append(f"if({selector.sql('n')}, {inside}, {none})")
    candidate = " OR ".join([is_root, *[selector.sql("n") for _, selector, _ in searches]])

    wanted = ["node_id", "tag", "attrs", "own_text", "text_start", "text_end", "trim_start", "trim_end"]
    wanted += ["html_start", "html_end"]
    needs_html = "html" in parts or any(f.kind == "html" for f in fields)
    named = ", ".join(f"'{c}', n.{c}" for c in wanted)
    tagged = F.expr(
        f"transform(filter(nodes, n -> {candidate}), n -> named_struct({named}, 'roles', concat({', '.join(roles)})))"
    )
    carried = [*keys, "doc_text"] + (["html"] if needs_html else [])
    rows = unnest(dom, tagged, *carried).select("*", F.inline_outer("roles")).where(F.col("item_id").isNotNull())

    role = F.col("role")
    text = text_of()
    value = F.when((role == 0) | (role == 1), text)
    for i, field in enumerate(fields):
        value = value.when(role.isin(3 + 2 * i, 4 + 2 * i), _value(field))
    columns = [*keys, "item_id", "role", "node_id", "tag", "attrs", "own_text", value.alias("value")]
    if "html" in parts:
        columns.append(F.when(role == 0, inner_html()).alias("inner"))
    rows = rows.select(*columns)

    # the item's own row is collected (one entry): string maxima would force a sort
    own = ["tag"]
    own += ["value"] if "text" in parts else []
    own += ["own_text"] if "own_text" in parts else []
    own += ["inner"] if "html" in parts else []
    own += ["attrs"] if "attributes" in parts else []
    aggregates = [F.collect_list(F.when(role == 0, F.struct(*own))).alias("_own")]
    if "links" in parts:
        href = F.try_element_at("attrs", F.lit("href"))
        good = (role == 1) & (href != "") & (F.col("value") != "")
        aggregates.append(_ordered(good, href.alias("href"), F.col("value").alias("text")).alias("_links"))
    if "images" in parts:
        src = F.try_element_at("attrs", F.lit("src"))
        alt = F.coalesce(F.try_element_at("attrs", F.lit("alt")), F.lit(""))
        aggregates.append(_ordered((role == 2) & (src != ""), src.alias("src"), alt.alias("alt")).alias("_images"))
    for i, field in enumerate(fields):
        aggregates.append(_ordered(role == 3 + 2 * i, F.col("value").alias("value")).alias(f"_f{i}"))
        if field.fallback is not None:
            aggregates.append(_ordered(role == 4 + 2 * i, F.col("value").alias("value")).alias(f"_b{i}"))
    grouped = rows.groupBy(*keys, "item_id").agg(*aggregates)

    def filled(array: Column) -> Column:
        return F.when(F.size(array) > 0, array)

    me = F.get("_own", 0)
    texts = {"text": "value", "own_text": "own_text", "html": "inner"}
    out = [*keys, "item_id", me["tag"].alias("tag_name")]
    out += [F.nullif(me[texts[p]], F.lit("")).alias(p) for p in parts if p in texts]
    if "attributes" in parts:
        out.append(F.when(F.size(me["attrs"]) > 0, me["attrs"]).alias("attributes"))
    if "links" in parts:
        out.append(
            filled(F.transform("_links", lambda s: F.struct(s["href"].alias("href"), s["text"].alias("text")))).alias(
                "links"
            )
        )
    if "images" in parts:
        out.append(
            filled(F.transform("_images", lambda s: F.struct(s["src"].alias("src"), s["alt"].alias("alt")))).alias(
                "images"
            )
        )
    for i, field in enumerate(fields):
        found = F.col(f"_f{i}")
        if field.fallback is not None:
            found = F.when(F.size(found) > 0, found).otherwise(F.col(f"_b{i}"))
        values = F.transform(found, lambda s: s["value"])
        if not field.keep_empty:
            values = F.filter(values, lambda v: F.coalesce(v != "", F.lit(False)))
        values = filled(values)
        out.append((values if field.multiple else F.get(values, 0)).alias(field.name))
    return grouped.select(*out)


def drop_empty(items: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Drop items in which every part is missing."""
    parts = [c for c in items.columns if c not in (*keys, "item_id", "tag_name")]
    return items.where(reduce(or_, [F.col(f"`{c}`").isNotNull() for c in parts]))


def scalar(values: Column) -> Column:
    """A single match as itself, several as a JSON array (the mixed form of an item key)."""
    return F.when(F.size(values) == 1, F.get(values, 0)).when(F.size(values) > 1, F.to_json(values))


def interactive_extras(nodes: DataFrame) -> DataFrame:
    """``data-*`` values, inline-style hiding and click handlers of each element."""
    return nodes.select(
        "page_id",
        "node_id",
        "tag",
        F.map_filter("attrs", lambda k, v: F.startswith(k, F.lit("data-"))).alias("data_attributes"),
        F.coalesce(
            F.rlike(F.try_element_at("attrs", F.lit("style")), F.lit(r"(?i)(^|;)\s*display:\s*none")), F.lit(False)
        ).alias("is_hidden"),
        F.map_contains_key("attrs", "onclick").alias("has_click_handler"),
    )


def child_keys(nodes: DataFrame) -> DataFrame:
    """Key of every element below its parent: ``tag.class.class#id``.

    A key already taken by an earlier sibling gets the child index appended.  The
    window never spans more than the children of one element.
    """
    classes = F.when(F.col("class") != "", F.concat(F.lit("."), F.regexp_replace("class", r"\s+", ".")))
    ident = F.when(F.col("id") != "", F.concat(F.lit("#"), F.col("id")))
    key = F.concat("tag", F.coalesce(classes, F.lit("")), F.coalesce(ident, F.lit("")))
    earlier = F.row_number().over(W.partitionBy("page_id", "parent_id", "key").orderBy("child_index")) > 1
    return (
        nodes.where(F.col("parent_id").isNotNull())
        .select("page_id", "node_id", "parent_id", "child_index", key.alias("key"), "own_text", "attrs")
        .withColumn("child_key", F.when(earlier, F.concat_ws("_", "key", "child_index")).otherwise(F.col("key")))
        .drop("key")
    )


_KEY = (
    "concat(n.tag, if(n.class <> '', concat('.', regexp_replace(n.class, '\\\\s+', '.')), ''), if(n.id <> '', concat('#', n.id), ''))"
)
# keys of all elements in document order; siblings with one key are neighbours once sorted, and all but the first get their index
_CHILD_KEYS = (
    "transform(sort_array(transform(siblings, (m, i) -> named_struct('at', m.at, 'key', "
    "if(i > 0 AND get(siblings, i - 1).parent <=> m.parent AND get(siblings, i - 1).key = m.key, concat_ws('_', m.key, m.index), m.key)))), k -> k.key)"
)


def _quoted(text: str) -> str:
    """SQL for a string in JSON."""
    return f"regexp_replace(to_json(array({text})), '^.|.$', '')"


def child_trees(dom: DataFrame, root: Selector, html: bool = False, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keys``, item_id and tree: every element that matches ``root`` with all that is below it, as one nested JSON value.

    An element is ``{"attributes", "text", "html", "children"}`` without empty parts; text is its own,
    children are named like `child_keys`.  The value is put together in the page row: every element gives an
    opening and a closing piece, which are sorted by place, so neither depth nor the number of siblings matters.
    ``html`` adds inner HTML, which repeats the source once a level.  ``parse_json`` makes the value a variant.
    """
    keyed = dom.withColumn(
        "siblings", F.expr(f"sort_array(transform(nodes, n -> named_struct('parent', n.parent_id, 'key', {_KEY}, 'index', n.child_index, 'at', n.node_id)))")
    ).withColumn("child_keys", F.expr(_CHILD_KEYS))
    inner = "if(n.html_end > n.html_start, concat('\"html\":', " + _quoted(
        "cast(substring(cast(html AS BINARY), n.html_start + 1, n.html_end - n.html_start) AS STRING)") + "), NULL)"
    parts = [
        "if(size(n.attrs) > 0, concat('\"attributes\":', to_json(n.attrs)), NULL)",
        f"if(n.own_text <> '', concat('\"text\":', {_quoted('n.own_text')}), NULL)", *([inner] if html else []),
        "if(n.n_children > 0, '\"children\":{', NULL)",
    ]
    named = f"if(n.node_id = r.node_id, '', concat(if(n.child_index > 0, ',', ''), {_quoted('get(child_keys, n.node_id)')}, ':'))"
    opening = f"concat({named}, '{{', array_join(array_compact(array({', '.join(parts)})), ','))"
    pieces = (
        f"array(named_struct('at', n.node_id, 'kind', 0, 'depth', 0, 'text', {opening}), "
        "named_struct('at', n.last_id, 'kind', 1, 'depth', -n.depth, 'text', if(n.n_children > 0, '}}', '}')))"
    )
    below = "slice(nodes, r.node_id + 1, r.last_id - r.node_id + 1)"
    tree = f"array_join(transform(sort_array(flatten(transform({below}, n -> {pieces}))), p -> p.text), '')"
    found = F.expr(f"transform({root.hits()}, r -> named_struct('item_id', r.node_id, 'tree', {tree}))")
    return unnest(keyed, found, *keys)


def matched_texts(dom: DataFrame, selector: Selector, keys=("page_id",)) -> DataFrame:
    """Texts of all matches of a page in document order, blank ones dropped."""
    texts = F.expr(f"transform({selector.hits()}, n -> {text_sql('n', raw=True)})")
    return dom.select(*keys, F.filter(texts, lambda t: trim(t) != "").alias("texts"))


def matched_attributes(dom: DataFrame, selector: Selector, attribute: str, keys=("page_id",)) -> DataFrame:
    """One attribute of all matches of a page in document order, missing ones dropped."""
    values = F.expr(f"transform({selector.hits()}, n -> try_element_at(n.attrs, {literal(attribute)}))")
    return dom.select(*keys, F.array_compact(values).alias("values"))


def match_count(selector: Selector) -> Column:
    """Matches on a page."""
    return F.expr(f"size({selector.hits()})")


def matches(dom: DataFrame, selector: Selector, *keep: str) -> DataFrame:
    """Element rows that match a selector; steps and lists are resolved inside the row."""
    return unnest(dom, F.expr(selector.hits()), *(keep or ("page_id",)))
