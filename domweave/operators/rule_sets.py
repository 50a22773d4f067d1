"""Selectors as data: rule sets of jobs, evaluated on pages by an index.

``Selector`` writes a selector into the plan, which suits one set of rules for all
pages.  Here rules are rows: every job brings its own item selector, fields and
next-page marker, jobs with equal rules share a set, and one plan serves any number of
sets.  A selector becomes an array of alternatives, each an array of steps.  Every
alternative is filed under one key of its last step (id, class token, attribute, tag, or
``*``), so an element is only tested against alternatives whose key it has; outer
steps are then followed up the parents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.functions.selectors import css, css_to_xpath, normalize_selectors, xpath
from domweave.functions.text import trim
from domweave.operators.dom import inner_html, text_of
from domweave.session import written

STEP = "struct<tag:string,tests:array<struct<name:string,op:string,value:string>>,nth:int,child:boolean>"
ALTERNATIVES = f"array<struct<key:string,steps:array<{STEP}>>>"
FIELD = "struct<name:string,kind:string,attribute:string,selector:string,fallback:string,within:string,keep_empty:boolean,multiple:boolean>"
#: Roles of a rule within its set; a field has three: its selector, its fallback, what encloses it.
ITEM, LINK, IMAGE, NEXT, FIRST_FIELD = 0, 1, 2, 3, 10
#: The group of a page that holds its marker instead of an item.
MARK = -1


# ---- selector strings to steps ---------------------------------------------------------


def _key(step) -> str:
    kinds = {(name, op): value for name, op, value in step.tests}
    if ("id", "=") in kinds:
        return f"i:{kinds['id', '=']}"
    if ("class", "token") in kinds:
        return f"c:{kinds['class', 'token']}"
    if step.tests:
        return f"a:{step.tests[0][0]}"
    return f"t:{step.tag}" if step.tag else "*"


def _alternatives(text: str | None, expression: bool):
    if text is None:
        return None
    try:
        parsed = xpath(text) if expression else css(text)
    except ValueError:
        return None
    return [
        {"key": _key(chain[-1]), "steps": [
            {"tag": s.tag, "tests": [{"name": n, "op": o, "value": v} for n, o, v in s.tests], "nth": s.nth, "child": s.child} for s in chain]}
        for chain in parsed.chains
    ]


_STEP_TYPE = pa.struct([
    ("tag", pa.string()), ("tests", pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())]))),
    ("nth", pa.int32()), ("child", pa.bool_())])
_ALTERNATIVES_TYPE = pa.list_(pa.struct([("key", pa.string()), ("steps", pa.list_(_STEP_TYPE))]))


def alternatives_of(selector: Column, expression: Column) -> Column:
    """Alternatives of a selector string, or of an expression; null if it cannot be read."""

    def read(texts: pa.Array, expressions: pa.Array) -> pa.Array:
        return pa.array([_alternatives(t, e) for t, e in zip(texts.to_pylist(), expressions.to_pylist())], _ALTERNATIVES_TYPE)

    return F.arrow_udf(read, ALTERNATIVES)(selector, expression)


# ---- rules of a job ----------------------------------------------------------------------


def _text(column: Column | None) -> Column:
    return F.nullif(column, F.lit("")) if column is not None else F.lit(None).cast("string")


def _field(name, selector, kind="text", attribute=None, fallback=None, within=None, keep_empty=False, multiple=True) -> Column:
    def of(value):
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        of(name).alias("name"), of(kind).alias("kind"), of(attribute).cast("string").alias("attribute"), of(selector).alias("selector"),
        of(fallback).cast("string").alias("fallback"), of(within).cast("string").alias("within"), of(keep_empty).alias("keep_empty"),
        of(multiple).alias("multiple")).cast(FIELD)


def _static_field(t: Column) -> Column:
    """Every match counts, empty texts too; the name falls back to tag and selector."""
    return _field(F.coalesce(_text(t["name"]), _text(t["tag"]), t["selector"]), F.coalesce(_text(t["selector"]), t["tag"]), keep_empty=True)


def _scoped_field(t: Column) -> Column:
    """The tag below the selector; empty values are dropped."""
    return _field(t["tag"], t["tag"], F.when(_text(t["attribute"]).isNotNull(), "attribute").otherwise("text"), t["attribute"], within=_text(t["selector"]))


def _expression_tag_field(t: Column) -> Column:
    """The same in expressions: a text with anything in it counts, and is trimmed afterwards."""
    return _field(
        t["tag"], F.concat(F.lit("//"), t["tag"]), F.when(_text(t["attribute"]).isNotNull(), "attribute").otherwise("any_text"), t["attribute"],
        within=css_to_xpath(_text(t["selector"])), keep_empty=True)


def _expression_field(x: Column) -> Column:
    kind = F.when((x["type"] == "attribute") & x["attribute"].isNotNull(), "attribute").when(x["type"] == "html", "html").otherwise("raw_text")
    return _field(x["name"], x["xpath"], kind, x["attribute"], x["fallback"], multiple=x["multiple"])


def job_rules(strategy: str = "strategy") -> list[Column]:
    """Columns ``item``, ``fields``, ``next``, ``next_kind``, ``parts`` and ``expressions`` of jobs (with defaults) for the extractor in a column.

    Static rules are found in the whole item and keep empty texts; the browser extractors search a tag below a
    selector; the expression extractor turns selectors into expressions and has its own fields with fallbacks.
    Markers: any match; no disabled match (buttons); some usable match (buttons of the smart extractor).
    """
    name, p, tags = F.col(strategy), F.col("pagination"), F.col("tag_selectors")
    by_expression, static, smart = name == "xpath", name == "cheerio", name == "smart-puppeteer"
    item = F.when(by_expression & ~F.startswith("item_selector", F.lit("/")), css_to_xpath(F.col("item_selector"))).otherwise(F.col("item_selector"))
    tagged = F.filter(tags, lambda t: _text(t["tag"]).isNotNull())
    fields = (
        F.when(static, F.transform(F.filter(tags, lambda t: F.coalesce(_text(t["selector"]), _text(t["tag"])).isNotNull()), _static_field))
        .when(by_expression, F.concat(
            F.transform(F.filter(normalize_selectors(F.col("xpath_selectors")), lambda x: x["xpath"].isNotNull()), _expression_field),
            F.transform(tagged, _expression_tag_field)))
        .otherwise(F.transform(tagged, _scoped_field))
    )
    next_page, paging = _text(p["next_page_selector"]), F.col("pagination_type")
    wanted = (
        F.when(by_expression, F.coalesce(_text(p["next_page_xpath"]), css_to_xpath(next_page)))
        .when(smart, next_page)
        .when(next_page.isNotNull() & paging.isin("query", "path"), next_page)
        .when(next_page.isNotNull() & (paging == "button"), F.coalesce(_text(p["next_button_selector"]), next_page))
        .when(next_page.isNotNull() & (paging == "infinite"), F.coalesce(_text(p["load_more_selector"]), next_page))
    )
    kind = F.when(by_expression | (paging != "button"), "any").when(smart, "usable").otherwise("enabled")
    parts = (
        F.when(static, F.array(F.lit("text"), F.lit("links"), F.lit("images")))
        .when(by_expression, F.array(F.lit("tag"), F.lit("text"), F.lit("html"), F.lit("attributes")))
        .otherwise(F.array(F.lit("own_text"), F.lit("html"), F.lit("attributes")))
    )
    return [item.alias("item"), fields.alias("fields"), wanted.alias("next"), kind.alias("next_kind"), parts.alias("parts"), by_expression.alias("expressions")]


def rule_sets(jobs: DataFrame, strategy: str = "strategy") -> tuple[DataFrame, DataFrame]:
    """((job_id, set_id), sets): equal rules are one set.

    A set has its ``fields``, ``parts`` and ``next_kind``, the ``alternatives`` of all its
    selectors with the role of each, and ``by_key``, the places of the alternatives under
    each key.  ``readable`` is false if the item selector cannot be read.  Field and marker selectors that cannot be read match
    nothing.  A set is as large as the rules allow a job to be.
    """
    ruled = jobs.select("job_id", *job_rules(strategy))
    content = F.struct("item", "fields", "next", "next_kind", "parts", "expressions")
    ruled = written(ruled.withColumn("set_id", F.sha2(F.to_json(content), 256)), "rules")
    distinct = ruled.drop("job_id").dropDuplicates(["set_id"])

    def rule(role, text):
        return F.struct((role if isinstance(role, Column) else F.lit(role)).cast("int").alias("role"), text.alias("selector"))

    has = lambda part: F.array_contains("parts", F.lit(part))
    own = F.array(
        rule(ITEM, F.col("item")), rule(NEXT, F.col("next")), rule(LINK, F.when(has("links"), F.lit("a[href]"))),
        rule(IMAGE, F.when(has("images"), F.lit("img[src]"))))
    of_fields = F.flatten(F.transform("fields", lambda f, i: F.array(
        rule(FIRST_FIELD + 3 * i, f["selector"]), rule(FIRST_FIELD + 3 * i + 1, f["fallback"]), rule(FIRST_FIELD + 3 * i + 2, f["within"]))))
    rules = distinct.select("set_id", "expressions", F.inline(F.concat(own, of_fields))).where(F.col("selector").isNotNull())
    read = rules.select("set_id", "role", alternatives_of(F.col("selector"), F.col("expressions")).alias("found"))
    per_rule = F.transform("found", lambda a: F.struct(F.col("role").alias("role"), a["key"].alias("key"), a["steps"].alias("steps")))
    compiled = (
        read.groupBy("set_id").agg(
            F.flatten(F.sort_array(F.collect_list(per_rule))).alias("alternatives"),
            F.coalesce(F.max(F.when(F.col("role") == ITEM, F.col("found").isNotNull())), F.lit(False)).alias("readable"))
        .withColumn("places", F.transform("alternatives", lambda a, i: F.struct(a["key"].alias("key"), i.alias("i"))))
        .withColumn("by_key", F.map_from_entries(F.transform(
            F.array_distinct(F.transform("places", lambda e: e["key"])),
            lambda k: F.struct(k.alias("key"), F.transform(F.filter("places", lambda e: e["key"] == k), lambda e: e["i"]).alias("at")))))
        .drop("places")
    )
    return ruled.select("job_id", "set_id"), written(distinct.select("set_id", "fields", "parts", "next_kind").join(compiled, "set_id"), "rule-sets")


# ---- evaluation inside the page row ------------------------------------------------------


def _passes(step: str, node: str) -> str:
    """SQL: an element passes one step that is held as data."""
    attribute = f"CASE t.name WHEN 'id' THEN {node}.id WHEN 'class' THEN {node}.class ELSE try_element_at({node}.attrs, t.name) END"
    test = (
        f"coalesce(CASE t.op WHEN 'token' THEN array_contains({node}.classes, t.value) WHEN 'present' THEN {attribute} IS NOT NULL "
        f"WHEN '=' THEN {attribute} = t.value WHEN '*=' THEN contains({attribute}, t.value) "
        f"WHEN '^=' THEN startswith({attribute}, t.value) WHEN '$=' THEN endswith({attribute}, t.value) END, false)"
    )
    return f"(({step}.tag IS NULL OR {step}.tag = {node}.tag) AND ({step}.nth IS NULL OR {step}.nth = {node}.type_index) AND forall({step}.tests, t -> {test}))"


_NONE = "cast(array() AS array<int>)"
# Steps still wanted, from the last but one outwards, are carried up the parents: one that hangs by a child step is
# wanted of the next parent only, others of any.
_CHAIN = (
    "aggregate(array_repeat(0, if(size(a.steps) = 1, 0, n.depth)), named_struct('at', n.parent_id, 'want', array(size(a.steps) - 2), 'hit', size(a.steps) = 1), "
    "(up, k) -> if(up.hit OR size(up.want) = 0, up, named_struct('at', get(nodes, up.at).parent_id, "
    "'want', array_distinct(flatten(transform(up.want, j -> concat("
    f"if(j > 0 AND {_passes('get(a.steps, j)', 'get(nodes, up.at)')}, array(j - 1), {_NONE}), "
    f"if(get(a.steps, j + 1).child, {_NONE}, array(j)))))), "
    f"'hit', exists(up.want, j -> j = 0 AND {_passes('get(a.steps, 0)', 'get(nodes, up.at)')}))), up -> up.hit)"
)
_KEYS = (
    "concat(array('*', concat('t:', n.tag)), if(n.id IS NULL, array(), array(concat('i:', n.id))), "
    "transform(array_distinct(n.classes), c -> concat('c:', c)), transform(map_keys(n.attrs), m -> concat('a:', m)))"
)
#: Roles of every element of a page, in document order.
ROLES = (
    f"transform(nodes, n -> array_distinct(transform(filter(transform(flatten(transform({_KEYS}, "
    f"k -> coalesce(try_element_at(by_key, k), {_NONE}))), i -> get(alternatives, i)), "
    f"a -> {_passes('element_at(a.steps, -1)', 'n')} AND {_CHAIN}), a -> a.role)))"
)
_MARKED = "exists(sequence(0, size(nodes) - 1), i -> array_contains(get(roles, i), {role}) AND {test})"
_DISABLED = "array_contains(get(nodes, i).classes, 'disabled')"
_USABLE = (
    f"NOT map_contains_key(get(nodes, i).attrs, 'disabled') AND NOT {_DISABLED} "
    r"AND NOT rlike(coalesce(try_element_at(get(nodes, i).attrs, 'style'), ''), r'(?i)(^|;)\s*display:\s*none')"
)
_HAS_NEXT = (
    f"size(nodes) > 0 AND CASE next_kind WHEN 'usable' THEN {_MARKED.format(role=NEXT, test=_USABLE)} ELSE "
    f"{_MARKED.format(role=NEXT, test='true')} AND (next_kind = 'any' OR NOT {_MARKED.format(role=NEXT, test=_DISABLED)}) END"
)
# Items an element lies in, innermost first, each with the roles of the elements in between.
_INSIDE = (
    "aggregate(array_repeat(0, n.depth), named_struct('at', n.parent_id, 'seen', cast(array() AS array<int>), "
    "'items', cast(array() AS array<struct<item_id:int,seen:array<int>>>)), "
    "(up, k) -> named_struct('at', get(nodes, up.at).parent_id, 'seen', array_union(up.seen, get(roles, up.at)), "
    f"'items', if(array_contains(get(roles, up.at), {ITEM}), concat(up.items, array(named_struct('item_id', up.at, 'seen', up.seen))), up.items)), "
    "up -> up.items)"
)
_WANTED = ["node_id", "tag", "attrs", "own_text", "text_start", "text_end", "trim_start", "trim_end", "html_start", "html_end"]


def evaluate(dom: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(page_id, set_id, item_id, …): the items that every wanted set finds on its pages, and a mark of each page.

    ``wanted`` is (page_id, set_id), ``dom`` parsed pages with their source.  Elements are found inside the
    row; only those with a role are unnested and grouped by (page, set, item), a group that
    never exceeds a page.  The row of item `MARK` tells whether the page has a next-page marker.
    An item without any part is dropped.
    """
    rows = dom.join(wanted.distinct(), "page_id").join(sets, "set_id").withColumn("roles", F.expr(ROLES))
    named = ", ".join(f"'{c}', n.{c}" for c in _WANTED)
    first = ", ".join(f"'{c}', {'CAST(NULL AS map<string,string>)' if c == 'attrs' else 'CAST(NULL AS string)' if c in ('tag', 'own_text') else '0'}" for c in _WANTED)
    mark = f"array(named_struct({first}, 'found', array(named_struct('role', {MARK}, 'item_id', {MARK}, 'seen', {_NONE}))))"
    hits = (
        f"transform(filter(nodes, n -> size(get(roles, n.node_id)) > 0), n -> named_struct({named}, 'found', concat("
        f"if(array_contains(get(roles, n.node_id), {ITEM}), array(named_struct('role', {ITEM}, 'item_id', n.node_id, 'seen', {_NONE})), "
        "cast(array() AS array<struct<role:int,item_id:int,seen:array<int>>>)), "
        f"flatten(transform(filter(get(roles, n.node_id), r -> r NOT IN ({ITEM}, {NEXT})), r -> transform({_INSIDE}, "
        "u -> named_struct('role', r, 'item_id', u.item_id, 'seen', u.seen)))))))"
    )
    keys = ["page_id", "set_id"]
    carried = rows.select(
        *keys, "fields", "parts", F.expr(_HAS_NEXT).alias("has_next"), F.col("doc_text").cast("binary").alias("doc_text"),
        F.col("html").cast("binary").alias("html"), F.expr(f"concat({mark}, {hits})").alias("hits"))
    flat = carried.select(*keys, "fields", "parts", "has_next", "doc_text", "html", F.inline_outer("hits"))
    flat = flat.select("*", F.inline_outer("found")).where(F.col("item_id").isNotNull())

    role = F.col("role")
    place, which = F.floor((role - FIRST_FIELD) / 3).cast("int"), (role - FIRST_FIELD) % 3
    field = F.when(role >= FIRST_FIELD, F.get("fields", place))
    inside = field["within"].isNull() | F.array_contains("seen", FIRST_FIELD + 3 * place + 2)
    kind = field["kind"]
    raw = text_of(raw=True)
    value = (
        F.when((role == LINK) | (kind == "text"), text_of())
        .when(kind == "attribute", F.try_element_at("attrs", field["attribute"]))
        .when(kind == "html", inner_html()).when(kind == "raw_text", raw)
        .when((kind == "any_text") & (raw != ""), trim(raw))
    )
    part = lambda name, of: F.when((role == ITEM) & F.array_contains("parts", F.lit(name)), of)
    own = F.struct(
        part("tag", F.col("tag")).alias("tag"), F.coalesce(part("text", text_of()), part("own_text", F.col("own_text"))).alias("text"),
        part("html", inner_html()).alias("html"), part("attributes", F.col("attrs")).alias("attributes"))
    flat = flat.where((role < FIRST_FIELD) | ((which < 2) & F.coalesce(inside, F.lit(False)))).select(
        *keys, "item_id", "node_id", "role", "has_next", value.alias("value"), F.when(role == ITEM, own).alias("own"),
        F.when((role == LINK) | (role == IMAGE), F.map_filter("attrs", lambda k, v: k.isin("href", "src", "alt"))).alias("attrs"))
    held = F.struct("node_id", "role", "value", F.try_element_at("attrs", F.lit("href")).alias("href"),
                    F.try_element_at("attrs", F.lit("src")).alias("src"), F.try_element_at("attrs", F.lit("alt")).alias("alt"))
    grouped = flat.groupBy(*keys, "item_id").agg(
        F.max("has_next").alias("has_next"), F.get(F.collect_list("own"), 0).alias("own"),
        F.sort_array(F.collect_list(F.when(role > ITEM, held))).alias("held"))
    return written(_items(grouped.join(sets.select("set_id", "fields"), "set_id")), "found")


def _items(grouped: DataFrame) -> DataFrame:
    held, own = F.col("held"), F.col("own")

    def of(role):
        return F.filter(held, lambda h: h["role"] == role)

    def filled(values):
        return F.when(F.size(values) > 0, values)

    links = F.transform(F.filter(of(LINK), lambda h: (h["href"] != "") & (h["value"] != "")), lambda h: F.struct(h["href"].alias("href"), h["value"].alias("text")))
    images = F.transform(F.filter(of(IMAGE), lambda h: h["src"] != ""), lambda h: F.struct(h["src"].alias("src"), F.coalesce(h["alt"], F.lit("")).alias("alt")))

    def field_values(f, i):
        mine = of(FIRST_FIELD + 3 * i)
        found = F.when(F.size(mine) > 0, mine).otherwise(of(FIRST_FIELD + 3 * i + 1))
        values = F.transform(F.filter(found, lambda h: h["value"].isNotNull() & (f["keep_empty"] | (h["value"] != ""))), lambda h: h["value"])
        return F.struct(f["name"].alias("name"), F.when(f["multiple"], values).otherwise(F.slice(values, 1, 1)).alias("values"))

    entries = F.filter(F.transform("fields", field_values), lambda e: (F.size(e["values"]) > 0) & e["name"].isNotNull())
    # of equal names the last one with values stays
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"]))
    out = grouped.select(
        "page_id", "set_id", "item_id", "has_next", own["tag"].alias("tag_name"), F.nullif(own["text"], F.lit("")).alias("text"),
        F.nullif(own["html"], F.lit("")).alias("html"), F.when(F.size(own["attributes"]) > 0, own["attributes"]).alias("attributes"),
        filled(links).alias("links"), filled(images).alias("images"), F.when(F.size(last) > 0, F.map_from_entries(last)).alias("fields"))
    anything = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), 1) for c in ("tag_name", "text", "html", "attributes", "links", "images", "fields")]))
    return out.where((F.col("item_id") == MARK) | (F.size(anything) > 0))
