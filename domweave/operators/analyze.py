"""Structure analysis of pages.

``page_features`` needs one page at a time and stays inside the row: no shuffle.
``page_marks`` unnests only elements that carry a class, match a listed selector or
sit in a table, list or form; the groupings over it aggregate on the map side, so
what is shuffled is about one row per page and group.  ``analyze_pages`` does all of
it from a single parse: page features ride along on one mark per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.functions.selectors import css, literal
from domweave.operators.dom import above_sql, text_head_sql, text_sql, unnest
from domweave.plans import rules as R


def with_names(dom: DataFrame) -> DataFrame:
    """Adds all tags of a page, and one text of all its classes and ids: its elements are walked only for what can occur."""
    if "page_names" in dom.columns:
        return dom
    return dom.withColumns({
        "page_tags": F.expr("array_distinct(transform(nodes, n -> n.tag))"), "page_names": F.concat_ws("\n", "nodes.class", "nodes.id"),
    })


#: An empty array of the same type; from a place behind the end, as a slice within copies all elements first.
NO_NODES = "slice(nodes, size(nodes) + 1, 0)"


def _any(selector: str) -> str:
    wanted = css(selector)
    return f"({wanted.possible('page_tags', 'page_names')} AND exists(nodes, n -> {wanted.sql('n')}))"


def _hits(selector: str) -> str:
    """SQL for the matching elements of a page; its elements are walked only if its tags and names allow a match."""
    wanted = css(selector)
    return f"filter(if({wanted.possible('page_tags', 'page_names')}, nodes, {NO_NODES}), n -> {wanted.sql('n')})"


def short_selector_sql(node: str = "") -> str:
    """``tag#id``, else ``tag.firstClass``, else ``tag``."""
    at = f"{node}." if node else ""
    return (
        f"CASE WHEN {at}id <> '' THEN concat({at}tag, '#', {at}id) "
        f"WHEN {at}class <> '' THEN concat({at}tag, '.', substring_index({at}class, ' ', 1)) ELSE {at}tag END"
    )


# ---- page features ---------------------------------------------------------------


def _meta(name: str) -> str:
    """Content of the first meta element of that name."""
    first = _hits(f'meta[name="{name}"]')
    return f"coalesce(try_element_at(get({first}, 0).attrs, 'content'), '')"


def page_texts() -> dict[str, str]:
    """Title (all title elements together), description and keywords of a page."""
    return {
        "title": f"array_join(transform({_hits('title')}, n -> {text_sql('n', raw=True)}), '')",
        "description": _meta("description"),
        "keywords": _meta("keywords"),
    }


def type_score(page_type: str) -> str:
    """Score of one page type from the lower-cased texts, names and elements of a page."""
    weights = {"title": R.TITLE_WEIGHT, "description": R.DESCRIPTION_WEIGHT, "keywords": R.KEYWORDS_WEIGHT}
    found = []
    for word in map(literal, R.PAGE_TYPE_WORDS[page_type]):
        found += [f"if(contains({text}_lower, {word}), {weight}, 0)" for text, weight in weights.items()]
        found.append(
            f"if(contains(page_names, {word}), {R.ELEMENT_WEIGHT} * size(filter(named, n -> contains(n.class, {word}) OR contains(n.id, {word}))), 0)"
        )
    if page_type in R.TYPE_BONUS_SELECTORS:
        found.append(f"if({_any(R.TYPE_BONUS_SELECTORS[page_type])}, {R.TYPE_BONUS}, 0)")
    return " + ".join(found)


def main_content() -> str:
    """First of the known content selectors that matches, else the div with most text."""

    def area(selector, inferred):
        return (
            f"named_struct('selector', {selector}, 'tag_name', upper(n.tag), 'classes', n.class, 'id', n.id, "
            f"'children_count', n.n_children, 'is_inferred', {inferred})"
        )

    known = [
        f"get(transform(slice({_hits(s)}, 1, 1), n -> {area(literal(s), 'false')}), 0)" for s in R.MAIN_CONTENT
    ]
    divs = f"filter(if(array_contains(page_tags, 'div'), nodes, {NO_NODES}), n -> n.tag = 'div' AND n.text_length > 0)"
    longest = (
        f"array_max(transform({divs}, n -> named_struct('size', n.text_length, 'order', -n.node_id, "
        f"'area', {area(short_selector_sql('n'), 'true')}))).area"
    )
    return f"coalesce({', '.join(known)}, {longest})"


def page_type() -> str:
    """Type with the highest score, the later one on a tie; general unless above 5."""
    scores = ", ".join(
        f"named_struct('score', score_{t}, 'order', {i}, 'name', '{t}')" for i, t in enumerate(R.PAGE_TYPE_WORDS)
    )
    best = f"array_max(array({scores}))"
    return f"if({best}.score > {R.TYPE_THRESHOLD}, {best}.name, '{R.GENERAL}')"


def page_features(dom: DataFrame, *keep: str) -> DataFrame:
    """Per page: texts, the five type scores, type, flags, main content, media counts."""
    keep = keep or ("page_id",)
    named = (
        "transform(filter(nodes, n -> n.class IS NOT NULL OR n.id IS NOT NULL), "
        "n -> named_struct('class', coalesce(n.class, ''), 'id', coalesce(n.id, '')))"
    )
    facts = {name: _any(selector) for name, selector in R.STRUCTURE_FLAGS.items()}
    facts |= {name: f"size({_hits(selector)})" for name, selector in R.MEDIA.items()}
    facts["main_content"] = main_content()
    kept = [f"`{k}`" for k in keep]
    texts = with_names(dom).selectExpr(
        *kept, *[c for c in ("nodes", "page_tags", "page_names") if c not in keep], f"{named} AS named",
        *[f"{e} AS {n}" for n, e in {**page_texts(), **facts}.items()],
    )
    lowered = texts.selectExpr("*", *[f"lower({text}) AS {text}_lower" for text in page_texts()])
    scored = lowered.selectExpr(
        *kept, "title", "description", "keywords",
        *[f"CAST({type_score(t)} AS bigint) AS score_{t}" for t in R.PAGE_TYPE_WORDS], *facts,
    )
    return scored.selectExpr("*", f"{page_type()} AS page_type")


# ---- marks -----------------------------------------------------------------------

#: What a table, list or form holds: rows, the cells of the first one, items, inputs.
BOX = "struct<selector:string,attrs:map<string,string>,rows:bigint,first_row:int,columns:bigint,list_items:bigint,inputs:bigint>"


def _mark(kind: str, key: str = "NULL", outer: str = "NULL", box: str = "NULL") -> str:
    """What element ``n`` counts towards; tables, lists and forms bring their own facts."""
    return (
        f"named_struct('kind', '{kind}', 'key', CAST({key} AS string), 'outer', CAST({outer} AS int), 'node_id', n.node_id, "
        f"'n_children', n.n_children, 'trim_start', n.trim_start, 'trim_end', n.trim_end, 'box', CAST({box} AS {BOX}))"
    )


def _marks(selector: str, marks: str) -> str:
    """``marks`` of every element that matches."""
    return f"transform({_hits(selector)}, n -> {marks})"


def group_marks() -> str:
    key = "concat(upper(n.tag), '.', substring_index(n.class, ' ', 1))"
    return f"transform(filter(nodes, n -> n.class <> ''), n -> {_mark('group', key)})"


def suggested_selectors() -> list[str]:
    """Every selector the suggestions and card patterns look at, once."""
    listed = [s for groups in R.SUGGESTIONS.values() for chosen in groups.values() for s in chosen]
    return list(dict.fromkeys(listed + R.CARD_SELECTORS))


def selector_marks(selectors: list[str]) -> str:
    return f"concat({', '.join(_marks(s, _mark('selector', literal(s))) for s in selectors)})"


def _inside(node: str, selector: str) -> str:
    """SQL for the ids of the elements inside a node that match; they stand in a row behind it, so nothing else is walked."""
    inside = f"sequence({node}.node_id + 1, {node}.last_id)"
    return f"filter(if({node}.last_id > {node}.node_id, {inside}, cast(array() AS array<int>)), i -> {css(selector).sql('get(nodes, i)')})"


def container_marks() -> str:
    """Tables, lists and forms with what stands anywhere inside them, also in containers of their own kind."""

    def box(kind, selector, members, **facts):
        zero = {"rows": "0", "first_row": "NULL", "columns": "0", "list_items": "0", "inputs": "0"}
        own = ", ".join(f"'{name}', {fact}" for name, fact in (zero | facts).items())
        mark = _mark(kind, outer="n.node_id", box=f"named_struct('selector', {short_selector_sql('n')}, 'attrs', n.attrs, {own})")
        return _marks(selector, f"get(transform(array({_inside('n', members)}), found -> {mark}), 0)")

    cells = f"if(size(found) > 0, size({_inside('get(nodes, found[0])', 'td, th')}), 0)"
    parts = [
        box("table", "table", "tr", rows="size(found)", first_row="get(found, 0)", columns=cells),
        box("list", "ul, ol", "li", list_items="size(found)"),
        box("form", "form", "input, select, textarea", inputs="size(found)"),
    ]
    return f"concat({', '.join(parts)})"


def _mark_rows(dom: DataFrame, marks: str, *keep: str) -> DataFrame:
    """Marks with the first characters of their element's text.

    The marks of a page are made inside its row, selector by selector, and then unnested.  The page text is cut in
    the stage that unnests, and does not go any further: otherwise every mark would carry a copy of it into the aggregation.
    """
    made = with_names(dom).select(*keep, "doc_text", F.expr(marks).alias("marks"))
    head = F.expr(f"if(kind IN ('group', 'selector'), {text_head_sql(R.GROUP_SAMPLE_LENGTH)}, NULL)")
    columns = [*keep, "kind", "key", "outer", "node_id", "n_children", "box"]
    return unnest(made, F.col("marks"), *keep, "doc_text").select(*columns, head.alias("head"))


def page_marks(dom: DataFrame, marks: str, *keep: str) -> DataFrame:
    """Rows (page, kind, key, outer, box) saying what an element counts towards."""
    return _mark_rows(dom, marks, *(keep or ("page_id",)))


def _first_texts() -> Column:
    """First three texts of a group in document order with their positions."""
    listed = "collect_list(if(head IS NULL, NULL, named_struct('node_id', node_id, 'text', head)))"
    return F.expr(f"slice(sort_array({listed}), 1, {R.SAMPLE_COUNT})")


def _texts(samples: str, length: int) -> str:
    return f"transform({samples}, s -> substring(s.text, 1, {length}))"


def repeating_groups(dom: DataFrame) -> DataFrame:
    """Elements of a page with the same tag and first class, three or more of them."""
    return (
        page_marks(dom, group_marks())
        .groupBy("page_id", F.col("key").alias("selector"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("n_children").alias("avg_children"),
            _first_texts().alias("samples"),
        )
        .where(F.col("count") >= R.REPEATING_MINIMUM)
        .withColumn("samples", F.expr(_texts("samples", R.GROUP_SAMPLE_LENGTH)))
    )


def selector_matches(dom: DataFrame, selectors: list[str]) -> DataFrame:
    """Match count and samples of listed selectors per page."""
    return (
        page_marks(dom, selector_marks(selectors))
        .groupBy("page_id", F.col("key").alias("selector"))
        .agg(F.count(F.lit(1)).alias("count"), _first_texts().alias("samples"))
        .withColumn("samples", F.expr(_texts("samples", R.SELECTOR_SAMPLE_LENGTH)))
    )


def best_of(listed: list[str]) -> str:
    """Most matches below the limit in ``found``; the earlier selector wins a tie."""
    names = ", ".join(map(literal, listed))
    usable = f"filter(found, s -> s.selector IN ({names}) AND s.count < {R.BEST_SELECTOR_BELOW})"
    ranked = (
        f"transform({usable}, s -> named_struct('count', s.count, 'order', -array_position(array({names}), s.selector), "
        "'selector', s.selector, 'samples', s.samples))"
    )
    shape = "named_struct('selector', b.selector, 'count', b.count, 'samples', b.samples)"
    return f"get(transform(array_compact(array(array_max({ranked}))), b -> {shape}), 0)"


def best_selectors(dom: DataFrame) -> DataFrame:
    """Best selector of every suggestion of every page type, where any matches."""
    stats = (
        selector_matches(dom, suggested_selectors())
        .groupBy("page_id")
        .agg(F.collect_list(F.struct("selector", "count", "samples")).alias("found"))
    )
    options = ", ".join(
        f"named_struct('page_type', '{t}', 'suggestion', '{g}', 'best', {best_of(listed)})"
        for t, groups in R.SUGGESTIONS.items()
        for g, listed in groups.items()
    )
    return (
        stats.select("page_id", F.expr(f"inline(array({options}))"))
        .where(F.col("best").isNotNull())
        .select("page_id", "page_type", "suggestion", "best.*")
    )


def _boxes() -> Column:
    """The containers of a group: one, unless rows of pages share an id.

    They are collected rather than reduced with max or first: string and map buffers would force a sort of all marks.
    """
    return F.collect_list(F.when(F.col("box").isNotNull(), F.struct(F.col("kind").alias("box"), "box.*"))).alias("boxes")


def _with_box(counted: DataFrame) -> DataFrame:
    """Facts of the container: rows of a table, cells of its first row, members."""
    def total(fact: str, boxes: str = "boxes") -> Column:
        return F.expr(f"aggregate({boxes}, 0L, (sum, b) -> sum + b.{fact})")

    own = F.get("boxes", F.lit(0))
    first = "filter(boxes, b -> b.first_row = array_min(boxes.first_row))"
    return counted.withColumns(
        {n: own[n] for n in ("box", "selector", "attrs")} | {n: total(n) for n in ("rows", "list_items", "inputs")} | {"columns": total("columns", first)}
    ).drop("boxes")


def container_counts(dom: DataFrame) -> DataFrame:
    """Tables, lists and forms: one row each with its selector and member counts."""
    return _with_box(page_marks(dom, container_marks()).groupBy("page_id", F.col("outer").alias("node_id")).agg(_boxes()))


def _attr(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.try_element_at("attrs", F.lit(name)), F.lit("")), F.lit(default)).alias(name)


def forms(dom: DataFrame) -> DataFrame:
    """Forms with method, action and number of inputs."""
    found = container_counts(dom).where(F.col("box") == "form")
    return found.select("page_id", "selector", _attr("method", "GET"), _attr("action", ""), "inputs")


def tables(dom: DataFrame) -> DataFrame:
    """Tables with their rows and the columns of their first row."""
    return container_counts(dom).where(F.col("box") == "table").select("page_id", "selector", "rows", "columns")


def data_patterns(dom: DataFrame) -> DataFrame:
    """Tables, cards and lists that hold data, one row each, from one pass over the elements."""
    marks = f"concat({container_marks()}, {selector_marks(R.CARD_SELECTORS)})"
    boxes = _with_box(page_marks(dom, marks).groupBy("page_id", "key", "outer").agg(F.count(F.lit(1)).alias("count"), _boxes()))
    kind = F.when(F.col("key").isNotNull(), "cards").otherwise(F.col("box"))
    size = F.expr("CASE WHEN key IS NOT NULL THEN count WHEN box = 'table' THEN rows ELSE list_items END")
    place = F.array_position(F.array(*[F.lit(s) for s in R.CARD_SELECTORS]), F.col("key")).cast("int")
    found = boxes.select(
        "page_id", kind.alias("type"), F.coalesce("key", "selector").alias("selector"), size.alias("size"),
        F.coalesce(place, "outer").alias("order"),
    )
    limit, confidence_ = F, F
    for name, (more_than, value) in R.PATTERNS.items():
        limit = limit.when(F.col("type") == name, more_than)
        confidence_ = confidence_.when(F.col("type") == name, value)
    return found.where(F.col("size") > limit).withColumn("confidence", confidence_)


def element_categories(dom: DataFrame) -> DataFrame:
    """How many elements of a page fall in each element category."""
    kinds = ", ".join(
        f"if({css(', '.join(listed)).sql('n')}, '{name}', NULL)" for name, listed in R.ELEMENT_CATEGORIES.items()
    )
    tagged = F.expr(f"flatten(transform(nodes, n -> array_compact(array({kinds}))))")
    return (
        dom.select("page_id", F.explode_outer(tagged).alias("category"))
        .where(F.col("category").isNotNull())
        .groupBy("page_id", "category")
        .agg(F.count(F.lit(1)).alias("elements"))
    )


# ---- whole analysis ----------------------------------------------------------------


def confidence(has_type: Column, has_main: Column, has_groups: Column, patterns: Column) -> Column:
    total = (
        F.lit(R.BASE_CONFIDENCE)
        + F.when(has_type, R.TYPE_CONFIDENCE).otherwise(0.0)
        + F.when(has_main, R.MAIN_CONFIDENCE).otherwise(0.0)
        + F.when(has_groups, R.REPEATING_CONFIDENCE).otherwise(0.0)
        + F.least(patterns * R.PATTERN_CONFIDENCE, F.lit(R.PATTERN_CONFIDENCE_LIMIT))
    )
    return F.least(total, F.lit(1.0))


def confidence_bucket(value: Column) -> Column:
    chain = F
    for limit, name in R.CONFIDENCE_BUCKETS:
        chain = chain.when(value >= limit, name)
    return chain.otherwise("low")


def recommendations(value: Column, patterns: Column, has_groups: Column, page_type: Column) -> Column:
    """Codes of the advice that applies, in order."""
    return F.filter(
        F.array(
            F.when(value < R.LOW_CONFIDENCE, F.lit("low_confidence")),
            F.when(patterns > 0, F.lit("patterns_found")),
            F.when(has_groups, F.lit("repeating_elements")),
            F.when(page_type == "ecommerce", F.lit("ecommerce_fields")),
        ),
        lambda c: c.isNotNull(),
    )


def analyze_pages(dom: DataFrame, reference_order: bool = False) -> DataFrame:
    """One row per page with everything the analysis finds.

    ``reference_order=True`` gives the advice as if confidence were still zero when
    it is written, so that low confidence is always among it.
    """
    wanted = ("page_id", "doc_text", "nodes", "page_tags", "page_names")
    page = page_features(with_names(dom), *wanted)
    names = [c for c in page.columns if c not in wanted]
    page = page.select(*wanted, F.struct(*names).alias("features"))

    # the features of a page ride on the mark of its root element
    root = f"transform(filter(slice(nodes, 1, 1), n -> n.node_id = 0), n -> {_mark('page')})"
    marks = f"concat({root}, {group_marks()}, {selector_marks(suggested_selectors())}, {container_marks()})"
    rows = _mark_rows(page, marks, "page_id", "features").withColumn("features", F.expr("if(kind = 'page', features, NULL)"))

    family = F.expr("if(kind IN ('group', 'selector', 'page'), kind, 'container')")
    counted = _with_box(rows.groupBy("page_id", family.alias("family"), "key", "outer").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.expr("if(kind = 'group', n_children, NULL)")).alias("avg_children"),
        _first_texts().alias("samples"),
        F.first("features", True).alias("features"),
        _boxes(),
    ))

    def listed(condition: str, *fields: str) -> str:
        shape = ", ".join(fields)
        return f"sort_array(collect_list(if({condition}, named_struct({shape}), NULL)))"

    group_texts, selector_texts = (_texts("samples", n) for n in (R.GROUP_SAMPLE_LENGTH, R.SELECTOR_SAMPLE_LENGTH))
    box = "'node_id', outer, 'selector', selector"
    method, action = (
        f"'{n}', coalesce(nullif(try_element_at(attrs, '{n}'), ''), '{default}')"
        for n, default in (("method", "GET"), ("action", ""))
    )
    collected = counted.groupBy("page_id").agg(
        F.first("features", True).alias("features"),
        F.expr(listed(
            f"family = 'group' AND count >= {R.REPEATING_MINIMUM}",
            f"'selector', key, 'count', count, 'avg_children', avg_children, 'samples', {group_texts}",
        )).alias("repeating_elements"),
        F.expr(listed("family = 'selector'", f"'selector', key, 'count', count, 'samples', {selector_texts}")).alias("found"),
        F.expr(listed("box = 'table'", box, "'rows', rows, 'columns', columns")).alias("tables"),
        F.expr(listed("box = 'list'", box, "'list_items', list_items")).alias("lists"),
        F.expr(listed("box = 'form'", box, method, action, "'inputs', inputs")).alias("forms"),
    )

    def pattern(kind: str, selector: str, size: str) -> str:
        return (
            f"named_struct('type', '{kind}', 'selector', {selector}, 'size', CAST({size} AS bigint), "
            f"'confidence', {R.PATTERNS[kind][1]}D)"
        )

    def members(selector: str) -> str:
        return f"coalesce(get(filter(found, s -> s.selector = {literal(selector)}), 0).count, 0)"

    cards = ", ".join(pattern("cards", literal(s), members(s)) for s in R.CARD_SELECTORS)
    patterns = (
        f"concat(transform(filter(tables, t -> t.rows > {R.PATTERNS['table'][0]}), t -> {pattern('table', 't.selector', 't.rows')}), "
        f"filter(array({cards}), p -> p.size > {R.PATTERNS['cards'][0]}), "
        f"transform(filter(lists, t -> t.list_items > {R.PATTERNS['list'][0]}), t -> {pattern('list', 't.selector', 't.list_items')}))"
    )

    def suggestion(name: str) -> str:
        cases = [
            f"WHEN features.page_type = '{t}' THEN {best_of(groups[name]) if name in groups else 'NULL'}"
            for t, groups in R.SUGGESTIONS.items()
            if t != "default"
        ]
        rest = best_of(R.SUGGESTIONS["default"][name]) if name in R.SUGGESTIONS["default"] else "NULL"
        return f"'{name}', CASE {' '.join(cases)} ELSE {rest} END"

    names = dict.fromkeys(g for groups in R.SUGGESTIONS.values() for g in groups)
    out = collected.selectExpr(
        "page_id", "features.*", "repeating_elements", "tables", "forms", f"{patterns} AS data_patterns",
        f"named_struct({', '.join(suggestion(n) for n in names)}) AS suggested_selectors",
    )
    patterns_found = F.size("data_patterns")
    has_groups = F.size("repeating_elements") > 0
    scored = out.withColumn(
        "confidence",
        confidence(F.col("page_type") != R.GENERAL, F.col("main_content").isNotNull(), has_groups, patterns_found),
    )
    basis = F.lit(0.0) if reference_order else F.col("confidence")
    return scored.withColumn("recommendations", recommendations(basis, patterns_found, has_groups, F.col("page_type")))


def adapted_selector(analysis: DataFrame) -> DataFrame:
    """Item selector, strategy and where they come from, per analysed page."""
    selectors = F.col("suggested_selectors")
    strategy = F
    for page_type_name, name in R.APPLY_STRATEGY.items():
        strategy = strategy.when(F.col("page_type") == page_type_name, name)
    return analysis.select(
        "page_id",
        "page_type",
        F.coalesce(selectors["products"]["selector"], selectors["articles"]["selector"]).alias("adapted_selector"),
        F.coalesce(*[selectors[n]["selector"] for n in R.APPLY_ORDER]).alias("applied_selector"),
        strategy.otherwise("").alias("applied_strategy"),
        confidence_bucket(F.col("confidence")).alias("confidence_bucket"),
    )


def suggested_item_selector() -> Column:
    """Product selector, else article selector that suits a page's type best; null where nothing matches.

    Found inside the page row, without the rest of the analysis.
    """
    def best(listed):
        counts = ", ".join(
            f"named_struct('count', size(filter(nodes, n -> {css(s).sql('n')})), 'order', {-i}, 'selector', {literal(s)})" for i, s in enumerate(listed))
        return f"array_max(filter(array({counts}), s -> s.count > 0 AND s.count < {R.BEST_SELECTOR_BELOW})).selector"

    cases = " ".join(
        f"WHEN {literal(kind)} THEN {best(groups[name])}" for name in ("products", "articles") for kind, groups in R.SUGGESTIONS.items() if name in groups)
    return F.expr(f"CASE page_type {cases} END")


def adapt_jobs(pages_of_jobs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Item selector of each job: only its first page decides.

    ``pages_of_jobs`` has job_id, page_no, page_id and item_selector.
    """
    first = pages_of_jobs.groupBy("job_id").agg(
        F.min_by(F.struct("page_id", "item_selector"), "page_no").alias("first")
    ).select("job_id", "first.*")
    found = adapted_selector(analysis).select("page_id", "adapted_selector")
    return first.join(found, "page_id", "left").select(
        "job_id", F.coalesce("adapted_selector", "item_selector").alias("item_selector")
    )

