"""Queries on page sources, selectors and items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domweave.functions.selectors import css, xpath
from domweave.operators import extract
from domweave.operators.dom import elements, parse_pages, register_sql, text_of
from domweave.operators.extract import Field, extract_items
from domweave.plans import rendered
from domweave.plans.registry import query, table
from domweave.session import written
from domweave.sources.pages import bytes_processed, read_pages, spread


def parsed(pages, *extra):
    """Only the columns the parser needs, spread over the cores."""
    return parse_pages(spread(pages.select("page_id", *extra, "html")))


def stored(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def _decoded(expression):
    """Entities of the stored pages; the standard also decodes these without a semicolon."""
    for name, character in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        expression = f"regexp_replace({expression}, '&{name};?', '{character}', 'g')"
    return expression


@query(
    "page_links",
    f"""
    WITH l AS (
      SELECT page_id, generate_subscripts(h, 1) AS link_no, unnest(h) AS href, unnest(t) AS text
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h,
                   regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
    )
    SELECT page_id, CAST(link_no AS BIGINT) AS link_no, href, {_decoded('text')} AS text
    FROM l WHERE href <> '' AND trim(text) <> ''
    """,
)
def page_links(spark, sf_dir):
    items = extract_items(parsed(stored(spark, sf_dir)), "body", parts=("links",))
    return items.select("page_id", F.posexplode("links").alias("n", "link")).select(
        "page_id", (F.col("n") + 1).cast("long").alias("link_no"), "link.*"
    )


@query(
    "page_titles",
    f"""
    SELECT page_id, trim({_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title FROM pages
    """,
)
def page_titles(spark, sf_dir):
    found = extract.matched_texts(parsed(stored(spark, sf_dir)), css("head title"))
    return found.select("page_id", F.trim(F.array_join("texts", "")).alias("title"))


_TAGS = "html head meta title style script body nav ul li a div article h1 p b br footer"


@query(
    "tag_counts",
    f"""
    SELECT tag, CAST(sum(len(regexp_extract_all(html, '<' || tag || '[ >]'))) AS BIGINT) AS elements,
           count(*) FILTER (WHERE len(regexp_extract_all(html, '<' || tag || '[ >]')) > 0) AS pages
    FROM pages, unnest(string_split('{_TAGS}', ' ')) AS t(tag) GROUP BY tag
    """,
)
def tag_counts(spark, sf_dir):
    nodes = elements(parsed(stored(spark, sf_dir)))
    per_page = nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("pages"))


_NAV = "regexp_extract(html, '(?s)<nav>.*?</nav>')"


@query(
    "nav_items",
    f"""
    SELECT page_id, CAST(generate_subscripts(t, 1) AS BIGINT) AS item_no, {_decoded('unnest(t)')} AS text
    FROM (SELECT page_id, regexp_extract_all({_NAV}, '<a[^>]*>([^<]*)</a>', 1) AS t FROM pages)
    """,
)
def nav_items(spark, sf_dir):
    texts = extract.matched_texts(parsed(stored(spark, sf_dir)), css("nav ul li a"))
    return texts.select("page_id", F.posexplode("texts").alias("n", "text")).select(
        "page_id", (F.col("n") + 1).cast("long").alias("item_no"), "text"
    )


@query("bytes_processed", "SELECT count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages")
def bytes_total(spark, sf_dir):
    return bytes_processed(read_pages(spark, f"{sf_dir}/pages.parquet"))


@query(
    "page_languages",
    """
    SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, count(*) AS pages
    FROM pages WHERE regexp_matches(html, '<html lang="') GROUP BY 1
    """,
)
def page_languages(spark, sf_dir):
    values = extract.matched_attributes(parsed(stored(spark, sf_dir)), css("html[lang]"), "lang")
    return values.select(F.explode("values").alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "selector_counts",
    f"""
    SELECT page_id,
      CAST(len(regexp_extract_all({_NAV}, '<li>')) AS BIGINT) AS child_items,
      CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS by_class,
      CAST(len(regexp_extract_all(html, '<div class="[^"]*d[^"]*">')) AS BIGINT) AS by_class_part,
      CAST(len(regexp_extract_all(html, '<(meta)[^>]*charset=')) AS BIGINT) AS by_attribute,
      CAST(len(regexp_extract_all(html, '<(nav|footer)>')) AS BIGINT) AS by_list,
      CAST(0 AS BIGINT) AS by_id
    FROM pages
    """,
)
def selector_counts(spark, sf_dir):
    chosen = {
        "child_items": css("nav > ul > li"),
        "by_class": css(".ad"),
        "by_class_part": css('[class*="d"]'),
        "by_attribute": css("meta[charset]"),
        "by_list": css("nav, footer, nav"),
        "by_id": css("#main"),
    }
    dom = parsed(stored(spark, sf_dir))
    return dom.select(
        "page_id",
        *[extract.match_count(s).cast("long").alias(name) for name, s in chosen.items()],
    )


@query(
    "third_nav_item",
    f"""
    SELECT page_id, {_decoded("t[3]")} AS text, CAST(len(t) AS BIGINT) AS siblings
    FROM (SELECT page_id, regexp_extract_all({_NAV}, '<li><a[^>]*>([^<]*)</a>', 1) AS t FROM pages) WHERE len(t) >= 3
    """,
)
def third_nav_item(spark, sf_dir):
    hits = extract.matches(parsed(stored(spark, sf_dir)), css("nav li:nth-of-type(3)"), "page_id", "doc_text")
    return hits.select("page_id", text_of().alias("text"), F.col("type_count").cast("long").alias("siblings"))


@query(
    "child_join",
    f"""
    SELECT page_id, CAST(len(regexp_extract_all({_NAV}, '<li>')) AS BIGINT) AS children
    FROM pages WHERE len(regexp_extract_all({_NAV}, '<li>')) > 0
    """,
)
def child_join(spark, sf_dir):
    """Child step as a join of two element sets on (page, parent), the form for stored element tables."""
    nodes = written(elements(parsed(stored(spark, sf_dir))).select("page_id", "node_id", "parent_id", "tag"), "elements")
    lists = nodes.where(F.col("tag") == "ul").select("page_id", F.col("node_id").alias("parent_id"))
    rows = nodes.where(F.col("tag") == "li").join(lists, ["page_id", "parent_id"])
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("children"))


@query(
    "descendant_join",
    f"""
    SELECT page_id, CAST(len(regexp_extract_all({_NAV}, '<a ')) AS BIGINT) AS links
    FROM pages WHERE len(regexp_extract_all({_NAV}, '<a ')) > 0
    """,
)
def descendant_join(spark, sf_dir):
    """Descendant step on a stored element table, without a join.

    Elements come in document order, so one lies below a container if a container before it has not ended yet: a running maximum
    of ends per page.
    """
    nodes = written(elements(parsed(stored(spark, sf_dir))).select("page_id", "node_id", "last_id", "tag"), "elements")
    before = W.partitionBy("page_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    end = F.max(F.when(F.col("tag") == "nav", F.col("last_id"))).over(before)
    rows = nodes.where(F.col("tag").isin("nav", "a")).withColumn("end", end)
    return rows.where("tag = 'a' AND node_id <= end").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query(
    "article_text_lengths",
    f"""
    SELECT page_id, CAST(length(trim({_decoded("regexp_replace(a, '<[^>]*>', '', 'g')")}, chr(10) || ' ')) AS BIGINT) AS n_chars
    FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages)
    """,
)
def article_text_lengths(spark, sf_dir):
    items = extract_items(parsed(stored(spark, sf_dir)), "article", parts=("text",))
    return items.select("page_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


# ---- rendered product cards -------------------------------------------------------

_PRICE = "'$' || printf('%.2f', p_retailprice)"


@query(
    "catalog_items",
    f"""
    SELECT p_partkey // 20 AS page_id, 'div' AS tag_name, p_name || {_PRICE} || p_brand AS text,
           CAST(NULL AS VARCHAR) AS own_text, CAST(p_partkey AS VARCHAR) AS data_id,
           '[{{"href":"/p/' || p_partkey || '","text":"' || p_brand || '"}}]' AS links,
           '[{{"src":"/i/' || p_partkey || '.png","alt":"' || p_type || '"}}]' AS images
    FROM part
    """,
)
def catalog_items(spark, sf_dir):
    items = extract_items(
        parsed(rendered.catalog(spark, sf_dir)), ".product",
        parts=("text", "own_text", "attributes", "links", "images"),
    )
    return items.select(
        "page_id", "tag_name", "text", "own_text", F.try_element_at("attributes", F.lit("data-id")).alias("data_id"),
        F.to_json("links").alias("links"), F.to_json("images").alias("images"),
    )


@query(
    "catalog_static_fields",
    f"""
    SELECT p_partkey // 20 AS page_id, p_name AS title, {_PRICE} AS price, '["' || p_name || '","' || {_PRICE} || '","' || p_brand || '",""]' AS parts
    FROM part
    """,
)
def catalog_static_fields(spark, sf_dir):
    fields = [Field.static("h2", ".title", "title"), Field.static(selector=".price", name="price")]
    fields.append(Field.static(selector="h2, span, a, img", name="parts"))
    items = extract_items(parsed(rendered.catalog(spark, sf_dir)), ".card", fields, parts=())
    return items.select("page_id", *[extract.scalar(F.col(f.name)).alias(f.name) for f in fields])


@query(
    "catalog_scoped_fields",
    """
    SELECT p_partkey // 20 AS page_id, CAST(count(*) AS BIGINT) AS cards,
           string_agg('/p/' || p_partkey, ';' ORDER BY p_partkey) AS a,
           string_agg('/i/' || p_partkey || '.png', ';' ORDER BY p_partkey) AS img,
           string_agg(p_name, ';' ORDER BY p_partkey) AS h2
    FROM part GROUP BY 1
    """,
)
def catalog_scoped_fields(spark, sf_dir):
    fields = [
        Field.scoped("a", ".product", "href"), Field.scoped("img", "div", "src"), Field.scoped("h2", "div.card"),
        Field.scoped("div", "div"),
    ]
    items = extract_items(parsed(rendered.catalog(spark, sf_dir)), "main", fields, parts=())
    return items.select(
        "page_id", F.size("a").cast("long").alias("cards"), *[F.array_join(c, ";").alias(c) for c in ("a", "img", "h2")]
    ).where(F.col("cards") > 0)


@query(
    "catalog_attributes",
    """
    SELECT p_partkey // 20 AS page_id, 'product card' AS class, 'p-' || p_partkey AS id,
           CAST(p_partkey AS VARCHAR) AS data_id, CAST(p_size AS VARCHAR) AS data_size, CAST(4 AS BIGINT) AS n
    FROM part
    """,
)
def catalog_attributes(spark, sf_dir):
    items = extract_items(parsed(rendered.catalog(spark, sf_dir)), "div[data-id]", parts=("attributes",))
    names = {"class": "class", "id": "id", "data_id": "data-id", "data_size": "data-size"}
    return items.select(
        "page_id", *[F.try_element_at("attributes", F.lit(a)).alias(n) for n, a in names.items()],
        F.size("attributes").cast("long").alias("n"),
    )


@query(
    "catalog_inner_html",
    f"""
    SELECT p_partkey // 20 AS page_id, '<h2 class="title">' || p_name || '</h2><span class="price">' || {_PRICE} ||
      '</span><a class="more" href="/p/' || p_partkey || '">' || p_brand || '</a><img src="/i/' || p_partkey ||
      '.png" alt="' || p_type || '">' AS html
    FROM part
    """,
)
def catalog_inner_html(spark, sf_dir):
    items = extract_items(parsed(rendered.catalog(spark, sf_dir)), ".product", parts=("html",))
    return items.select("page_id", "html")


@query(
    "catalog_data_attributes",
    """
    SELECT p_partkey // 20 AS page_id, '{"data-id":"' || p_partkey || '","data-size":"' || p_size || '"}' AS data_attributes,
           false AS is_hidden, false AS has_click_handler
    FROM part
    """,
)
def catalog_data_attributes(spark, sf_dir):
    extras = extract.interactive_extras(elements(parsed(rendered.catalog(spark, sf_dir))))
    return extras.where(F.size("data_attributes") > 0).select(
        "page_id", F.to_json("data_attributes").alias("data_attributes"), "is_hidden", "has_click_handler"
    )


@query(
    "xpath_fields_fallback",
    f"""
    SELECT p_partkey // 20 AS page_id, p_name AS name, '/p/' || p_partkey AS link, {_PRICE} AS cost,
           CAST(NULL AS VARCHAR) AS nothing, '["' || p_brand || '"]' AS brands, p_name AS heading
    FROM part
    """,
)
def xpath_fields_fallback(spark, sf_dir):
    fields = [
        Field.by_xpath("//h2", "name"),
        Field.by_xpath("//a[@href]", "link", "attribute", "href"),
        Field.by_xpath("//*[@id='cost']", "cost", fallback="//*[contains(@class,'pri')]"),
        Field.by_xpath("//table", "nothing"),
        Field.by_xpath("//div/a", "brands", multiple=True),
        Field.by_xpath("//h2[1]", "heading", "html"),
    ]
    items = extract_items(parsed(rendered.catalog(spark, sf_dir)), xpath("//div[@data-id]"), fields, parts=())
    return items.select(
        "page_id", "name", "link", "cost", "nothing", F.to_json("brands").alias("brands"), "heading"
    )


@query(
    "xpath_texts",
    """
    SELECT p_partkey // 20 AS page_id, string_agg(p_brand, ';' ORDER BY p_partkey) || ';next' AS texts FROM part GROUP BY 1
    """,
)
def xpath_texts(spark, sf_dir):
    texts = extract.matched_texts(parsed(rendered.catalog(spark, sf_dir)), xpath("//main//a"))
    return texts.select("page_id", F.array_join("texts", ";").alias("texts"))


@query(
    "xpath_attributes",
    "SELECT p_partkey // 20 AS page_id, string_agg(p_type, ';' ORDER BY p_partkey) AS alts FROM part GROUP BY 1",
)
def xpath_attributes(spark, sf_dir):
    values = extract.matched_attributes(parsed(rendered.catalog(spark, sf_dir)), xpath("//*[@src]"), "alt")
    return values.select("page_id", F.array_join("values", ";").alias("alts"))


@query(
    "child_keys",
    """
    WITH k AS (
      SELECT c_custkey // 30 AS page_id, c_custkey % 30 AS i,
             CASE WHEN c_custkey % 3 = 0 THEN 'div.note.hot' ELSE 'div.note.cold' END AS key FROM customer
    )
    SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY page_id, key ORDER BY i) > 1 THEN key || '_' || i ELSE key END AS child_key
    FROM k
    UNION ALL
    SELECT c_custkey // 30, unnest(['div', 'p', 'p_2']) FROM customer
    """,
)
def child_keys(spark, sf_dir):
    keyed = extract.child_keys(elements(parsed(rendered.notes(spark, sf_dir))))
    return keyed.where(F.col("parent_id") > 1).select("page_id", "child_key")


@query(
    "child_trees",
    """
    -- a page of notes as one value; a key taken by an earlier note gets the place of the later one
    WITH n AS (
      SELECT c_custkey // 30 AS page_id, c_custkey % 30 AS i, c_name, c_nationkey,
        CASE WHEN c_custkey % 3 = 0 THEN 'hot' ELSE 'cold' END AS kind FROM customer
    ), k AS (
      SELECT *, 'div.note.' || kind || CASE WHEN row_number() OVER (PARTITION BY page_id, kind ORDER BY i) > 1 THEN '_' || i ELSE '' END AS key FROM n
    )
    SELECT page_id, '{"children":{' || string_agg('"' || key || '":{"attributes":{"class":"note ' || kind || '"},"children":{"div":{"text":"' || c_name ||
      '"},"p":{"text":"nation ' || c_nationkey || '"},"p_2":{"text":"balance"}}}', ',' ORDER BY i) || '}}' AS tree
    FROM k GROUP BY page_id
    """,
)
def child_trees(spark, sf_dir):
    return extract.child_trees(parsed(rendered.notes(spark, sf_dir)), css("body")).select("page_id", "tree")


@query(
    "thread_posts",
    """
    SELECT conv_id, turn, role, trim(text, chr(10) || chr(9) || ' ') AS text FROM conversations
    """,
)
def thread_posts(spark, sf_dir):
    fields = [Field.static(selector=".role", name="role"), Field.static(selector="p.text", name="body")]
    items = extract_items(parsed(rendered.threads(spark, sf_dir)), "article.post", fields, parts=("attributes",))
    ident = F.split(F.try_element_at("attributes", F.lit("id")), "-")
    return items.select(
        F.get(ident, 1).cast("long").alias("conv_id"), F.get(ident, 2).cast("long").alias("turn"),
        F.get("role", 0).alias("role"), F.get("body", 0).alias("text"),
    )


@query(
    "nonempty_items",
    """
    SELECT s_suppkey AS page_id, CAST((s_nationkey % 5) AS BIGINT) AS labels FROM supplier WHERE s_nationkey % 5 > 0
    """,
)
def nonempty_items(spark, sf_dir):
    items = extract_items(parsed(rendered.forms(spark, sf_dir)), "label, input", parts=("text", "links", "images"))
    kept = extract.drop_empty(items)
    return kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("labels"))


@query(
    "parse_errors",
    "SELECT count(*) AS pages, CAST(0 AS BIGINT) AS failed FROM pages",
)
def parse_errors(spark, sf_dir):
    dom = parsed(stored(spark, sf_dir))
    return dom.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("parse_error").isNotNull()).alias("failed"))


@query(
    "parse_failures",
    """
    -- a character reference of 5,000 digits in every third feed page stops the parser there; the others are read
    SELECT doc_id // 10 AS page_id, CASE WHEN (doc_id // 10) % 3 = 0 THEN 'ValueError' END AS error,
      CASE WHEN (doc_id // 10) % 3 = 0 THEN 0 ELSE count(*) END AS items FROM documents GROUP BY 1, 2, (doc_id // 10) % 3
    """,
)
def parse_failures(spark, sf_dir):
    """Pages that cannot be read keep their row and their error, next to those that can."""
    pages = rendered.feed(spark, sf_dir)
    broken = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<p>&#"), F.repeat(F.lit("9"), 5000), F.lit(";</p>"))).otherwise(F.col("html"))
    dom = parsed(pages.withColumn("html", broken))
    items = extract.match_count(css("article")).cast("long")
    return dom.select("page_id", F.split_part(F.col("parse_error"), F.lit(":"), F.lit(1)).alias("error"), items.alias("items"))


@query(
    "lateral_elements",
    """
    SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]+)">([^<]+)</a>')) AS BIGINT) AS links,
      CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages
    """,
)
def lateral_elements(spark, sf_dir):
    """The parser as a table function."""
    register_sql(spark)
    spread(read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "html")).createOrReplaceTempView("lateral_pages")
    return spark.sql(
        "SELECT page_id, count_if(e.tag = 'a' AND e.attrs['href'] <> '' AND e.text <> '') AS links, count_if(e.tag = 'li') AS items "
        "FROM lateral_pages, LATERAL page_elements(html) e GROUP BY page_id")


@query(
    "sql_surface",
    """
    SELECT CAST(sum(len(regexp_extract_all(html, '<a '))) AS BIGINT) AS links, CAST(sum(len(regexp_extract_all(html, '<li>'))) AS BIGINT) AS items FROM pages
    """,
)
def sql_surface(spark, sf_dir):
    """The parser called from SQL."""
    register_sql(spark)
    spread(read_pages(spark, f"{sf_dir}/pages.parquet").select("html")).createOrReplaceTempView("stored_pages")
    return spark.sql(
        "SELECT count_if(tag = 'a') AS links, count_if(tag = 'li') AS items "
        "FROM (SELECT inline_outer(dom.nodes) FROM (SELECT parse_html(html) AS dom FROM stored_pages))"
    )
