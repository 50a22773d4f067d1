"""Queries on structure analysis, similarity and locators."""

from __future__ import annotations

from pyspark.sql import functions as F

from domweave.functions.selectors import css
from domweave.operators import analyze, similar
from domweave.operators.dom import elements
from domweave.plans import rendered
from domweave.plans.page_queries import parsed, stored
from domweave.plans.registry import query

@query(
    "catalog_type_scores",
    """
    -- title: shop (3); description: price, buy (2 + 2); keywords: cart, shop (1 + 1);
    -- classes: product and price once per card; price bonus 5
    SELECT page_id, CAST(14 + 2 * n AS BIGINT) AS score_ecommerce, CAST(0 AS BIGINT) AS score_news,
           CAST(0 AS BIGINT) AS score_blog, CAST(0 AS BIGINT) AS score_social, CAST(0 AS BIGINT) AS score_forum,
           'ecommerce' AS page_type
    FROM (SELECT p_partkey // 20 AS page_id, count(*) AS n FROM part GROUP BY 1)
    """,
)
def catalog_type_scores(spark, sf_dir):
    features = analyze.page_features(parsed(rendered.catalog(spark, sf_dir)))
    return features.select("page_id", *[c for c in features.columns if c.startswith("score_")], "page_type")


@query(
    "thread_page_types",
    """
    -- title: thread (3); post in a class once per turn, for blog and forum; article bonus 5 for news,
    -- post bonus 5 for blog
    WITH t AS (SELECT conv_id * 100000 + turn // 20 AS page_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT page_id, CAST(5 AS BIGINT) AS score_news, CAST(5 + n AS BIGINT) AS score_blog, CAST(3 + n AS BIGINT) AS score_forum,
           'blog' AS page_type
    FROM t
    """,
)
def thread_page_types(spark, sf_dir):
    features = analyze.page_features(parsed(rendered.threads(spark, sf_dir)))
    return features.select("page_id", "score_news", "score_blog", "score_forum", "page_type")


@query(
    "page_types",
    """
    -- stored pages: words in the title count 3 each, the only class is "ad", article gives news 5
    WITH t AS (
      SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages
    ), s AS (
      SELECT page_id,
        3 * len(list_filter(['price','buy','cart','shop','product','order','payment'], lambda w: contains(title, w))) AS ecommerce,
        5 + 3 * len(list_filter(['article','news','story','report','headline','author','date'], lambda w: contains(title, w))) AS news,
        3 * len(list_filter(['post','blog','comment','tag','category','archive'], lambda w: contains(title, w))) AS blog,
        3 * len(list_filter(['like','share','follow','friend','profile','feed'], lambda w: contains(title, w))) AS social,
        3 * len(list_filter(['thread','post','reply','user','topic','discussion'], lambda w: contains(title, w))) AS forum
      FROM t
    )
    SELECT page_id, CAST(greatest(ecommerce, news, blog, social, forum) AS BIGINT) AS score,
      CASE WHEN greatest(ecommerce, news, blog, social, forum) <= 5 THEN 'general'
           WHEN forum >= greatest(ecommerce, news, blog, social) THEN 'forum'
           WHEN social >= greatest(ecommerce, news, blog) THEN 'social'
           WHEN blog >= greatest(ecommerce, news) THEN 'blog'
           WHEN news >= ecommerce THEN 'news' ELSE 'ecommerce' END AS page_type
    FROM s
    """,
)
def page_types(spark, sf_dir):
    features = analyze.page_features(parsed(stored(spark, sf_dir)))
    scores = [c for c in features.columns if c.startswith("score_")]
    return features.select("page_id", F.greatest(*scores).alias("score"), "page_type")


@query(
    "structure_flags",
    """
    SELECT s_suppkey AS page_id, false AS has_header, s_suppkey % 2 = 0 AS has_navigation,
           s_suppkey % 5 = 0 AS has_footer, s_suppkey % 3 = 0 AS has_sidebar FROM supplier
    UNION ALL
    SELECT -1 - page_id, regexp_matches(html, '<header[ >]'), regexp_matches(html, '<nav[ >]'),
           regexp_matches(html, '<footer[ >]'), regexp_matches(html, '<aside[ >]') FROM pages
    """,
)
def structure_flags(spark, sf_dir):
    names = ["has_header", "has_navigation", "has_footer", "has_sidebar"]
    made = analyze.page_features(parsed(rendered.forms(spark, sf_dir))).select("page_id", *names)
    kept = analyze.page_features(parsed(stored(spark, sf_dir))).select((-1 - F.col("page_id")).alias("page_id"), *names)
    return made.unionByName(kept)


@query(
    "main_content",
    """
    SELECT 'catalog' AS source, p_partkey // 20 AS page_id, 'main' AS selector, 'MAIN' AS tag_name,
           'container' AS classes, 'main' AS id, CAST(count(*) + 1 AS BIGINT) AS children_count, false AS is_inferred
    FROM part GROUP BY 2
    UNION ALL
    -- in an article stand a heading and paragraphs; a paragraph ends the one left open before it
    SELECT 'pages', page_id, 'article', 'ARTICLE', NULL, NULL,
           len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<(h1|p)>')), false
    FROM pages WHERE regexp_matches(html, '<article>')
    UNION ALL
    -- longest div: the first note with the longest text; each note holds one div and two paragraphs
    SELECT 'notes', page_id, 'div.note', 'DIV', arg_max(cls, (size, -c_custkey)), NULL, 3, true
    FROM (
      SELECT c_custkey // 30 AS page_id, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'note hot' ELSE 'note cold' END AS cls,
             length(c_name || 'nation ' || c_nationkey || 'balance') AS size FROM customer
    ) GROUP BY page_id
    """,
)
def main_content(spark, sf_dir):
    def found(pages, source):
        features = analyze.page_features(parsed(pages))
        rows = features.select(F.lit(source).alias("source"), "page_id", "main_content.*")
        return rows.withColumn("children_count", F.col("children_count").cast("long"))

    return (
        found(rendered.catalog(spark, sf_dir), "catalog")
        .unionByName(found(stored(spark, sf_dir), "pages"))
        .unionByName(found(rendered.notes(spark, sf_dir), "notes"))
    )


@query(
    "repeating_groups",
    """
    WITH n AS (
      SELECT c_custkey // 30 AS page_id, c_custkey, c_name || 'nation ' || c_nationkey || 'balance' AS text FROM customer
    )
    SELECT page_id, 'DIV.note' AS selector, count(*) AS count, 3.0::DOUBLE AS avg_children,
           array_to_string(list_slice(list(text ORDER BY c_custkey), 1, 3), '|') AS samples
    FROM n GROUP BY page_id HAVING count(*) >= 3
    """,
)
def repeating_groups(spark, sf_dir):
    groups = analyze.repeating_groups(parsed(rendered.notes(spark, sf_dir)))
    return groups.withColumn("samples", F.array_join("samples", "|"))


@query(
    "catalog_groups",
    """
    WITH p AS (SELECT p_partkey // 20 AS page_id, count(*) AS n FROM part GROUP BY 1)
    SELECT page_id, selector, n AS count, children::DOUBLE AS avg_children
    FROM p, (VALUES ('DIV.product', 4), ('H2.title', 0), ('SPAN.price', 0), ('A.more', 0)) AS g(selector, children)
    WHERE n >= 3
    """,
)
def catalog_groups(spark, sf_dir):
    return analyze.repeating_groups(parsed(rendered.catalog(spark, sf_dir))).drop("samples")


@query(
    "best_selectors",
    """
    WITH p AS (
      SELECT p_partkey // 20 AS page_id, count(*) AS n,
        array_to_string(list_slice(list(substr(p_name || '$' || printf('%.2f', p_retailprice) || p_brand, 1, 50) ORDER BY p_partkey), 1, 3), '|') AS cards,
        array_to_string(list_slice(list('$' || printf('%.2f', p_retailprice) ORDER BY p_partkey), 1, 3), '|') AS prices,
        array_to_string(list_slice(list(p_name ORDER BY p_partkey), 1, 3), '|') AS names,
        array_to_string(list_slice(list(p_brand ORDER BY p_partkey), 1, 3), '|') AS brands
      FROM part GROUP BY 1
    )
    SELECT page_id, 'ecommerce' AS page_type, 'products' AS suggestion, '.product' AS selector, n AS count, cards AS samples FROM p
    UNION ALL SELECT page_id, 'ecommerce', 'prices', '.price', n, prices FROM p
    UNION ALL SELECT page_id, 'ecommerce', 'titles', '.title', n, names FROM p
    UNION ALL SELECT page_id, 'blog', 'titles', 'h2', n, names FROM p WHERE n > 1
    UNION ALL SELECT page_id, 'news', 'headlines', 'h2', n, names FROM p WHERE n > 1
    UNION ALL SELECT page_id, 'default', 'headings', 'h2', n, names FROM p WHERE n > 1
    UNION ALL SELECT page_id, 'default', 'links', 'a', n + 1, brands FROM p WHERE n > 2
    """,
)
def best_selectors(spark, sf_dir):
    best = analyze.best_selectors(parsed(rendered.catalog(spark, sf_dir)))
    return best.withColumn("samples", F.array_join("samples", "|"))


@query(
    "data_patterns",
    """
    WITH o AS (SELECT o_orderkey // 25 AS page_id, count(*) + 1 AS n FROM orders GROUP BY 1),
         p AS (SELECT p_partkey // 20 AS page_id, count(*) AS n FROM part GROUP BY 1)
    SELECT page_id, 'table' AS type, 'table#t' AS selector, n AS size, 0.9::DOUBLE AS confidence FROM o WHERE n > 2
    UNION ALL SELECT page_id, 'list', 'ul.totals', page_id % 6, 0.8::DOUBLE FROM o WHERE page_id % 6 > 3
    UNION ALL SELECT -1 - page_id, 'cards', s, n, 0.85::DOUBLE FROM p, unnest(['.card', '.product', '[class*="card"]']) AS t(s) WHERE n > 2
    """,
)
def data_patterns(spark, sf_dir):
    one = analyze.data_patterns(parsed(rendered.ledger(spark, sf_dir)))
    other = analyze.data_patterns(parsed(rendered.catalog(spark, sf_dir)))
    other = other.withColumn("page_id", -1 - F.col("page_id"))
    return one.unionByName(other).drop("order")


@query(
    "stored_page_lists",
    """
    SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS size FROM pages
    WHERE len(regexp_extract_all(html, '<li>')) > 3
    """,
)
def stored_page_lists(spark, sf_dir):
    return analyze.data_patterns(parsed(stored(spark, sf_dir))).where(F.col("type") == "list").select("page_id", "size")


@query(
    "form_analysis",
    """
    SELECT s_suppkey AS page_id, 'form#f-' || s_suppkey AS selector,
           CASE WHEN s_suppkey % 4 = 0 THEN 'GET' ELSE 'post' END AS method, '/x/' || s_suppkey AS action,
           CAST(s_nationkey % 5 + 2 AS BIGINT) AS inputs
    FROM supplier
    """,
)
def form_analysis(spark, sf_dir):
    return analyze.forms(parsed(rendered.forms(spark, sf_dir)))


@query(
    "table_shapes",
    """
    SELECT o_orderkey // 25 AS page_id, 'table#t' AS selector, count(*) + 1 AS rows, CAST(3 AS BIGINT) AS columns
    FROM orders GROUP BY 1
    """,
)
def table_shapes(spark, sf_dir):
    return analyze.tables(parsed(rendered.ledger(spark, sf_dir)))


@query(
    "media_counts",
    """
    SELECT s_suppkey AS page_id, CAST(0 AS BIGINT) AS images, CAST(s_suppkey % 3 AS BIGINT) AS videos,
           CAST(s_nationkey % 2 AS BIGINT) AS iframes FROM supplier
    """,
)
def media_counts(spark, sf_dir):
    features = analyze.page_features(parsed(rendered.forms(spark, sf_dir)))
    return features.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("images", "videos", "iframes")])


@query(
    "element_categories",
    """
    WITH c AS (
      SELECT page_id,
        len(regexp_extract_all(html, '<h1>')) AS title, len(regexp_extract_all(html, '<(p)>')) AS content,
        len(regexp_extract_all(html, '<ul>')) AS list, len(regexp_extract_all(html, '<nav>')) AS navigation,
        len(regexp_extract_all(html, '<article>')) AS article, len(regexp_extract_all(html, '<a ')) AS link,
        len(regexp_extract_all(html, '<footer>')) AS footer FROM pages
    )
    SELECT page_id, category, CAST(elements AS BIGINT) AS elements
    FROM (UNPIVOT c ON title, content, list, navigation, article, link, footer INTO NAME category VALUE elements)
    WHERE elements > 0
    """,
)
def element_categories(spark, sf_dir):
    return analyze.element_categories(parsed(stored(spark, sf_dir)))


@query(
    "short_selectors",
    """
    SELECT p_partkey // 20 AS page_id, 'div#p-' || p_partkey AS selector FROM part
    UNION ALL SELECT p_partkey // 20, unnest(['h2.title', 'span.price', 'a.more', 'img']) FROM part
    UNION ALL SELECT page_id, unnest(['html', 'head', 'title', 'meta', 'meta', 'body', 'header', 'h1', 'main#main', 'a.next'])
    FROM (SELECT DISTINCT p_partkey // 20 AS page_id FROM part)
    """,
)
def short_selectors(spark, sf_dir):
    nodes = elements(parsed(rendered.catalog(spark, sf_dir)))
    return nodes.select("page_id", F.expr(analyze.short_selector_sql()).alias("selector"))


@query(
    "page_analysis",
    """
    WITH o AS (SELECT o_orderkey // 25 AS page_id, count(*) AS n FROM orders GROUP BY 1), f AS (
      SELECT page_id, n, (n + 1 > 2)::INT + (page_id % 6 > 3)::INT AS patterns, n >= 3 AS repeated,
             CAST(n + 1 AS VARCHAR) || 'x3' AS tables
      FROM o
    )
    SELECT page_id, 'general' AS page_type, round(0.5 + CASE WHEN repeated THEN 0.15 ELSE 0 END + least(0.05 * patterns, 0.15), 6)::DOUBLE AS confidence,
      CASE WHEN repeated THEN 'TD.status,TD.total,TR.row' ELSE '' END AS repeating,
      array_to_string(list_filter([CASE WHEN n + 1 > 2 THEN 'table:' || (n + 1) END, CASE WHEN page_id % 6 > 3 THEN 'list:' || (page_id % 6) END], lambda x: x IS NOT NULL), ',') AS patterns,
      tables,
      array_to_string(list_filter([CASE WHEN 0.5 + CASE WHEN repeated THEN 0.15 ELSE 0 END + least(0.05 * patterns, 0.15) < 0.6999999 THEN 'low_confidence' END,
        CASE WHEN patterns > 0 THEN 'patterns_found' END, CASE WHEN repeated THEN 'repeating_elements' END], lambda x: x IS NOT NULL), ',') AS advice
    FROM f
    """,
)
def page_analysis(spark, sf_dir):
    a = analyze.analyze_pages(parsed(rendered.ledger(spark, sf_dir)))
    return a.select(
        "page_id", "page_type", F.round("confidence", 6).alias("confidence"),
        F.array_join(F.transform("repeating_elements", lambda r: r["selector"]), ",").alias("repeating"),
        F.array_join(
            F.transform("data_patterns", lambda p: F.concat(p["type"], F.lit(":"), p["size"].cast("string"))), ","
        ).alias("patterns"),
        F.array_join(
            F.transform("tables", lambda t: F.concat(t["rows"].cast("string"), F.lit("x"), t["columns"].cast("string"))),
            ",",
        ).alias("tables"),
        F.array_join("recommendations", ",").alias("advice"),
    )


@query(
    "stored_page_analysis",
    """
    -- stored pages: article is the main content, the only class (ad) occurs once, every list of more than three items counts
    WITH p AS (
      SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
        list_filter(list_transform(regexp_extract_all(html, '(?s)<ul>.*?</ul>'), lambda u: len(regexp_extract_all(u, '<li>'))), lambda n: n > 3) AS lists FROM pages
    ), w AS (
      SELECT *, [
        {'score': 3 * len(list_filter(['price','buy','cart','shop','product','order','payment'], lambda w: contains(title, w))), 'place': 1, 'name': 'ecommerce'},
        {'score': 5 + 3 * len(list_filter(['article','news','story','report','headline','author','date'], lambda w: contains(title, w))), 'place': 2, 'name': 'news'},
        {'score': 3 * len(list_filter(['post','blog','comment','tag','category','archive'], lambda w: contains(title, w))), 'place': 3, 'name': 'blog'},
        {'score': 3 * len(list_filter(['like','share','follow','friend','profile','feed'], lambda w: contains(title, w))), 'place': 4, 'name': 'social'},
        {'score': 3 * len(list_filter(['thread','post','reply','user','topic','discussion'], lambda w: contains(title, w))), 'place': 5, 'name': 'forum'}] AS scores
      FROM p
    ), s AS (SELECT *, list_sort(scores)[-1] AS best FROM w), t AS (SELECT *, CASE WHEN best.score > 5 THEN best.name ELSE 'general' END AS page_type FROM s)
    SELECT page_id, page_type, 'article' AS main, array_to_string(list_transform(lists, lambda n: 'list:ul:' || n), ',') AS patterns,
      round(0.5::DOUBLE + CASE WHEN page_type <> 'general' THEN 0.2 ELSE 0 END + 0.1 + least(0.05 * len(lists), 0.15), 6)::DOUBLE AS confidence
    FROM t
    """,
)
def stored_page_analysis(spark, sf_dir):
    a = analyze.analyze_pages(parsed(stored(spark, sf_dir)))
    return a.select(
        "page_id", "page_type", F.col("main_content.selector").alias("main"),
        F.array_join(F.transform("data_patterns", lambda p: F.concat_ws(":", p["type"], p["selector"], p["size"].cast("string"))), ",").alias("patterns"),
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "catalog_analysis",
    """
    WITH p AS (SELECT p_partkey // 20 AS page_id, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1)
    SELECT page_id, 'ecommerce' AS page_type, '.product' AS products, '.price' AS prices, '.title' AS titles, n AS found,
           least(1.0, round(0.5 + 0.2 + 0.1 + CASE WHEN n >= 3 THEN 0.15 ELSE 0 END + CASE WHEN n > 2 THEN 0.15 ELSE 0 END, 6))::DOUBLE AS confidence,
           CASE WHEN n > 2 THEN 'cards:.card,cards:.product,cards:[class*="card"]' ELSE '' END AS patterns
    FROM p
    """,
)
def catalog_analysis(spark, sf_dir):
    a = analyze.analyze_pages(parsed(rendered.catalog(spark, sf_dir)))
    s = F.col("suggested_selectors")
    return a.select(
        "page_id", "page_type", s["products"]["selector"].alias("products"), s["prices"]["selector"].alias("prices"),
        s["titles"]["selector"].alias("titles"), s["products"]["count"].alias("found"),
        F.round("confidence", 6).alias("confidence"),
        F.array_join(
            F.transform("data_patterns", lambda p: F.concat(p["type"], F.lit(":"), p["selector"])), ","
        ).alias("patterns"),
    )


@query(
    "confidence_buckets",
    """
    WITH a AS (
      SELECT 0.5 + CASE WHEN n >= 3 THEN 0.15 ELSE 0 END + CASE WHEN n + 1 > 2 THEN 0.05 ELSE 0 END + CASE WHEN page_id % 6 > 3 THEN 0.05 ELSE 0 END AS c
      FROM (SELECT o_orderkey // 25 AS page_id, count(*) AS n FROM orders GROUP BY 1)
    )
    SELECT CASE WHEN c > 0.6999999 THEN 'high' ELSE 'medium' END AS bucket, count(*) AS pages FROM a GROUP BY 1
    """,
)
def confidence_buckets(spark, sf_dir):
    a = analyze.analyze_pages(parsed(rendered.ledger(spark, sf_dir)))
    bucket = analyze.confidence_bucket(F.col("confidence"))
    return a.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


@query(
    "applied_suggestions",
    """
    SELECT DISTINCT p_partkey // 20 AS page_id, 'ecommerce' AS page_type, '.product' AS adapted_selector,
           '.product' AS applied_selector, 'smart-puppeteer' AS applied_strategy, 'high' AS confidence_bucket
    FROM part
    """,
)
def applied_suggestions(spark, sf_dir):
    return analyze.adapted_selector(analyze.analyze_pages(parsed(rendered.catalog(spark, sf_dir))))


@query(
    "adapted_jobs",
    """
    SELECT p_partkey // 100 AS job_id, '.product' AS item_selector FROM part GROUP BY 1
    """,
)
def adapted_jobs(spark, sf_dir):
    dom = parsed(rendered.catalog(spark, sf_dir))
    pages = rendered.catalog(spark, sf_dir).select(
        F.expr("page_id div 5").alias("job_id"), (F.col("page_id") % 5).alias("page_no"), "page_id",
        F.lit("body").alias("item_selector"),
    )
    return analyze.adapt_jobs(pages, analyze.analyze_pages(dom))


@query(
    "similar_elements",
    """
    -- like the first card: every other card (same tag, classes, child count and parent)
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS rn FROM part)
    SELECT p_partkey // 20 AS page_id, 'div' AS tag, 1.0::DOUBLE AS similarity, '//div[@id=''p-' || p_partkey || ''']' AS locator
    FROM f WHERE rn > 1
    """,
)
def similar_elements(spark, sf_dir):
    rows = similar.similar_elements(parsed(rendered.catalog(spark, sf_dir)), css(".card"))
    return rows.select("page_id", "tag", F.round("similarity", 6).alias("similarity"), "locator")


@query(
    "similar_notes",
    """
    -- first note of the page against the others: 0.3 tag + 0.4 * shared class share + 0.2 children + 0.1 parent,
    -- added in this order as doubles; half the classes in common then stays just below 0.8
    WITH n AS (
      SELECT c_custkey // 30 AS page_id, c_custkey % 3 = 0 AS hot,
             first_value(c_custkey % 3 = 0) OVER (PARTITION BY c_custkey // 30 ORDER BY c_custkey) AS base_hot,
             row_number() OVER (PARTITION BY c_custkey // 30 ORDER BY c_custkey) AS rn
      FROM customer
    ), s AS (
      SELECT page_id, 0.3::DOUBLE + (CASE WHEN hot = base_hot THEN 1 ELSE 0.5 END)::DOUBLE * 0.4::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE AS similarity
      FROM n WHERE rn > 1
    )
    SELECT page_id, round(similarity, 6) AS similarity, count(*) AS elements FROM s WHERE similarity >= 0.8::DOUBLE GROUP BY 1, 2
    """,
)
def similar_notes(spark, sf_dir):
    rows = similar.similar_elements(parsed(rendered.notes(spark, sf_dir)), css(".note"))
    return rows.groupBy("page_id", F.round("similarity", 6).alias("similarity")).agg(F.count(F.lit(1)).alias("elements"))


@query(
    "smart_locators",
    """
    SELECT p_partkey // 20 AS page_id, '//div[@id=''p-' || p_partkey || ''']' AS locator FROM part
    UNION ALL
    SELECT p_partkey // 20, unnest(['//h2[contains(@class,''title'')]', '//span[contains(@class,''price'')]',
           '//a[contains(@class,''more'')]', '//main/div' ||
           CASE WHEN n > 1 THEN '[' || rn || ']' ELSE '' END || '/img']) FROM (
      SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS rn,
             count(*) OVER (PARTITION BY p_partkey // 20) AS n FROM part)
    UNION ALL
    SELECT page_id, unnest(['//html', '//html/head', '//html/head/title', '//meta[@name=''description'']', '//meta[@name=''keywords'']',
           '//html/body', '//header', '//header/h1', '//main[@id=''main'']', '//a[contains(@class,''next'')' ||
           CASE WHEN page_id % 7 = 6 THEN ' and contains(@class,''disabled'')' ELSE '' END || ']'])
    FROM (SELECT DISTINCT p_partkey // 20 AS page_id FROM part)
    """,
)
def smart_locators(spark, sf_dir):
    return similar.locators(parsed(rendered.catalog(spark, sf_dir))).select("page_id", "locator")


@query(
    "path_locators",
    """
    WITH o AS (SELECT o_orderkey // 25 AS page_id, o_orderkey, 1 + row_number() OVER (PARTITION BY o_orderkey // 25 ORDER BY o_orderkey) AS rn FROM orders)
    SELECT page_id, '//table/tbody/tr[' || rn || ']/td[' || i || ']' AS path FROM o, (VALUES (1), (2), (3)) AS t(i)
    UNION ALL SELECT page_id, '//table/tbody/tr[' || rn || ']' FROM o
    UNION ALL SELECT page_id, unnest(['//html', '//html/head', '//html/body', '//table', '//table/tbody', '//table/tbody/tr[1]',
      '//table/tbody/tr[1]/th[1]', '//table/tbody/tr[1]/th[2]', '//table/tbody/tr[1]/th[3]', '//ul']) FROM (SELECT DISTINCT page_id FROM o)
    UNION ALL SELECT page_id, '//ul/li' || CASE WHEN page_id % 6 > 1 THEN '[' || unnest(range(1, page_id % 6 + 1)) || ']'
      ELSE substr('', unnest(range(1, page_id % 6 + 1))) END FROM (SELECT DISTINCT page_id FROM o)
    """,
)
def path_locators(spark, sf_dir):
    rows = similar.locators(parsed(rendered.ledger(spark, sf_dir)))
    return rows.select("page_id", "path")
