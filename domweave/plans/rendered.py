"""Pages rendered from tables, so that what is read from them can be checked with SQL.

Each builder puts a fixed number of rows on a page, so a page is small whatever the
distribution of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domweave.plans.registry import table

CARDS, ORDERS, POSTS, ENTRIES, NOTES = 20, 25, 20, 10, 30


def escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def _join(order: Column, piece: Column) -> Column:
    pieces = F.sort_array(F.collect_list(F.struct(order.alias("order"), piece.alias("piece"))))
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")


def _pages(rows: DataFrame, keys: list[str], order: Column, piece: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(_join(order, piece).alias("body"), F.count(F.lit(1)).alias("n"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product cards, 20 parts a page; the next link of every seventh page is disabled."""
    key = F.col("p_partkey")
    card = F.format_string(
        '<div class="product card" id="p-%d" data-id="%d" data-size="%d"><h2 class="title">%s</h2>'
        '<span class="price">$%.2f</span><a class="more" href="/p/%d">%s</a><img src="/i/%d.png" alt="%s"></div>',
        key, key, "p_size", "p_name", "p_retailprice", key, "p_brand", key, "p_type",
    )
    parts = table(spark, sf_dir, "part").withColumn("page_id", F.expr("p_partkey div 20"))
    pages = _pages(parts, ["page_id"], key, card)
    state = F.when(F.col("page_id") % 7 == 6, " disabled").otherwise("")
    number = (F.col("page_id") + 1).cast("string")
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="en"><head><title>Shop page '), number,
        F.lit('</title><meta name="description" content="Buy at the best price"><meta name="keywords" '
              'content="shop, cart"></head><body><header><h1>Shop</h1></header><main id="main" class="container">'),
        "body",
        F.lit('<a class="next'), state, F.lit('" href="?page='), (F.col("page_id") + 2).cast("string"),
        F.lit('">next</a></main></body></html>'),
    )
    return pages.select(
        "page_id", F.concat(F.lit("https://shop.example.com/list?page="), number).alias("url"), html.alias("html")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order tables, 25 orders a page, and a list with as many entries as page_id mod 6."""
    key = F.col("o_orderkey")
    row = F.format_string(
        '<tr class="row"><td>%d</td><td class="status">%s</td><td class="total">%.2f</td></tr>',
        key, "o_orderstatus", "o_totalprice",
    )
    orders = table(spark, sf_dir, "orders").withColumn("page_id", F.expr("o_orderkey div 25"))
    pages = _pages(orders, ["page_id"], key, row)
    entries = F.repeat(F.lit("<li>total</li>"), (F.col("page_id") % 6).cast("int"))
    html = F.concat(
        F.lit('<html><body><table id="t" class="ledger"><tr><th>Order</th><th>Status</th><th>Total</th></tr>'),
        "body", F.lit('</table><ul class="totals">'), entries, F.lit("</ul></body></html>"),
    )
    url = F.concat(F.lit("https://ledger.example.com/page/"), (F.col("page_id") + 1).cast("string"))
    return pages.select("page_id", url.alias("url"), html.alias("html"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation threads, at most 20 turns a page."""
    post = F.concat(
        F.format_string('<article class="post" id="c-%d-%d"><p class="role">%s</p><p class="text">', "conv_id", "turn", "role"),
        escape(F.col("text")), F.lit("</p></article>"),
    )
    turns = table(spark, sf_dir, "conversations").withColumn("part", F.expr("turn div 20"))
    pages = _pages(turns, ["conv_id", "part"], F.col("turn"), post)
    html = F.concat(
        F.lit("<html><head><title>Forum thread "), F.col("conv_id").cast("string"),
        F.lit("</title></head><body>"), "body", F.lit("</body></html>"),
    )
    page_id = F.col("conv_id") * 100000 + F.col("part")
    url = F.concat(F.lit("https://forum.example.com/t/"), page_id.cast("string"))
    return pages.select(page_id.alias("page_id"), url.alias("url"), html.alias("html"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document feeds, 10 documents a page, with description and keywords."""
    entry = F.concat(
        F.format_string('<article><h1>%s</h1><p class="content">', "source"), escape(F.col("text")),
        F.lit("</p></article>"),
    )
    docs = table(spark, sf_dir, "documents").withColumn("page_id", F.expr("doc_id div 10"))
    pages = _pages(docs, ["page_id"], F.col("doc_id"), entry)
    html = F.concat(
        F.lit('<html><head><title>Latest News story</title><meta name="description" content="Daily report">'
              '<meta name="keywords" content="author"></head><body>'),
        "body", F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://feed.example.com/"), F.col("page_id").cast("string"))
    return pages.select("page_id", url.alias("url"), html.alias("html"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer notes without any landmark, 30 a page: nested divs, like siblings, unclosed items."""
    key = F.col("c_custkey")
    note = F.format_string(
        '<div class="note %s"><div>%s</div><p>nation %d<p>balance</div>',
        F.when(key % 3 == 0, "hot").otherwise("cold"), "c_name", "c_nationkey",
    )
    customers = table(spark, sf_dir, "customer").withColumn("page_id", F.expr("c_custkey div 30"))
    pages = _pages(customers, ["page_id"], key, note)
    url = F.concat(F.lit("https://notes.example.com/"), F.col("page_id").cast("string"))
    return pages.select("page_id", url.alias("url"), F.col("body").alias("html"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contact page per supplier; what is on it depends on the keys."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    head = F.format_string(
        '<html><body>%s%s<form id="f-%d" %saction="/x/%d">', F.when(key % 2 == 0, "<nav>top</nav>").otherwise(""),
        F.when(key % 3 == 0, '<aside class="sidebar">side</aside>').otherwise(""), key,
        F.when(key % 4 == 0, "").otherwise('method="post" '), key,
    )
    html = F.concat(
        head, F.repeat(F.lit('<label>x<input name="q"></label>'), (nation % 5).cast("int")),
        F.lit("<select><option>1<option>2</select><textarea><input></textarea></form>"),
        F.repeat(F.lit("<video></video>"), (key % 3).cast("int")),
        F.repeat(F.lit("<iframe><p></iframe>"), (nation % 2).cast("int")),
        F.when(key % 5 == 0, "<footer>end</footer>").otherwise(""), F.lit("</body></html>"),
    )
    url = F.concat(F.lit("https://forms.example.com/"), key.cast("string"))
    return table(spark, sf_dir, "supplier").select(key.alias("page_id"), url.alias("url"), html.alias("html"))
