"""URL rules, passed on to aliases that redirects and canonical links connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.functions.skew import join_per_key
from domweave.llm.components import connected_components
from domweave.session import written

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(rows: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Adds host, path and node (with a prefix) of the url column.

    host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    then up to ``?``, ``#`` or the end; both empty without ``://``.  node: host, path and query, the identity
    of a resource, without scheme and fragment; null without a host.
    """
    host, path, rest = f"{prefix}host", f"{prefix}path", f"{prefix}_rest"
    at = F.locate("://", F.col(url))
    rows = rows.withColumn(rest, F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(""))
    rows = rows.withColumns({
        host: F.translate(F.regexp_extract(rest, r"\A([^/?#]*+)", 1), *LOWER),
        path: F.regexp_extract(rest, r"\A[^/?#]*+([^?#]*+)", 1),
        f"{prefix}_query": F.regexp_extract(rest, r"\A[^?#]*+(\?[^#]*+)?", 1),
    })
    node = F.concat(host, F.when(F.col(path) == "", "/").otherwise(F.col(path)), f"{prefix}_query")
    return rows.withColumn(f"{prefix}node", F.when(F.col(host) != "", node)).drop(rest, f"{prefix}_query")


def absolute(base: Column, host: Column, path: Column, link: Column) -> Column:
    """``link`` seen from the page ``base`` with these parts."""
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.-]*+)://", 1)
    top = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"\A(.*/)", 1)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*+://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .when(link.rlike(r"\A[?#]"), F.concat(top, path, link))
        .otherwise(F.concat(top, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes joined by ``<link rel=canonical>`` or ``<meta http-equiv=refresh>``; linear in the page."""
    tags = F.expr(f"regexp_extract_all({html}, '(?i)<(?:link|meta)\\\\b[^<>]*+>', 0)")
    tag = F.col("tag")
    href = F.regexp_extract(tag, r"""(?i)\shref\s*+=\s*+["']?+([^"'\s>]++)""", 1)
    refresh = F.regexp_extract(tag, r"""(?i)\scontent\s*+=\s*+["']?+[^"'>]*?url\s*+=\s*+([^"'\s>]++)""", 1)
    link = (
        F.when(tag.rlike(r"""(?i)\A<link\b.*\srel\s*+=\s*+["']?+canonical\b"""), href)
        .when(tag.rlike(r"""(?i)\A<meta\b.*\shttp-equiv\s*+=\s*+["']?+refresh\b"""), refresh)
    )
    lower = F.lower(html)
    likely = lower.contains("canonical") | lower.contains("refresh")
    found = pages.where(likely).select(url, F.explode(tags).alias("tag")).select(url, link.alias("link")).where("link != ''")
    found = url_parts(written(found, "link_tags"), url, "from_").withColumn("to", absolute(F.col(url), F.col("from_host"), F.col("from_path"), F.col("link")))
    return url_parts(found, "to", "to_").select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; rules are (host, path, verdict).

    An expression inside the row: the list is a parameter, so its size is known.
    """
    if not rules:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    known = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in rules))
    fits = F.filter(known, lambda r: ((host == r.h) | F.endswith(host, F.concat(F.lit("."), r.h))) & F.startswith(path, r.p))
    return F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(F.concat(r.h, r.p)).alias("length"), F.concat(r.h, r.p).alias("rule"), r.v.alias("verdict"))))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id",
                url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component of every page.

    A page's own longest rule decides.  A page without a rule takes the decision of its
    aliases: pages (and redirect targets) in one connected component of canonical links,
    refreshes and ``redirects`` (from_url, to_url).  If a rule allows any alias it is
    allowed; else if a rule blocks any, blocked; else allowed.  Aliases that are only link
    targets count as well.

    Null urls and urls without ``://`` have an empty host and path, no rule and no aliases, and are
    allowed.  Repeated pages are judged alike; other columns are ignored; an empty table gives
    no rows.  Only nodes with links are shuffled.
    """
    judged = url_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")), "url")
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        moved = url_parts(url_parts(redirects.select("from_url", "to_url"), "from_url", "f_"), "to_url", "t_")
        edges = edges.union(moved.select("f_node", "t_node"))
    nodes = connected_components(written(edges, "aliases"))  # filters on the edges would repeat all of the above
    rated = url_parts(nodes.withColumn("as_url", F.concat(F.lit("x://"), "node")), "as_url", "n_")
    rated = rated.withColumn("v", matching_rule(F.col("n_host"), F.col("n_path"), rules)["verdict"])
    per_component = rated.groupBy("component").agg(
        F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    decisions = written(
        join_per_key(nodes, per_component, ["component"], ["node"], "inner").select(
            "node", "component",
            F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").alias("alias")),
        "decisions")
    judged = judged.drop("url")
    return join_per_key(judged, decisions, ["node"], ["page_id"], "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias", F.lit("allow")).alias("verdict"), "component")
