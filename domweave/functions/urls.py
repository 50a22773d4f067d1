"""Page URLs of a paged listing, and the URL syntax test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the two URL-building paging types.
DEFAULT_QUERY_PARAM = "page"
DEFAULT_PATH_PREFIX = "page/"


def page_url(base: Column, page: Column, paging: Column, query_param: Column, path_prefix: Column) -> Column:
    """URL of page ``page``: query parameter, path segment, or the base itself."""
    number = page.cast("string")
    param = F.coalesce(F.nullif(query_param, F.lit("")), F.lit(DEFAULT_QUERY_PARAM))
    prefix = F.coalesce(F.nullif(path_prefix, F.lit("")), F.lit(DEFAULT_PATH_PREFIX))
    separator = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return (
        F.when(paging == "query", F.concat(base, separator, param, F.lit("="), number))
        .when(paging == "path", F.concat(F.regexp_replace(base, r"/\z", ""), F.lit("/"), prefix, number))
        .otherwise(base)
    )


def is_valid_url(url: Column) -> Column:
    """An absolute URL: it parses and has a scheme."""
    return F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull()
