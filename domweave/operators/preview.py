"""Previews of an item table: first items of a job, readable values, field profile, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domweave.functions import text
from domweave.plans import rules as R


def first_pages(visited: DataFrame, page_no: str = "page_no") -> DataFrame:
    """Only the first page of each job.  Apply before parsing: the parser blocks filters."""
    return visited.where(F.col(page_no) == 1)


def preview_items(
    items: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("page_id", "item_id"), limit: int = R.PREVIEW_ITEMS
) -> DataFrame:
    """First ``limit`` items of each job with their rank.

    The rank filter is applied per partition before the shuffle, so a large job sends
    only its candidates.
    """
    rank = F.row_number().over(W.partitionBy(job).orderBy(*order))
    return items.withColumn("rank", rank).where(F.col("rank") <= limit)


def total_found(items: DataFrame, job: str = "job_id") -> DataFrame:
    return items.groupBy(job).agg(F.count(F.lit(1)).alias("total_found"))


def _shown(value: Column, kind: T.DataType, name: str) -> Column:
    if name == "links" and isinstance(kind, T.ArrayType):
        lines = F.transform(value, lambda v: F.concat(v["text"], F.lit(R.ARROW), v["href"]))
        return F.when(value.isNotNull(), F.coalesce(F.nullif(F.array_join(lines, "; "), F.lit("")), F.lit(R.NO_LINKS)))
    if name == "images" and isinstance(kind, T.ArrayType):
        lines = F.transform(
            value,
            lambda v: F.concat(F.coalesce(F.nullif(v["alt"], F.lit("")), F.lit(R.IMAGE_WORD)), F.lit(R.ARROW), v["src"]),
        )
        return F.when(value.isNotNull(), F.coalesce(F.nullif(F.array_join(lines, "; "), F.lit("")), F.lit(R.NO_IMAGES)))
    if isinstance(kind, T.ArrayType):
        nested = isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType))
        return F.array_join(F.transform(value, lambda v: F.to_json(v)) if nested else value.cast("array<string>"), "; ")
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(value)
    return value


def format_items(items: DataFrame, keys: tuple[str, ...] = ("page_id", "item_id"), shorten: int | None = None):
    """Readable values: links and images as lines, arrays joined, objects as JSON."""
    columns = []
    for f in items.schema.fields:
        shown = _shown(F.col(f"`{f.name}`"), f.dataType, f.name)
        if shorten and f.name not in keys and not isinstance(f.dataType, T.NumericType):
            shown = text.shorten(shown.cast("string"), shorten)
        columns.append(shown.alias(f.name))
    return items.select(*columns)


def field_profile(items: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Per field: value count, the set of value types, first three values.

    The samples come from a rank filter, the types from a set of at most nine names,
    so no group is ever gathered.
    """
    kinds = {f.name: f.dataType for f in items.schema.fields}
    names = [c for c in items.columns if c not in keys]

    def entry(name):
        column = F.col(f"`{name}`")
        shown = _shown(column, kinds[name], "").cast("string")
        return F.when(
            column.isNotNull(),
            F.struct(
                F.lit(name).alias("field"), text.preview_type(column, kinds[name]).alias("type"), shown.alias("value")
            ),
        )

    entries = F.filter(F.array(*[entry(n) for n in names]), lambda e: e.isNotNull())
    long = items.select(*order, F.explode_outer(entries).alias("e")).where(F.col("e").isNotNull()).select(*order, "e.*")
    types = long.groupBy("field").agg(
        F.count(F.lit(1)).alias("values"), F.sort_array(F.collect_set("type")).alias("types")
    )
    rank = F.row_number().over(W.partitionBy("field").orderBy(*order))
    samples = (
        long.withColumn("rank", rank).where(F.col("rank") <= R.SAMPLE_COUNT)
        .groupBy("field").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .select("field", F.transform("s", lambda s: s["value"]).alias("samples"))
    )
    return types.join(samples, "field")


def preview_advice(total: Column) -> Column:
    """Advice code for the number of items found."""
    return (
        F.when(total == 0, "nothing_found").when(total < R.FEW_ITEMS, "few_items").when(total > R.MANY_ITEMS, "many_items")
    )


def exported_schema(items: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("page_id", "item_id")) -> DataFrame:
    """(job, field, type, required): field types by the first item of each job, for a schema file per job.

    The first item is found by a mergeable minimum, so a job of any size sends one row per task, and the answer
    does not depend on scheduling.
    """
    kinds = {f.name: f.dataType for f in items.schema.fields if f.name != job}
    first = items.groupBy(job).agg(F.min_by(F.struct(*[f"`{n}`" for n in kinds]), F.struct(*order)).alias("first"))
    entries = F.array(*[
        F.struct(F.lit(n).alias("field"), text.display_type(F.col("first")[n], k).alias("type"), F.lit(False).alias("required"))
        for n, k in kinds.items()
    ])
    return first.select(job, F.inline(entries))
