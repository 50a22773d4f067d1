"""Exports of item tables: JSON, CSV, XML and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domweave.session import written


def map_keys(items: DataFrame, column: str, order: tuple[str, ...] = ()) -> list[str]:
    """Distinct keys of a map column in first-seen order: names of export columns."""
    seen = items.select(*order, F.explode(F.map_keys(F.col(f"`{column}`"))).alias("key")).groupBy("key")
    first = seen.agg((F.min(F.struct(*order)) if order else F.min("key")).alias("first"))
    return [row["key"] for row in first.orderBy("first", "key").collect()]


def open_header(items: DataFrame, columns: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(name, place): dotted names of all keys of map columns, in first-seen order of rows and columns.

    Names are a table: they are reduced by Spark and never become columns of a plan, so there may be any number.
    """
    def names_of(n, c):
        keys = F.coalesce(F.map_keys(F.col(f"`{c}`")), F.array().cast("array<string>"))
        return F.transform(keys, lambda k, i: F.struct(F.concat(F.lit(f"{c}."), k).alias("name"), F.lit(n).alias("column"), i.alias("i")))

    listed = F.flatten(F.array(*[names_of(n, c) for n, c in enumerate(columns)]))
    seen = items.select(*order, F.inline(listed)).groupBy("name").agg(F.min(F.struct(*order, "column", "i")).alias("first"))
    ranked = written(seen.repartitionByRange("first").sortWithinPartitions("first").select("name", "first", F.spark_partition_id().alias("part")), "names")
    # names before each partition, then a name's place within its own: no task sees them all, the driver one number a partition
    counts = {r.part: r.n for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [(part, sum(n for other, n in counts.items() if other < part)) for part in counts]
    before = items.sparkSession.createDataFrame(starts, "part int, before long")
    within = F.row_number().over(W.partitionBy("part").orderBy("first"))
    return ranked.withColumn("within", within).join(before, "part").select("name", (F.col("before") + F.col("within") - 1).cast("int").alias("place"))


def open_lines(items: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], header: DataFrame | None = None) -> DataFrame:
    """(order…, line): a CSV line for every item with a cell for every name of `open_header`, empty where the item has no such key.

    Each entry finds its place by a join on its name; cells are laid out per item, so a line is as long as the
    header, as CSV has it, and nothing else is.  Names are told the driver nowhere.
    """
    header = written(header if header is not None else open_header(items, columns, order), "header")

    def entries_of(c):
        found = F.filter(F.map_entries(F.col(f"`{c}`")), lambda e: e["key"].isNotNull())
        return F.transform(found, lambda e: F.struct(F.concat(F.lit(f"{c}."), e["key"]).alias("name"), e["value"].cast("string").alias("value")))

    none = F.array().cast("array<struct<name:string,value:string>>")
    entries = F.flatten(F.array(*[F.coalesce(entries_of(c), none) for c in columns]))
    cells = items.select(*order, F.inline_outer(entries)).join(header, "name", "left")
    held = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", csv_cell(F.col("value")).alias("cell")))))
    laid = cells.groupBy(*order).agg(held.alias("held")).withColumn("names", F.lit(header.count()))
    # commas between neighbouring places, then those up to the end
    gap = F.expr("transform(held, (h, i) -> concat(repeat(',', h.place - if(i = 0, 0, get(held, i - 1).place)), h.cell))")
    last = F.expr("repeat(',', cast(greatest(names - 1 - coalesce(get(held, size(held) - 1).place, 0), 0) AS int))")
    return laid.select(*order, F.concat(F.array_join(gap, ""), last).alias("line"))


def csv_cell(value: Column) -> Column:
    """A value as a CSV cell: quoted where it holds a comma, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(value, F.lit(r'[",\r\n]')), quoted).otherwise(F.coalesce(value, F.lit("")))


def write_open_csv(items: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...], mode: str = "errorifexists") -> None:
    """Lines below ``path``/lines, the names with their places below ``path``/header."""
    header = written(open_header(items, columns, order), "header")
    open_lines(items, columns, order, header).select("line").write.mode(mode).text(f"{path}/lines")
    header.repartitionByRange("place").sortWithinPartitions("place").write.mode(mode).json(f"{path}/header")


def _leaf(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        nested = isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType))
        return F.array_join(F.transform(value, lambda v: F.to_json(v)) if nested else value.cast("array<string>"), "; ")
    return value


def flatten(items: DataFrame, keys_of_maps: dict[str, list[str]] | None = None) -> DataFrame:
    """Nested items to flat columns with dotted names; arrays are joined with ``'; '``.

    A map needs the keys to be known (``map_keys``); without them it becomes JSON.
    """
    keys_of_maps = keys_of_maps or {}
    columns: list[Column] = []

    def add(name: str, value: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                add(f"{name}.{f.name}", value.getField(f.name), f.dataType)
        elif isinstance(kind, T.MapType) and name in keys_of_maps:
            for key in keys_of_maps[name]:
                add(f"{name}.{key}", F.try_element_at(value, F.lit(key)), kind.valueType)
        elif isinstance(kind, T.MapType):
            columns.append(F.to_json(value).alias(name))
        else:
            columns.append(_leaf(value, kind).alias(name))

    for f in items.schema.fields:
        add(f.name, F.col(f"`{f.name}`"), f.dataType)
    return items.select(*columns)


def flat_names(items: DataFrame, keys_of_maps: dict[str, list[str]] | None = None) -> list[str]:
    """Header of the flat form."""
    return flatten(items, keys_of_maps).columns


def write_items(
    items: DataFrame, path: str, format: str = "json", summary: DataFrame | None = None,
    by_strategy: str | None = None, mode: str = "errorifexists",
) -> None:
    """Write items, and a run summary next to them if given.

    ``by_strategy`` names a column whose values become subfolders.
    """
    if format not in ("json", "csv", "xml", "parquet"):
        raise ValueError(f"unsupported export format: {format}")
    out = flatten(items) if format == "csv" else items
    writer = out.write.mode(mode)
    if by_strategy:
        writer = writer.partitionBy(by_strategy)
    target = f"{path}/items" if summary is not None else path
    if format == "csv":
        # outer blanks belong to the values
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(target)
    elif format == "xml":
        writer.format("xml").option("rowTag", "item").option("rootTag", "items").save(target)
    else:
        writer.format(format).save(target)
    if summary is not None:
        summary.write.mode(mode).json(f"{path}/run_summary")


def read_items(spark: SparkSession, path: str, schema: str | T.StructType, format: str = "json") -> DataFrame:
    """Items as `write_items` wrote them, outer blanks and line ends of texts included (nested CSV columns stay text)."""
    options = {
        "csv": {"header": True, "escape": '"', "multiLine": True},
        "xml": {"rowTag": "item", "ignoreSurroundingSpaces": False},
    }
    if format not in ("json", "csv", "xml", "parquet"):
        raise ValueError(f"unsupported export format: {format}")
    return spark.read.schema(schema).format(format).options(**options.get(format, {})).load(path)


def write_rules(rules: DataFrame, path: str, mode: str = "errorifexists", by_job: str | None = None) -> None:
    """Validation rules (field, type, required, …) as JSON, with ``by_job`` in one folder per job."""
    writer = rules.write.mode(mode)
    (writer.partitionBy(by_job) if by_job else writer).json(path)
