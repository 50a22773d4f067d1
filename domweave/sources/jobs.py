"""Job configurations as JSON: tables of jobs, and configuration files as the user interface exports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domweave.operators.jobs import JOB_SCHEMA


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs with the declared schema; options a file leaves out are null."""
    return spark.read.schema(JOB_SCHEMA).json(path)


def write_jobs(jobs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    jobs.write.mode(mode).json(path)


def _camel(name: str) -> str:
    """``max_pages`` as the exported files spell it; an expression is spelt XPath at the end of a name."""
    head, *rest = name.split("_")
    joined = head + "".join(w.capitalize() for w in rest)
    return joined.removesuffix("Xpath") + "XPath" if joined.endswith("Xpath") else joined


def _spelt(field: str) -> str:
    return {"pagination": "paginationConfig"}.get(field, _camel(field))


def _option(value: Column, path: str, kind: T.DataType) -> Column:
    """An option of a configuration; numbers may be strings, of which the leading digits count."""
    text = F.try_variant_get(value, path, "string")
    if isinstance(kind, T.BooleanType):
        return F.try_variant_get(value, path, "boolean")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.nullif(F.regexp_extract(text, r"^\s*(-?[0-9]+)", 1), F.lit("")).try_cast(kind)
    return text


def _entry(value: Column, kind: T.StructType, short: str) -> Column:
    """A selector: an object, or a string that stands for its ``short`` field alone."""
    plain = F.schema_of_variant(value) == "STRING"
    return F.struct(*[
        F.when(~plain, _option(value, f"$.{f.name}", f.dataType))
        .otherwise(F.try_variant_get(value, "$", "string") if f.name == short else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in kind.fields])


def jobs_from_json(configs: DataFrame, text: str = "value") -> DataFrame:
    """Jobs from a column of exported configurations; the other columns stay.

    Names are in camel case, selector arrays may mix strings and objects, numbers may be strings.  What is not
    a JSON object has its text in ``corrupt`` and no options.
    """
    kinds = configs.sparkSession.createDataFrame([], JOB_SCHEMA).schema
    parsed = configs.withColumn("_config", F.try_parse_json(F.col(text)))
    config = F.col("_config")
    columns = []
    for f in kinds.fields:
        path = f"$.{_spelt(f.name)}"
        if isinstance(f.dataType, T.ArrayType):
            listed = F.try_variant_get(config, path, "array<variant>")
            short = "xpath" if f.name == "xpath_selectors" else "tag"
            value = _entries(listed, f.dataType.elementType, short)
        elif isinstance(f.dataType, T.StructType):
            inner = [_option(config, f"{path}.{_camel(g.name)}", g.dataType).alias(g.name) for g in f.dataType.fields]
            value = F.when(F.try_variant_get(config, path, "variant").isNotNull(), F.struct(*inner))
        else:
            value = _option(config, path, f.dataType)
        columns.append(value.alias(f.name))
    kept = [c for c in configs.columns if c != text and c not in kinds.names]
    corrupt = F.when(~F.coalesce(F.startswith(F.schema_of_variant(config), F.lit("OBJECT")), F.lit(False)), F.col(text))
    return parsed.select(*kept, *columns, corrupt.alias("corrupt"))


def _entries(listed: Column, kind: T.StructType, short: str) -> Column:
    return F.transform(listed, lambda v: _entry(v, kind, short))


def read_exported_jobs(spark: SparkSession, path: str) -> DataFrame:
    """One job for each exported configuration file; where a file names no job its path's hash does."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return jobs_from_json(files).withColumn("job_id", F.coalesce("job_id", F.xxhash64("path")))


def _json(value: Column) -> Column:
    """A scalar in JSON."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^.|.$", "")


def exported_json(jobs: DataFrame) -> Column:
    """The configuration of each job as the user interface exports it; a selector with nothing but its short form is a string."""
    kinds = jobs.schema

    def selector(entry: Column, kind: T.StructType, short: str) -> Column:
        others = [f.name for f in kind.fields if f.name != short]
        only = F.lit(True)
        for name in others:
            only = only & entry[name].isNull()
        return F.when(only & entry[short].isNotNull(), _json(entry[short])).otherwise(F.to_json(entry))

    parts = []
    for f in kinds.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            short, kind = ("xpath" if f.name == "xpath_selectors" else "tag"), f.dataType.elementType
            text = F.concat(F.lit("["), F.array_join(_texts(value, kind, short, selector), ","), F.lit("]"))
        elif isinstance(f.dataType, T.StructType):
            text = F.to_json(F.struct(*[value[g.name].alias(_camel(g.name)) for g in f.dataType.fields]))
        else:
            text = _json(value)
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{_spelt(f.name)}":'), text)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _texts(values: Column, kind: T.StructType, short: str, selector) -> Column:
    return F.transform(values, lambda e: selector(e, kind, short))
