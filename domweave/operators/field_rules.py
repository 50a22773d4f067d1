"""Validation with rules as data: items as (field, value) rows, checked against a table of rules of their job.

``validate`` writes one schema into the plan.  Here every job has its own rules, as rows
(job, field, type, required, min_length, max_length), and one plan checks the values of any number of
jobs.  Values are texts, as extraction gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domweave.functions import text
from domweave.functions.skew import join_per_key
from domweave.operators.validate import ISSUE, _issue, _only, validation_stats
from domweave.session import written


def _by_type(kind: Column, of, types, otherwise: Column) -> Column:
    chain = F
    for name in types:
        chain = chain.when(kind == name, of(name))
    return chain.otherwise(otherwise)


def check_value(value: Column, cleaned: Column, name: Column, kind: Column, required: Column, low: Column, high: Column) -> Column:
    """``struct(cleaned, was_cleaned, errors, warnings)`` of one value whose rule is in columns; as `check_field` for texts."""
    empty = text.is_empty(value)
    known = kind.isin([*text.FORMATS, "html"])
    changed = kind.isin(list(text.CLEANED_TYPES)) & ~cleaned.eqNullSafe(value)
    good = _by_type(kind, lambda t: text.matches_format(cleaned, t), list(text.FORMATS), F.lit(True))
    size = F.length(cleaned)
    least, most = (F.coalesce(F.nullif(c, F.lit(0)), F.lit(d)) for c, d in ((low, text.DEFAULT_MIN_LENGTH), (high, text.DEFAULT_MAX_LENGTH)))
    warnings = [
        F.when(changed, _issue("warning", "cleaned", name, value, cleaned)),
        F.when((kind != "") & ~known, _issue("warning", "unknown_type", name, None, kind)),
    ]
    errors = [
        F.when(~good, _issue("error", "format", name, cleaned, kind)),
        F.when(size < least, _issue("error", "min_length", name, size.cast("string"), least.cast("string"))),
        F.when(size > most, _issue("error", "max_length", name, size.cast("string"), most.cast("string"))),
    ]
    nothing = F.array().cast(f"array<{ISSUE}>")
    missing = F.when(required, _only(_issue("error", "required", name))).otherwise(nothing)
    return F.struct(
        F.when(empty, value).otherwise(cleaned).alias("cleaned"), (~empty & F.coalesce(changed, F.lit(False))).alias("was_cleaned"),
        F.when(empty, missing).otherwise(_only(*errors)).alias("errors"), F.when(empty, nothing).otherwise(_only(*warnings)).alias("warnings"))


def sample_rules_of(values: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("item_no",)) -> DataFrame:
    """(job, field, type, required, min_length, max_length) from the first item of each job.

    The first item is a mergeable minimum, so a job of any size is one row per task.
    """
    first = values.groupBy(job).agg(F.min(F.struct(*order)).alias("first")).select(job, "first.*")
    rule = text.infer_field(F.col("value"), F.col("field"))
    return values.join(first, [job, *order]).select(job, "field", rule.alias("rule")).select(
        job, "field", "rule.type", F.lit(False).alias("required"), "rule.min_length", "rule.max_length")


def check_values(values: DataFrame, rules: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("item_no",)) -> DataFrame:
    """(job, order…, fields, errors, warnings, is_valid, was_cleaned), one row per item; ``fields`` maps names to cleaned values.

    A field without a rule has no type and default lengths; a required field that an item
    does not have is missing.  A hot job's values are spread over tasks until its items are put together; an
    item is as large as its own values.
    """
    kept = rules.select(job, "field", "type", "required", "min_length", "max_length")
    ruled = join_per_key(values, kept, [job, "field"], list(order), "left")
    kind = F.coalesce("type", F.lit(""))
    cleaned = _by_type(kind, lambda t: text.clean(F.col("value"), t), text.CLEANED_TYPES, F.col("value"))
    checked = ruled.withColumn("_cleaned", cleaned).withColumn("c", check_value(
        F.col("value"), F.col("_cleaned"), F.col("field"), kind, F.coalesce("required", F.lit(False)), F.col("min_length"), F.col("max_length")))
    # empty values of an item that are not required stay as they are; failed ones are left out
    entry = F.when(F.size("c.errors") == 0, F.struct(F.col("field"), F.col("c.cleaned").alias("value")))
    fine = F.size("c.errors") == 0
    items = checked.groupBy(job, *order).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.collect_set("field").alias("present"),
        F.sort_array(F.flatten(F.collect_list("c.errors"))).alias("errors"), F.sort_array(F.flatten(F.collect_list("c.warnings"))).alias("warnings"),
        F.bool_or(F.col("c.was_cleaned") & fine).alias("was_cleaned"))
    needed = rules.where("required").groupBy(job).agg(F.sort_array(F.collect_set("field")).alias("needed"))
    absent = F.transform(F.array_except(F.coalesce("needed", F.array().cast("array<string>")), "present"), lambda f: _issue("error", "missing", f))
    whole = join_per_key(items, needed, [job], list(order), "left").withColumn("errors", F.concat("errors", absent))
    return whole.select(
        job, *order, F.map_from_entries("entries").alias("fields"), "errors", "warnings", (F.size("errors") == 0).alias("is_valid"), "was_cleaned")


def apply_rules(
    values: DataFrame, rules: DataFrame | None = None, job: str = "job_id", order: tuple[str, ...] = ("item_no",),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, messages, stats) like `apply_validation`, for the rules of every job; without rules its first item decides.

    ``items`` has (job, order…, fields, is_valid): cleaned valid items, and all items as they came for jobs without a valid one.
    An invalid job's messages are its errors with a critical one in front, a valid job's are its warnings.
    """
    checked = written(check_values(values, rules if rules is not None else sample_rules_of(values, job, order), job, order), "checked")
    stats = written(validation_stats(checked, job), "stats")
    verdicts = stats.select(job, F.col("is_valid").alias("job_ok"), (F.col("valid_items") == 0).alias("keeps_all"))
    judged = join_per_key(checked, verdicts, [job], list(order), "inner")
    kept = judged.where(F.col("is_valid") & ~F.col("keeps_all")).select(job, *order, "fields", "is_valid")
    without = verdicts.where("keeps_all").select(job)
    original = join_per_key(values, without, [job], list(order), "left_semi").groupBy(job, *order).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields")).withColumn("is_valid", F.lit(False))
    listed = F.when(F.col("job_ok"), F.col("warnings")).otherwise(F.col("errors"))
    messages = judged.select(job, *order, F.posexplode_outer(listed).alias("issue_no", "issue")).where(F.col("issue").isNotNull()).select(
        job, *order, "issue_no", "issue.*")
    critical = stats.where(~F.col("is_valid")).select(
        job, *[F.lit(None).cast(values.schema[o].dataType).alias(o) for o in order], F.lit(-2).alias("issue_no"), F.lit("error").alias("severity"),
        F.lit("critical").alias("type"), F.lit("").alias("field"), F.col("invalid_percent").cast("string").alias("value"), F.lit(None).cast("string").alias("detail"))
    return kept.unionByName(original), critical.unionByName(messages), stats
