"""Cleaning and checking of item tables.

All field checks of an item are one projection.  Duplicates are found without
gathering equal values anywhere: the first holder of each value is a map-side
combined minimum, and everything that is not a first holder is joined away on the
item key, which is unique and so cannot be skewed however often a value repeats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domweave.functions import text
from domweave.functions.skew import join_per_key
from domweave.session import written

ISSUE = "struct<severity:string,type:string,field:string,value:string,detail:string>"
CRITICAL_RATIO = 0.5  # fixed value: below this share of valid items a data set is invalid


@dataclass(frozen=True)
class FieldRule:
    """How one field is cleaned and checked.

    ``validator`` maps the cleaned column to a boolean column (a Pandas UDF works too).
    A length of 0 counts as not given.
    """

    type: str | None = None
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    validator: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Relation:
    """required_together, mutually_exclusive or conditional (``condition``: columns by name → boolean)."""

    type: str
    fields: tuple[str, ...] = ()
    condition: Callable[[dict[str, Column]], Column] | None = None


@dataclass(frozen=True)
class Schema:
    fields: dict[str, FieldRule]
    relations: tuple[Relation, ...] = ()
    unique_fields: tuple[str, ...] = ()
    include_invalid: bool = False
    strict_html: bool = False  # True: test html after its tags were cleaned away, which then fails


def _issue(severity: str, type_: str, name, value=None, detail=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(type_).alias("type"),
        (F.lit(name) if isinstance(name, str) else name).alias("field"),
        (none if value is None else value.cast("string")).alias("value"),
        (none if detail is None else detail).alias("detail"),
    )


def _only(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull()) if issues else F.array().cast(f"array<{ISSUE}>")


def check_field(
    value: Column, cleaned: Column, rule: FieldRule, name: str, kind: T.DataType, strict_html: bool = False
) -> Column:
    """``struct(cleaned, was_cleaned, errors, warnings)`` of one field of one item.

    ``cleaned`` should be a column of its own (an earlier select): it is used many
    times here and would otherwise be computed as often.
    """
    is_text = isinstance(kind, T.StringType)
    empty = text.is_empty(value) if is_text else value.isNull()
    changed = ~cleaned.eqNullSafe(value) if is_text and rule.type in text.CLEANED_TYPES else F.lit(False)
    errors, warnings = [], [F.when(changed, _issue("warning", "cleaned", name, value, cleaned.cast("string")))]
    known = rule.type == "html" or rule.type in text.FORMATS
    if rule.type and not known:
        warnings.append(_issue("warning", "unknown_type", name, None, F.lit(rule.type)))
    if known and is_text and (rule.type != "html" or strict_html):
        errors.append(
            F.when(
                ~text.matches_format(cleaned, rule.type),
                _issue("error", "format", name, cleaned, F.lit(rule.type)),
            )
        )
    if is_text:
        low = rule.min_length or text.DEFAULT_MIN_LENGTH
        high = rule.max_length or text.DEFAULT_MAX_LENGTH
        size = F.length(cleaned)
        shown = size.cast("string")
        errors.append(F.when(size < low, _issue("error", "min_length", name, shown, F.lit(str(low)))))
        errors.append(F.when(size > high, _issue("error", "max_length", name, shown, F.lit(str(high)))))
    if rule.validator is not None:
        errors.append(F.when(~F.coalesce(rule.validator(cleaned), F.lit(False)), _issue("error", "custom", name, cleaned)))
    nothing = F.array().cast(f"array<{ISSUE}>")
    missing = _only(_issue("error", "required", name)) if rule.required else nothing
    return F.struct(
        F.when(empty, value).otherwise(cleaned).alias("cleaned"),
        F.when(empty, F.lit(False)).otherwise(changed).alias("was_cleaned"),
        F.when(empty, missing).otherwise(_only(*errors) if errors else nothing).alias("errors"),
        F.when(empty, nothing).otherwise(_only(*warnings)).alias("warnings"),
    )


def _relation_issue(relation: Relation, columns: dict[str, Column], filled: dict[str, Column]) -> Column:
    present = [F.when(filled[f], F.lit(f)) for f in relation.fields]
    count = F.size(F.array_compact(F.array(*present))) if present else F.lit(0)
    listed = F.array_join(F.array_compact(F.array(*present)), ", ") if present else F.lit("")
    if relation.type == "required_together":
        everything = F.lit(", ".join(relation.fields))
        return F.when(
            (count > 0) & (count < len(relation.fields)), _issue("error", relation.type, "", None, everything)
        )
    if relation.type == "mutually_exclusive":
        return F.when(count > 1, _issue("error", relation.type, "", None, listed))
    if relation.type == "conditional" and relation.condition is not None:
        return F.when(~F.coalesce(relation.condition(columns), F.lit(False)), _issue("error", relation.type, ""))
    return F.lit(None).cast(ISSUE)


def check_items(
    items: DataFrame, schema: Schema, keys: tuple[str, ...] = ("job_id", "item_no"), corrupt: str | None = None
) -> DataFrame:
    """Keys, cleaned fields, ``errors``, ``warnings``, ``is_valid`` and ``was_cleaned`` per item.

    ``corrupt`` names a column that is set where the source row was no record at all
    (``_corrupt_record`` of a permissive read): a structure error.
    """
    kinds = {f.name: f.dataType for f in items.schema.fields}
    names = [c for c in items.columns if c not in keys and c != corrupt]
    rules = {n: schema.fields.get(n, FieldRule()) for n in names}
    kept = [*keys, *([corrupt] if corrupt else [])]
    cleaned = items.select(
        *kept,
        *[F.col(f"`{n}`").alias(f"v{i}") for i, n in enumerate(names)],
        *[
            text.clean(F.col(f"`{n}`"), rules[n].type).alias(f"k{i}")
            for i, n in enumerate(names)
            if isinstance(kinds[n], T.StringType) and rules[n].type
        ],
    )
    checks = [
        check_field(
            F.col(f"v{i}"), F.col(f"k{i}" if f"k{i}" in cleaned.columns else f"v{i}"), rules[n], n, kinds[n],
            schema.strict_html,
        ).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    absent = [
        _issue("error", "missing", n) for n, rule in schema.fields.items() if rule.required and n not in names
    ]
    # out of a generator, as a filter on the verdict would else be pushed below and hold every check many times over
    checked = cleaned.select(*kept, F.inline(F.array(F.struct(*checks))))
    fields = {n: F.when(F.size(f"c{i}.errors") == 0, F.col(f"c{i}.cleaned")) for i, n in enumerate(names)}
    wide = checked.select(
        *kept,
        *[c.alias(n) for n, c in fields.items()],
        F.concat(*[F.col(f"c{i}.errors") for i in range(len(names))], _only(*absent)).alias("errors"),
        F.concat(*[F.col(f"c{i}.warnings") for i in range(len(names))]).alias("warnings"),
        reduce(or_, [F.col(f"c{i}.was_cleaned") & (F.size(f"c{i}.errors") == 0) for i in range(len(names))]).alias(
            "was_cleaned"
        ),
    )
    columns = {n: F.col(f"`{n}`") for n in names}
    filled = {n: text.truthy(columns[n], kinds[n]) for n in names}
    for relation in schema.relations:
        for f in relation.fields:
            filled.setdefault(f, F.lit(False))
    broken = [_relation_issue(r, columns, filled) for r in schema.relations]
    errors = F.concat("errors", _only(*broken)) if broken else F.col("errors")
    if corrupt:
        errors = F.when(
            F.col(corrupt).isNotNull(), _only(_issue("error", "structure", "", F.col(corrupt)))
        ).otherwise(errors)
    wide = wide.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)
    return wide.drop(corrupt) if corrupt else wide


def duplicate_issues(
    items: DataFrame, unique_fields: tuple[str, ...], job: str = "job_id", order: tuple[str, ...] = ("item_no",)
) -> DataFrame:
    """Second and later occurrences of a value within a job: (job, order…, field, value).

    Long values are grouped by their SHA-256 digest so that texts are not shuffled.
    """
    kinds = {f.name: f.dataType for f in items.schema.fields}
    entries = F.array(*[
        F.when(
            text.truthy(F.col(f"`{f}`"), kinds[f]),
            F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")),
        )
        for f in unique_fields
    ])
    held = (
        items.select(job, *order, F.explode_outer(entries).alias("entry"))
        .where(F.col("entry").isNotNull())
        .select(job, *order, "entry.*")
    )
    digest = F.sha2(F.col("value"), 256)
    # a single number can be reduced in a hash table, a struct needs a sort
    earliest = F.min(order[0]).alias(order[0]) if len(order) == 1 else F.min(F.struct(*order)).alias("first")
    first = held.groupBy(job, "field", digest.alias("digest")).agg(earliest)
    holders = first.select(job, "field", order[0] if len(order) == 1 else "first.*")
    return held.join(holders, [job, *order, "field"], "left_anti")


def validation_stats(checked: DataFrame, job: str = "job_id") -> DataFrame:
    """Counters and verdict per job."""
    stats = checked.groupBy(job).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if("is_valid").alias("valid_items"),
        F.count_if(~F.col("is_valid")).alias("invalid_items"),
        F.count_if(F.col("is_valid") & F.col("was_cleaned")).alias("cleaned_items"),
    )
    ratio = F.try_divide(F.col("valid_items"), F.col("total_items"))
    verdict = ~F.coalesce(ratio < CRITICAL_RATIO, F.lit(False))
    return stats.withColumn("is_valid", verdict).withColumn(
        "invalid_percent", F.when(~verdict, F.round((1 - ratio) * 100).cast("int"))
    )


def issue_rows(checked: DataFrame, keys: tuple[str, ...] = ("job_id", "item_no")) -> DataFrame:
    """Errors and warnings of checked items, one row each, ``issue_no`` within the item."""
    return (
        checked.select(*keys, F.posexplode_outer(F.concat("errors", "warnings")).alias("issue_no", "issue"))
        .where(F.col("issue").isNotNull())
        .select(*keys, "issue_no", "issue.*")
    )


def validate(
    items: DataFrame, schema: Schema, job: str = "job_id", order: tuple[str, ...] = ("item_no",),
    corrupt: str | None = None, materialize: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned items, issues, stats) of an item table; the scope of uniqueness is one job.

    The three results share the checked items.  ``materialize=True`` writes those once
    to the shared folder, which pays when more than one result is used.
    """
    keys = (job, *order)
    checked = check_items(items, schema, keys, corrupt)
    if materialize:
        checked = written(checked, "checked")
    kept = checked if schema.include_invalid else checked.where("is_valid")
    cleaned = kept.drop("errors", "warnings", "is_valid", "was_cleaned")
    issues = issue_rows(checked, keys)
    if schema.unique_fields:
        repeated = duplicate_issues(checked, schema.unique_fields, job, order).select(
            *keys, F.lit(-1).alias("issue_no"), F.lit("warning").alias("severity"), F.lit("duplicate").alias("type"),
            "field", "value", F.lit(None).cast("string").alias("detail"),
        )
        issues = issues.unionByName(repeated)
    stats = validation_stats(checked, job)
    return cleaned, issues, stats


def apply_validation(
    items: DataFrame, schema: Schema | None = None, job: str = "job_id", order: tuple[str, ...] = ("item_no",),
    materialize: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace items by their cleaned form and list what was found.

    Where a job is invalid its issues are errors with a critical one in front; where
    it is valid only the warnings are kept.  A job without any valid item keeps its
    original items.  Without a schema the first item decides (``schema_from_sample``).
    """
    schema = schema or schema_from_sample(items, job, order)
    cleaned, issues, stats = validate(items, schema, job, order, materialize=materialize)
    verdicts = stats.select(job, F.col("is_valid").alias("job_ok"))
    without = stats.where(F.col("valid_items") == 0).select(job)
    spread = list(order)
    original = join_per_key(items, without, [job], spread, "left_semi")
    result = join_per_key(cleaned, without, [job], spread, "left_anti").unionByName(original, allowMissingColumns=True)
    kept = join_per_key(issues, verdicts, [job], spread, "inner").where(
        F.when(F.col("job_ok"), F.col("severity") == "warning").otherwise(F.col("severity") == "error")
    )
    critical = stats.where(~F.col("is_valid")).select(
        job, *[F.lit(None).cast(items.schema[o].dataType).alias(o) for o in order],
        F.lit(-2).alias("issue_no"), F.lit("error").alias("severity"), F.lit("critical").alias("type"),
        F.lit("").alias("field"), F.col("invalid_percent").cast("string").alias("value"),
        F.lit(None).cast("string").alias("detail"),
    )
    return result, critical.unionByName(kept.drop("job_ok")), stats


def error_histogram(issues: DataFrame, job: str = "job_id") -> DataFrame:
    """Errors per type."""
    return (
        issues.where(F.col("severity") == "error").groupBy(job, "type").agg(F.count(F.lit(1)).alias("errors"))
    )


def error_sample(issues: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("item_no",), limit: int = 5):
    """First errors of each job.  The rank filter lets Spark cut each partition before the shuffle."""
    rank = F.row_number().over(W.partitionBy(job).orderBy(*order, "issue_no"))
    return issues.where(F.col("severity") == "error").withColumn("rank", rank).where(F.col("rank") <= limit)


# ---- schemas from data --------------------------------------------------------------


def inferred_types(items: DataFrame, keys: tuple[str, ...] = ("job_id", "item_no")) -> DataFrame:
    """(keys, field, type, min_length, max_length) of every value of every item."""
    kinds = {f.name: f.dataType for f in items.schema.fields}
    names = [c for c in items.columns if c not in keys]
    inferred = [
        F.struct(F.lit(n).alias("field"), text.infer_field(F.col(f"`{n}`"), F.lit(n), kinds[n]).alias("rule"))
        for n in names
    ]
    return items.select(*keys, F.inline(F.array(*inferred))).select(*keys, "field", "rule.*")


def sample_rules(items: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("item_no",)) -> DataFrame:
    """Rules of each job from its first item, as a table."""
    names = [c for c in items.columns if c not in (job, *order)]
    first = items.groupBy(job).agg(F.min_by(F.struct(*[f"`{n}`" for n in names]), F.struct(*order)).alias("sample"))
    return inferred_types(first.select(job, "sample.*"), (job,)).withColumn("required", F.lit(False))


def schema_from_sample(items: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("item_no",)) -> Schema:
    """Schema from the first item of all (one row reaches the driver)."""
    names = [c for c in items.columns if c not in (job, *order)]
    first = items.orderBy(job, *order).limit(1)
    found = inferred_types(first.select(*names), ()).collect()  # one row per column
    return Schema({r["field"]: FieldRule(r["type"], False, r["min_length"], r["max_length"]) for r in found})


def column_profile(items: DataFrame, keys: tuple[str, ...] = ("job_id", "item_no")) -> DataFrame:
    """How many values of each field have which inferred type."""
    return inferred_types(items, keys).groupBy("field", "type").agg(F.count(F.lit(1)).alias("values"))


def schema_from_profile(profile: DataFrame) -> DataFrame:
    """Most frequent type of each field (ties by name): the all-rows form of a sample schema."""
    best = F.max_by("type", F.struct("values", "type"))
    return profile.groupBy("field").agg(best.alias("type"), F.sum("values").alias("values"))


def missing_fields(fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Required rules without a field, for items stored as (job_id, item_no, field, value).

    ``rules`` is (job_id, field, required).  The few required names are attached to
    each item through its job, then compared with the names the item has.
    """
    needed = (
        rules.where("required").groupBy("job_id").agg(F.sort_array(F.collect_set("field")).alias("needed"))
    )
    present = fields.groupBy("job_id", "item_no").agg(F.collect_set("field").alias("present"))
    return join_per_key(present, needed, ["job_id"], ["item_no"], "inner").select(
        "job_id", "item_no", F.explode(F.array_except("needed", "present")).alias("field")
    )

