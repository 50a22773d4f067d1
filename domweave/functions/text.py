"""Cleaning, format tests and type inference as plain column expressions.

White space and digits are spelled out: Java's ``\\s`` is ASCII, ``$`` also stops
before a final newline, and repeated groups recurse, so patterns here use an
explicit blank class, ``\\z`` and possessive repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as JavaScript trims it (fixed values), as characters and as a class.
BLANK = (
    "\t\n\v\f\r \u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = r"\t\n\u000B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Formats, character classes and limits that decide results.
CURRENCY = "$€£¥₽"
FORMATS = {
    "email": rf"^[^{WS}@]++@[^{WS}@]+\.[^{WS}@]+\z",
    "phone": rf"^\+?[0-9{WS}\-()]{{7,15}}\z",
    "url": r"^https?://(www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"[-a-zA-Z0-9()@:%_+.~#?&/=]*\z",
    "price": rf"^[{CURRENCY}]?[{WS}]*+[0-9]++([.,][0-9]++)*+\z",
    "date": r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}\z|^[0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2}\z",
    "number": r"^[0-9]++([.,][0-9]++)?\z",
    "text": rf"^[a-zA-Zа-яА-ЯёЁ{WS}\-.,!?]++\z",
    "coordinate": r"^-?[0-9]++\.[0-9]++\z",
}
CLEANED_TYPES = ("text", "html", "price", "phone", "email")
DEFAULT_MIN_LENGTH, DEFAULT_MAX_LENGTH = 1, 10000
# type, part of a field name that implies it, minimum and maximum length
INFERRED = [
    ("email", "email", 5, 254),
    ("phone", "phone", 7, 20),
    ("url", "url", 10, 2048),
    ("price", "price", 1, 20),
    ("date", "date", 8, 20),
    ("number", None, 1, 50),
    ("html", None, 1, 5000),
]
INFERRED_TEXT = ("text", 1, 1000)
INFERRED_ARRAY = ("array", 0, 200)
HTML_ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]


def trim(value: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(value, F.lit(BLANK))


def _collapse(value: Column) -> Column:
    """Every run of white space to one space."""
    spaced = F.translate(value, BLANK, " " * len(BLANK))
    return F.regexp_replace(spaced, " {2,}+", " ")


def is_empty(value: Column) -> Column:
    return value.isNull() | (value.cast("string") == "")


def truthy(value: Column, kind: T.DataType) -> Column:
    """Filled in the sense of the relationship rules: not null, '', 0, false or NaN."""
    if isinstance(kind, T.StringType):
        filled = value != ""
    elif isinstance(kind, T.BooleanType):
        filled = value
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        filled = (value != 0) & ~F.isnan(value)
    elif isinstance(kind, T.NumericType):
        filled = value != 0
    else:
        filled = value.isNotNull()
    return F.coalesce(filled, F.lit(False))


# ---- cleaning ----------------------------------------------------------------


def _clean_text(value: Column) -> Column:
    spaced = trim(_collapse(value))
    return trim(F.regexp_replace(spaced, r"[^A-Za-z0-9_ а-яА-ЯёЁ\-.,!?]++", ""))


def _drop_tags(value: Column) -> Column:
    # Nothing after the last '>' can be a tag; leaving that part alone keeps the
    # replacement linear when a text holds many unclosed '<'.
    tail = F.substring_index(value, ">", -1)
    head = F.substring(value, F.lit(1), F.length(value) - F.length(tail))
    return F.concat(F.regexp_replace(head, r"<[^>]*+>", ""), tail)


def _clean_html(value: Column) -> Column:
    for tag in ("script", "style"):
        value = F.regexp_replace(value, rf"(?is)<{tag}(?![A-Za-z0-9_]).*?</{tag}>", "")
    value = _drop_tags(value)
    for entity, character in HTML_ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(character))
    return trim(value)


def _clean_price(value: Column) -> Column:
    return F.translate(F.regexp_replace(value, rf"[^0-9.,{CURRENCY}]++", ""), ",", ".")


def _clean_phone(value: Column) -> Column:
    kept = F.regexp_replace(value, rf"[^0-9+\-(){WS}]++", "")
    return trim(_collapse(kept))


def _clean_email(value: Column) -> Column:
    return F.translate(value, BLANK, "")


_CLEANERS = {
    "text": _clean_text,
    "html": _clean_html,
    "price": _clean_price,
    "phone": _clean_phone,
    "email": _clean_email,
}


def clean(value: Column, kind: str) -> Column:
    """Clean a string column as ``kind``; kinds without a rule pass through."""
    return _CLEANERS[kind](value) if kind in _CLEANERS else value


# ---- formats and inference -----------------------------------------------------


def has_tag(value: Column) -> Column:
    """A '<' with a '>' somewhere after it."""
    opened = F.instr(value, "<")
    return (opened > 0) & F.contains(F.substring(value, opened, F.length(value)), F.lit(">"))


def matches_format(value: Column, kind: str) -> Column:
    """Format test; null for a kind that has none."""
    if kind == "html":
        return has_tag(value)
    if kind not in FORMATS:
        return F.lit(None).cast("boolean")
    return F.rlike(value, F.lit(FORMATS[kind]))


def infer_field(value: Column, name: Column, kind: T.DataType = T.StringType()) -> Column:
    """``struct(type, min_length, max_length)`` from a value and its field name."""

    def rule(type_name, low, high):
        return F.struct(
            F.lit(type_name).alias("type"),
            F.lit(low).cast("int").alias("min_length"),
            F.lit(high).cast("int").alias("max_length"),
        )

    if isinstance(kind, T.StringType):
        lowered = F.lower(name)

        def add(chain, entry):
            type_name, part, low, high = entry
            hit = matches_format(value, type_name)
            if part:
                hit = hit | F.contains(lowered, F.lit(part))
            return (F if chain is None else chain).when(hit, rule(type_name, low, high))

        known = reduce(add, INFERRED, None).otherwise(rule(*INFERRED_TEXT))
        return F.when(value.isNotNull(), known).otherwise(rule("object", None, None))
    if isinstance(kind, T.BooleanType):
        fixed = rule("boolean", None, None)
    elif isinstance(kind, T.NumericType):
        fixed = rule("number", 1, 50)
    elif isinstance(kind, T.ArrayType):
        fixed = rule(*INFERRED_ARRAY)
    else:
        return rule("object", None, None)
    return F.when(value.isNotNull(), fixed).otherwise(rule("object", None, None))


_EMAIL, _WEB = FORMATS["email"], r"^https?://"


def preview_type(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """Value type in preview order: html, number, url, email, text."""
    if isinstance(kind, T.StringType):
        named = (
            F.when(F.contains(value, F.lit("<")) & F.contains(value, F.lit(">")), "html")
            .when(F.rlike(value, F.lit(r"^[0-9]++\z")), "number")
            .when(F.rlike(value, F.lit(_WEB)), "url")
            .when(F.rlike(value, F.lit(_EMAIL)), "email")
            .otherwise("text")
        )
    elif isinstance(kind, T.NumericType):
        named = F.lit("number")
    elif isinstance(kind, T.BooleanType):
        named = F.lit("boolean")
    elif isinstance(kind, T.ArrayType):
        named = F.lit("array")
    else:
        named = F.lit("object")
    return F.when(value.isNull(), "null").otherwise(named)


def display_type(value: Column, kind: T.DataType = T.StringType()) -> Column:
    """Value type in schema-export order: url, email, html, text; null counts as text."""
    if isinstance(kind, T.NumericType):
        return F.when(value.isNull(), "text").otherwise("number")
    if isinstance(kind, T.BooleanType):
        return F.when(value.isNull(), "text").otherwise("boolean")
    if not isinstance(kind, T.StringType):
        return F.lit("text")
    return (
        F.when(F.rlike(value, F.lit(_WEB)), "url")
        .when(F.rlike(value, F.lit(_EMAIL)), "email")
        .when(F.contains(value, F.lit("<")) & F.contains(value, F.lit(">")), "html")
        .otherwise("text")
    )


def shorten(value: Column, limit: int = 100) -> Column:
    """Display form: at most ``limit`` characters and an ellipsis."""
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)
