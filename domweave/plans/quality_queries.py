"""Queries on cleaning, formats, inference and validation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from domweave.functions import text
from domweave.operators import validate as v
from domweave.plans.registry import query, table
from domweave.sources.pages import read_pages, spread

# white space as a character class of the SQL engine used for checking
WS = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)


def _trim(e):
    return f"regexp_replace(regexp_replace({e}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def clean_sql(e, kind):
    if kind == "text":
        spaced = _trim(f"regexp_replace({e}, '[{WS}]+', ' ', 'g')")
        return _trim(f"regexp_replace({spaced}, '[^A-Za-z0-9_{WS}а-яА-ЯёЁ\\-.,!?]', '', 'g')")
    if kind == "html":
        for tag in ("script", "style"):
            e = f"regexp_replace({e}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
        e = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
        for raw, plain in text.HTML_ENTITIES:
            e = f"replace({e}, '{raw}', '{plain}')"
        return _trim(e)
    if kind == "price":
        return f"replace(regexp_replace({e}, '[^0-9.,$€£¥₽]', '', 'g'), ',', '.')"
    if kind == "phone":
        return _trim(f"regexp_replace(regexp_replace({e}, '[^0-9+\\-(){WS}]', '', 'g'), '[{WS}]+', ' ', 'g')")
    return f"regexp_replace({e}, '[{WS}]', '', 'g')"


FORMAT_SQL = {
    "email": rf"^[^{WS}@]+@[^{WS}@]+\.[^{WS}@]+$",
    "phone": rf"^\+?[0-9{WS}\-()]{{7,15}}$",
    "url": r"^https?://(www\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_+.~#?&/=]*)$",
    "price": rf"^[$€£¥₽]?[{WS}]*[0-9]+([.,][0-9]+)*$",
    "date": r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}$|^[0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2}$",
    "number": r"^[0-9]+([.,][0-9]+)?$",
    "text": rf"^[a-zA-Zа-яА-ЯёЁ{WS}\-.,!?]+$",
    "html": r"<[^>]*>",
    "coordinate": r"^-?[0-9]+\.[0-9]+$",
}


def format_sql(e, kind):
    return f"regexp_matches({e}, '{FORMAT_SQL[kind]}')"


def infer_sql(e, name):
    cases = []
    for kind, part, low, high in text.INFERRED:
        hit = format_sql(e, kind) + (f" OR contains(lower({name}), '{part}')" if part else "")
        cases.append(f"WHEN {hit} THEN '{kind}'")
    return f"CASE {' '.join(cases)} ELSE 'text' END"


# Values of many shapes made from table columns; one row per value.
VALUES_SQL = """
  SELECT c_custkey AS id, field, value FROM customer, LATERAL (VALUES
    ('name', c_name), ('segment', c_mktsegment), ('contact_email', lower(c_mktsegment) || c_custkey || ' @mail.com'),
    ('mail', 'u' || c_custkey || '@x' || (c_custkey % 7) || '.org'), ('call', '+7 (9' || (c_custkey % 100) || ') 123-45-' || (c_custkey % 100)),
    ('iso', '20' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') || '-0' || (1 + c_custkey % 9) || '-15'),
    ('dotted', '15.01.' || (2000 + c_custkey % 30)), ('slashed', '01/02/' || (2000 + c_custkey % 30)),
    ('long_number', CAST(12345678 + c_custkey AS VARCHAR)), ('small', CAST(c_custkey % 50 AS VARCHAR)),
    ('amount', '$' || printf('%.2f', c_acctbal)), ('thousands', '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '.00'),
    ('spaced', '1 ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')), ('home_url', 'https://s' || c_custkey || '.example.com/a?b=' || c_nationkey),
    ('link', 'http://x' || c_custkey || '.io/a?b=c'), ('markup', '<b>' || c_mktsegment || '</b> &amp;lt; x'),
    ('escaped', '&lt;b&gt;' || c_nationkey), ('greeting', 'hello ' || c_nationkey), ('accent', 'café ' || lower(c_mktsegment)),
    ('cyrillic', 'Ёлка и ёж, ' || lower(c_mktsegment) || '!'), ('point', '-12.' || c_custkey), ('nbsp', chr(160) || c_mktsegment || chr(160)),
    ('tabbed', chr(9) || c_mktsegment || chr(10)), ('smile', '😀 ' || c_mktsegment), ('empty', ''),
    ('scripted', '<SCRIPT type="x">if (a<b) {}</script>' || c_nationkey || '<style>p{}</style><br/>'), ('unit_price', c_mktsegment)
  ) AS t(field, value)
"""


def customers(spark, sf_dir):
    """The columns used here, dealt out to as many tasks as a shuffle has.

    The rows are narrow and few files hold them, but each becomes many values and checks: the work is that of CPUs, not of splits.
    """
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return spread(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))


def values(spark, sf_dir):
    k, seg, nation = "c_custkey", "c_mktsegment", "c_nationkey"
    pieces = {
        "name": "c_name",
        "segment": seg,
        "contact_email": f"concat(lower({seg}), {k}, ' @mail.com')",
        "mail": f"concat('u', {k}, '@x', {k} % 7, '.org')",
        "call": f"concat('+7 (9', {k} % 100, ') 123-45-', {k} % 100)",
        "iso": f"concat('20', lpad(string({k} % 30), 2, '0'), '-0', 1 + {k} % 9, '-15')",
        "dotted": f"concat('15.01.', 2000 + {k} % 30)",
        "slashed": f"concat('01/02/', 2000 + {k} % 30)",
        "long_number": f"string(12345678 + {k})",
        "small": f"string({k} % 50)",
        "amount": "concat('$', format_string('%.2f', c_acctbal))",
        "thousands": f"concat('1,', lpad(string({k} % 1000), 3, '0'), '.00')",
        "spaced": f"concat('1 ', lpad(string({k} % 1000), 3, '0'))",
        "home_url": f"concat('https://s', {k}, '.example.com/a?b=', {nation})",
        "link": f"concat('http://x', {k}, '.io/a?b=c')",
        "markup": f"concat('<b>', {seg}, '</b> &amp;lt; x')",
        "escaped": f"concat('&lt;b&gt;', {nation})",
        "greeting": f"concat('hello ', {nation})",
        "accent": f"concat('café ', lower({seg}))",
        "cyrillic": f"concat('Ёлка и ёж, ', lower({seg}), '!')",
        "point": f"concat('-12.', {k})",
        "nbsp": f"concat('\\u00A0', {seg}, '\\u00A0')",
        "tabbed": f"concat('\\t', {seg}, '\\n')",
        "smile": f"concat('😀 ', {seg})",
        "empty": "''",
        "scripted": f"""concat('<SCRIPT type="x">if (a<b) {{}}</script>', {nation}, '<style>p{{}}</style><br/>')""",
        "unit_price": seg,
    }
    rows = ", ".join(f"named_struct('field', '{n}', 'value', {e})" for n, e in pieces.items())
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.expr(f"inline(array({rows}))"))


def _clean_query(name, kind, source_sql, source, key):
    @query(name, f"SELECT {key}, {clean_sql('value', kind)} AS cleaned FROM ({source_sql})")
    def build(spark, sf_dir):
        return source(spark, sf_dir).select(key, text.clean(F.col("value"), kind).alias("cleaned"))

    return build


_clean_query(
    "clean_text", "text", "SELECT doc_id, text AS value FROM documents",
    lambda spark, sf: spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"))), "doc_id",
)
_clean_query(
    "clean_html", "html", "SELECT page_id, html AS value FROM pages",
    lambda spark, sf: spread(read_pages(spark, f"{sf}/pages.parquet").select("page_id", F.col("html").alias("value"))), "page_id",
)
for _kind in ("html", "price", "phone", "email", "text"):
    _clean_query(f"clean_values_{_kind}", _kind, VALUES_SQL, values, "id")


@query(
    "format_tests",
    f"""
    WITH v AS ({VALUES_SQL} UNION ALL SELECT doc_id, 'document', text FROM documents)
    SELECT field, {', '.join(f"count(*) FILTER (WHERE {format_sql('value', k)}) AS {k}" for k in FORMAT_SQL)}
    FROM v GROUP BY field
    """,
)
def format_tests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("field"), F.col("text").alias("value"))
    rows = values(spark, sf_dir).unionByName(docs)
    return rows.groupBy("field").agg(
        *[F.count_if(text.matches_format(F.col("value"), k)).alias(k) for k in FORMAT_SQL]
    )


@query(
    "length_checks",
    f"""
    WITH d AS (SELECT doc_id, length({clean_sql('text', 'text')}) AS n FROM documents)
    SELECT doc_id, CAST(n AS BIGINT) AS size, CASE WHEN n < 1 THEN 'min_length' WHEN n > 1000 THEN 'max_length' END AS issue FROM d
    """,
)
def length_checks(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rule = v.FieldRule("text", min_length=0, max_length=1000)
    cleaned = docs.withColumn("clean", text.clean(F.col("text"), "text"))
    checked = cleaned.select(
        "doc_id", v.check_field(F.col("text"), F.col("clean"), rule, "text", docs.schema["text"].dataType).alias("c")
    )
    errors = F.filter("c.errors", lambda e: e["type"].isin("min_length", "max_length"))
    return checked.select(
        "doc_id", F.length("c.cleaned").cast("long").alias("size"), F.get(errors, 0)["type"].alias("issue")
    )


@query(
    "infer_types",
    f"""
    SELECT field, {infer_sql('value', 'field')} AS type, count(*) AS n FROM ({VALUES_SQL}) GROUP BY 1, 2
    """,
)
def infer_types(spark, sf_dir):
    rows = values(spark, sf_dir)
    rule = text.infer_field(F.col("value"), F.col("field"))
    return rows.groupBy("field", rule["type"].alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_profile",
    f"""
    SELECT 'text' AS field, {infer_sql('text', "'text'")} AS type, count(*) AS values FROM documents GROUP BY 1, 2
    UNION ALL SELECT 'lang', {infer_sql('lang', "'lang'")}, count(*) FROM documents GROUP BY 1, 2
    UNION ALL SELECT 'source', {infer_sql('source', "'source'")}, count(*) FROM documents GROUP BY 1, 2
    UNION ALL SELECT 'n_chars', 'number', count(*) FROM documents
    """,
)
def column_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return v.column_profile(docs, ("doc_id",))


@query(
    "profile_schema",
    f"""
    WITH t AS (SELECT 'lang' AS field, {infer_sql('lang', "'lang'")} AS type FROM documents
               UNION ALL SELECT 'text', {infer_sql('text', "'text'")} FROM documents),
         n AS (SELECT field, type, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT field, arg_max(type, (n, type)) AS type, CAST(sum(n) AS BIGINT) AS values FROM n GROUP BY 1
    """,
)
def profile_schema(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return v.schema_from_profile(v.column_profile(docs, ("doc_id",)))


# Customer records as items: job = nation, some fields missing, invalid or repeated.
ITEMS_SQL = """
  SELECT c_nationkey AS job_id, c_custkey AS item_no, c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '  #' ELSE '' END AS title,
    CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'no mail' ELSE lower(c_mktsegment) || (c_custkey % 40) || '@mail.com' END AS email,
    CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '+7 900 123-45-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') END AS phone,
    CASE WHEN c_custkey % 3 = 0 OR c_nationkey = 7 THEN '$' || printf('%.2f', abs(c_acctbal)) || ' USD'
         WHEN c_custkey % 11 = 0 THEN 'call' END AS price,
    c_acctbal AS balance
  FROM customer
"""


def items(spark, sf_dir):
    k = F.col("c_custkey")
    seg = F.col("c_mktsegment")
    return customers(spark, sf_dir).select(
        F.col("c_nationkey").alias("job_id"), k.alias("item_no"),
        F.concat(seg, F.when(k % 4 == 0, "  #").otherwise("")).alias("title"),
        F.when(k % 10 == 0, None).when(k % 10 == 1, "no mail")
        .otherwise(F.concat(F.lower(seg), (k % 40).cast("string"), F.lit("@mail.com"))).alias("email"),
        F.when(k % 6 == 0, "").otherwise(
            F.concat(F.lit("+7 900 123-45-"), F.lpad((k % 100).cast("string"), 2, "0"))
        ).alias("phone"),
        F.when(
            (k % 3 == 0) | (F.col("c_nationkey") == 7),
            F.concat(F.lit("$"), F.format_string("%.2f", F.abs("c_acctbal")), F.lit(" USD")),
        ).when(k % 11 == 0, "call").alias("price"),
        F.col("c_acctbal").alias("balance"),
    )


SCHEMA = v.Schema(
    {
        "title": v.FieldRule("text", required=True, max_length=10),
        "email": v.FieldRule("email", min_length=5, max_length=254),
        "phone": v.FieldRule("phone", required=True, min_length=7, max_length=20),
        "price": v.FieldRule("price", validator=lambda c: ~F.startswith(c, F.lit("$1"))),
        "balance": v.FieldRule("decimal"),
        "sku": v.FieldRule("text"),
    },
    relations=(
        v.Relation("required_together", ("email", "phone")),
        v.Relation("mutually_exclusive", ("email", "price")),
        v.Relation("conditional", (), lambda c: (c["balance"] >= 0) | c["phone"].isNull()),
    ),
    unique_fields=("email", "title"),
)

# The same rules in SQL: cleaned values, error lists, relations on the cleaned values.
CHECKED_SQL = f"""
  WITH i AS ({ITEMS_SQL}), c AS (
    SELECT *, {clean_sql('title', 'text')} AS ct, {clean_sql('email', 'email')} AS ce, {clean_sql('phone', 'phone')} AS cp,
      {clean_sql('price', 'price')} AS cr FROM i
  ), e AS (
    SELECT *, list_filter([CASE WHEN NOT {format_sql('ct', 'text')} THEN 'title:format' END,
        CASE WHEN length(ct) < 1 THEN 'title:min_length' END, CASE WHEN length(ct) > 10 THEN 'title:max_length' END], lambda x: x IS NOT NULL) AS e1,
      CASE WHEN email IS NULL OR email = '' THEN [] ELSE list_filter([CASE WHEN NOT {format_sql('ce', 'email')} THEN 'email:format' END,
        CASE WHEN length(ce) < 5 THEN 'email:min_length' END], lambda x: x IS NOT NULL) END AS e2,
      CASE WHEN phone = '' THEN ['phone:required'] ELSE list_filter([CASE WHEN NOT {format_sql('cp', 'phone')} THEN 'phone:format' END,
        CASE WHEN length(cp) < 7 THEN 'phone:min_length' END, CASE WHEN length(cp) > 20 THEN 'phone:max_length' END], lambda x: x IS NOT NULL) END AS e3,
      CASE WHEN price IS NULL THEN [] ELSE list_filter([CASE WHEN NOT {format_sql('cr', 'price')} THEN 'price:format' END, CASE WHEN length(cr) < 1 THEN 'price:min_length' END,
        CASE WHEN starts_with(cr, '$1') THEN 'price:custom' END], lambda x: x IS NOT NULL) END AS e4
    FROM c
  ), f AS (
    SELECT job_id, item_no, CASE WHEN len(e1) = 0 THEN ct END AS title, CASE WHEN len(e2) = 0 THEN ce END AS email,
      CASE WHEN len(e3) = 0 THEN cp END AS phone, CASE WHEN len(e4) = 0 THEN cr END AS price, balance,
      e1 || e2 || e3 || e4 AS field_errors,
      (len(e1) = 0 AND ct <> title) OR (len(e2) = 0 AND coalesce(ce <> email, false)) OR (len(e3) = 0 AND cp <> phone) OR (len(e4) = 0 AND coalesce(cr <> price, false)) AS was_cleaned,
      list_filter([CASE WHEN ct <> title THEN 'title:cleaned' END, CASE WHEN ce <> email THEN 'email:cleaned' END,
        CASE WHEN cp <> phone THEN 'phone:cleaned' END, CASE WHEN cr <> price THEN 'price:cleaned' END, 'balance:unknown_type'], lambda x: x IS NOT NULL) AS warnings
    FROM e
  ), r AS (
    SELECT *, coalesce(email, '') <> '' AS he, coalesce(price, '') <> '' AS hp, coalesce(phone, '') <> '' AS hc FROM f
  ), checked AS (
    SELECT job_id, item_no, title, email, phone, price, balance, was_cleaned, warnings,
      field_errors || list_filter([CASE WHEN he <> hc THEN ':required_together' END, CASE WHEN he AND hp THEN ':mutually_exclusive' END,
        CASE WHEN NOT (balance >= 0 OR phone IS NULL) THEN ':conditional' END], lambda x: x IS NOT NULL) AS errors
    FROM r
  )
"""


@query(
    "validated_items",
    f"{CHECKED_SQL} SELECT job_id, item_no, title, email, phone, price, balance FROM checked WHERE len(errors) = 0",
)
def validated_items(spark, sf_dir):
    return v.validate(items(spark, sf_dir), SCHEMA)[0]


@query(
    "items_with_invalid",
    f"{CHECKED_SQL} SELECT job_id, item_no, title, email, phone, price, balance FROM checked",
)
def items_with_invalid(spark, sf_dir):
    """Invalid items stay, without the values that failed."""
    return v.validate(items(spark, sf_dir), replace(SCHEMA, include_invalid=True))[0]


@query(
    "checked_items",
    f"""{CHECKED_SQL} SELECT job_id, item_no, title, email, phone, price, array_to_string(errors, ',') AS errors,
        array_to_string(warnings, ',') AS warnings, len(errors) = 0 AS is_valid, was_cleaned FROM checked""",
)
def checked_items(spark, sf_dir):
    checked = v.check_items(items(spark, sf_dir), SCHEMA)

    def names(column):
        return F.array_join(F.transform(column, lambda i: F.concat(i["field"], F.lit(":"), i["type"])), ",").alias(column)

    return checked.select(
        "job_id", "item_no", "title", "email", "phone", "price", names("errors"), names("warnings"), "is_valid", "was_cleaned"
    )


_STATS_SQL = """
  SELECT job_id, count(*) AS total_items, count(*) FILTER (WHERE len(errors) = 0) AS valid_items,
    count(*) FILTER (WHERE len(errors) > 0) AS invalid_items, count(*) FILTER (WHERE len(errors) = 0 AND was_cleaned) AS cleaned_items
  FROM checked GROUP BY 1
"""


@query(
    "validation_stats",
    f"""{CHECKED_SQL}, s AS ({_STATS_SQL})
    SELECT *, valid_items / total_items >= 0.5 AS is_valid,
      CASE WHEN valid_items / total_items < 0.5 THEN CAST(round((1 - valid_items / total_items) * 100) AS INTEGER) END AS invalid_percent FROM s""",
)
def validation_stats(spark, sf_dir):
    return v.validate(items(spark, sf_dir), SCHEMA)[2]


_DUPLICATES_SQL = """
  SELECT job_id, item_no, 'email' AS field, email AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, email ORDER BY item_no) AS rn FROM checked WHERE coalesce(email, '') <> '') WHERE rn > 1
  UNION ALL
  SELECT job_id, item_no, 'title', title FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, title ORDER BY item_no) AS rn FROM checked WHERE coalesce(title, '') <> '') WHERE rn > 1
"""


@query(
    "validation_issues",
    f"""{CHECKED_SQL}, d AS ({_DUPLICATES_SQL})
    SELECT severity, type, field, count(*) AS n FROM (
      SELECT 'error' AS severity, string_split(x, ':')[2] AS type, string_split(x, ':')[1] AS field FROM (SELECT unnest(errors) AS x FROM checked)
      UNION ALL SELECT 'warning', string_split(x, ':')[2], string_split(x, ':')[1] FROM (SELECT unnest(warnings) AS x FROM checked)
      UNION ALL SELECT 'warning', 'duplicate', field FROM d
    ) GROUP BY 1, 2, 3""",
)
def validation_issues(spark, sf_dir):
    issues = v.validate(items(spark, sf_dir), SCHEMA)[1]
    return issues.groupBy("severity", "type", "field").agg(F.count(F.lit(1)).alias("n"))


@query("duplicates", f"{CHECKED_SQL} {_DUPLICATES_SQL}")
def duplicates(spark, sf_dir):
    checked = v.check_items(items(spark, sf_dir), SCHEMA)
    return v.duplicate_issues(checked, SCHEMA.unique_fields)


@query(
    "duplicate_documents",
    """
    SELECT source AS job_id, doc_id, 'text' AS field FROM (
      SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn FROM documents WHERE text <> '') WHERE rn > 1
    UNION ALL
    SELECT 'all', doc_id, 'text' FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE text <> '') WHERE rn > 1
    """,
)
def duplicate_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    jobs = F.explode(F.array(F.col("source"), F.lit("all"))).alias("job_id")
    rows = docs.select("doc_id", "text", jobs)
    return v.duplicate_issues(rows, ("text",), "job_id", ("doc_id",)).drop("value")


@query(
    "relationships",
    f"""{CHECKED_SQL} SELECT job_id, item_no, x[2:] AS type FROM (SELECT job_id, item_no, unnest(errors) AS x FROM checked) WHERE x[1] = ':'""",
)
def relationships(spark, sf_dir):
    issues = v.issue_rows(v.check_items(items(spark, sf_dir), SCHEMA))
    return issues.where((F.col("field") == "") & (F.col("severity") == "error")).select("job_id", "item_no", "type")


@query(
    "missing_columns",
    f"SELECT job_id, item_no, 'sku' AS field, 'missing' AS type FROM ({ITEMS_SQL})",
)
def missing_columns(spark, sf_dir):
    schema = v.Schema({"sku": v.FieldRule("text", required=True)})
    issues = v.issue_rows(v.check_items(items(spark, sf_dir), schema))
    return issues.select("job_id", "item_no", "field", "type")


@query(
    "missing_fields",
    f"""
    WITH r AS (SELECT n_nationkey AS job_id, f AS field, (n_nationkey % 3 = i) OR i = 1 AS required
               FROM nation, (VALUES (0, 'email'), (1, 'phone'), (2, 'price')) AS t(i, f)),
         l AS (SELECT job_id, item_no, field FROM ({ITEMS_SQL}), LATERAL (VALUES ('title', title), ('email', email),
               ('phone', nullif(phone, '')), ('price', nullif(price, 'call'))) AS t(field, value) WHERE value IS NOT NULL),
         k AS (SELECT DISTINCT job_id, item_no FROM l)
    SELECT k.job_id, k.item_no, r.field FROM k JOIN r ON k.job_id = r.job_id AND r.required
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.job_id = k.job_id AND l.item_no = k.item_no AND l.field = r.field)
    """,
)
def missing_fields(spark, sf_dir):
    long = items(spark, sf_dir).selectExpr(
        "job_id", "item_no",
        "stack(4, 'title', title, 'email', email, 'phone', nullif(phone, ''), 'price', nullif(price, 'call')) AS (field, value)",
    ).where("value IS NOT NULL")
    rules = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS job_id",
        "inline(array(named_struct('field', 'email', 'required', n_nationkey % 3 = 0), named_struct('field', 'phone', 'required', true),"
        " named_struct('field', 'price', 'required', n_nationkey % 3 = 2)))",
    )
    return v.missing_fields(long, rules)


@query(
    "error_histogram",
    f"""{CHECKED_SQL} SELECT job_id, string_split(x, ':')[2] AS type, count(*) AS errors
    FROM (SELECT job_id, unnest(errors) AS x FROM checked) GROUP BY 1, 2""",
)
def error_histogram(spark, sf_dir):
    return v.error_histogram(v.issue_rows(v.check_items(items(spark, sf_dir), SCHEMA)))


@query(
    "error_sample",
    f"""{CHECKED_SQL}, x AS (SELECT job_id, item_no, generate_subscripts(errors, 1) AS i, unnest(errors) AS e FROM checked),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY item_no, i) AS rank FROM x)
    SELECT job_id, item_no, string_split(e, ':')[2] AS type, rank FROM ranked WHERE rank <= 5""",
)
def error_sample(spark, sf_dir):
    issues = v.issue_rows(v.check_items(items(spark, sf_dir), SCHEMA))
    return v.error_sample(issues).select("job_id", "item_no", "type", F.col("rank").cast("long").alias("rank"))


@query(
    "applied_validation",
    f"""{CHECKED_SQL}, s AS ({_STATS_SQL})
    SELECT c.job_id, c.item_no, c.title, c.email, c.price FROM checked c JOIN s USING (job_id) WHERE len(c.errors) = 0 AND s.valid_items > 0
    UNION ALL SELECT i.job_id, i.item_no, i.title, i.email, i.price FROM i JOIN s USING (job_id) WHERE s.valid_items = 0""",
)
def applied_validation(spark, sf_dir):
    return v.apply_validation(items(spark, sf_dir), SCHEMA)[0].select("job_id", "item_no", "title", "email", "price")


@query(
    "applied_messages",
    f"""{CHECKED_SQL}, s AS ({_STATS_SQL}), d AS ({_DUPLICATES_SQL}), m AS (
      SELECT job_id, 'error' AS severity, string_split(x, ':')[2] AS type FROM (SELECT job_id, unnest(errors) AS x FROM checked)
      UNION ALL SELECT job_id, 'warning', string_split(x, ':')[2] FROM (SELECT job_id, unnest(warnings) AS x FROM checked)
      UNION ALL SELECT job_id, 'warning', 'duplicate' FROM d)
    SELECT job_id, severity, type, count(*) AS n FROM m JOIN s USING (job_id)
    WHERE (valid_items / total_items >= 0.5) = (severity = 'warning') GROUP BY 1, 2, 3
    UNION ALL SELECT job_id, 'error', 'critical', 1 FROM s WHERE valid_items / total_items < 0.5""",
)
def applied_messages(spark, sf_dir):
    messages = v.apply_validation(items(spark, sf_dir), SCHEMA)[1]
    return messages.groupBy("job_id", "severity", "type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "corrupt_records",
    """
    WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN left(props, 4) ELSE props END AS raw FROM events)
    SELECT user_id AS job_id, event_id AS item_no, CASE WHEN event_id % 9 = 0 THEN 'structure' END AS error,
           CASE WHEN event_id % 9 <> 0 THEN CAST(raw->>'k' AS BIGINT) END AS k FROM e
    """,
)
def corrupt_records(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("item_no"),
        F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("raw"),
    )
    read = F.from_json("raw", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.select("job_id", "item_no", read.alias("r")).select("job_id", "item_no", "r.*")
    checked = v.check_items(rows, v.Schema({"k": v.FieldRule("number")}), corrupt="_corrupt_record")
    return checked.select("job_id", "item_no", F.get("errors", 0)["type"].alias("error"), "k")


@query(
    "sample_rules",
    f"""
    WITH i AS ({ITEMS_SQL}), f AS (
      SELECT job_id, arg_min(title, item_no) AS title, arg_min(coalesce(email, '-null-'), item_no) AS email, arg_min(phone, item_no) AS phone,
             arg_min(coalesce(price, '-null-'), item_no) AS price FROM i GROUP BY 1)
    SELECT job_id, field, CASE WHEN value = '-null-' THEN 'object' ELSE {infer_sql('value', 'field')} END AS type
    FROM f, LATERAL (VALUES ('title', title), ('email', email), ('phone', phone), ('price', price)) AS t(field, value)
    UNION ALL SELECT job_id, 'balance', 'number' FROM f
    """,
)
def sample_rules(spark, sf_dir):
    return v.sample_rules(items(spark, sf_dir)).select("job_id", "field", "type")
