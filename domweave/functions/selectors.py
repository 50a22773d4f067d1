"""Selectors as column predicates, and selector strings as data.

``css`` and ``xpath`` accept the selector shapes that occur in scraping rules
(tag, ``.class``, ``#id``, attribute tests, ``:nth-of-type``, lists, descendant
and child steps) and return a ``Selector`` that writes itself as a SQL condition.
There is no general CSS or XPath engine behind it.  Conditions are SQL text because
hundreds of them go into one analysis plan, and building those column by column
costs seconds on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Step:
    """One compound selector and how it hangs below the previous one."""

    tag: str | None = None
    tests: tuple = ()  # (attribute, operator, value)
    nth: int | None = None
    child: bool = False

    def sql(self, node: str) -> str:
        at = f"{node}." if node else ""
        conditions = [] if self.tag is None else [f"{at}tag = {literal(self.tag)}"]
        for name, op, value in self.tests:
            attr = f"{at}`{name}`" if name in ("id", "class") else f"try_element_at({at}attrs, {literal(name)})"
            conditions.append({
                "token": lambda: f"array_contains({at}classes, {literal(value)})",
                "present": lambda: f"{attr} IS NOT NULL",
                "=": lambda: f"{attr} = {literal(value)}",
                "*=": lambda: f"contains({attr}, {literal(value)})",
                "^=": lambda: f"startswith({attr}, {literal(value)})",
                "$=": lambda: f"endswith({attr}, {literal(value)})",
            }[op]())
        if self.nth is not None:
            conditions.append(f"{at}type_index = {self.nth}")
        return f"coalesce({' AND '.join(conditions)}, false)" if conditions else "true"

    def possible(self, tags: str, names: str) -> str:
        conditions = [] if self.tag is None else [f"array_contains({tags}, {literal(self.tag)})"]
        conditions += [f"contains({names}, {literal(value)})" for name, op, value in self.tests if op != "present" and name in ("class", "id")]
        return f"({' AND '.join(conditions)})" if conditions else "true"


def some_ancestor_sql(at: str, name: str, condition) -> str:
    """SQL: some proper ancestor of an element meets ``condition(ancestor)``.

    ``at`` is the prefix of the element's columns.  Parents are walked, so no element
    stores its ancestors and deep pages stay as small as flat ones.
    """
    up = f"get(nodes, {name}.at)"
    return (
        f"aggregate(array_repeat(0, {at}depth), named_struct('at', {at}parent_id, 'hit', false), ({name}, {name}k) -> "
        f"if({name}.hit, {name}, named_struct('at', {up}.parent_id, 'hit', {condition(up)})), {name} -> {name}.hit)"
    )


@dataclass(frozen=True)
class Selector:
    text: str
    chains: tuple  # alternatives, each a tuple of steps from the outermost inwards

    def sql(self, node: str = "") -> str:
        """SQL condition on an element.

        ``node`` is an expression for the element struct (empty: flat element columns).
        Selectors with several steps look their ancestors up in the page's ``nodes``.
        """
        return "(" + " OR ".join(self._chain(chain, node, 1) for chain in self.chains) + ")"

    def _chain(self, chain, node, level):
        *outer, last = chain
        if not outer:
            return last.sql(node)
        at = f"{node}." if node else ""
        if last.child:
            above = self._chain(outer, f"get(nodes, {at}parent_id)", level)
        else:
            above = some_ancestor_sql(at, f"a{level}", lambda up: self._chain(outer, up, level + 1))
        return f"({last.sql(node)} AND {above})"

    def possible(self, tags: str, names: str) -> str:
        """SQL: a page may hold a match, told from its last steps alone.

        ``tags`` is an array of all tags of the page, ``names`` a text that holds all its classes and ids.  True for some
        pages without a match, never false for one with a match.
        """
        return "(" + " OR ".join(chain[-1].possible(tags, names) for chain in self.chains) + ")"

    def matches(self) -> Column:
        """Condition on flat element columns."""
        return F.expr(self.sql())

    def hits(self) -> str:
        """SQL for the matching elements of a page, in document order."""
        return f"filter(nodes, n -> {self.sql('n')})"


_COMPOUND = re.compile(
    r"(?P<tag>\*|[\w-]+)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\]|:nth-of-type\(\d+\))*)\Z"
)
_TEST = re.compile(
    r"\.(?P<token>[\w-]+)|#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*"
    r"(?:(?P<op>[*^$]?=)\s*[\"']?(?P<value>[^\]\"']*)[\"']?)?\s*\]|:nth-of-type\((?P<nth>\d+)\)"
)


def _compound(text: str, child: bool) -> Step:
    found = _COMPOUND.match(text)
    if not text or not found:
        raise ValueError(f"unsupported selector: {text!r}")
    tests, nth = [], None
    for m in _TEST.finditer(found["rest"]):
        if m["token"]:
            tests.append(("class", "token", m["token"]))
        elif m["id"]:
            tests.append(("id", "=", m["id"]))
        elif m["nth"]:
            nth = int(m["nth"])
        else:
            tests.append((m["attr"].lower(), m["op"] or "present", m["value"]))
    tag = None if found["tag"] in (None, "*") else found["tag"].lower()
    return Step(tag, tuple(tests), nth, child)


def css(text: str) -> Selector:
    """``div.card[data-id] > a, #main p`` and the like."""
    chains = []
    for alternative in text.split(","):
        parts = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", alternative.strip())
        steps, child = [], False
        for part in parts:
            if part == ">":
                child = True
            else:
                steps.append(_compound(part, child))
                child = False
        if not steps:
            raise ValueError(f"unsupported selector: {text!r}")
        chains.append(tuple(steps))
    return Selector(text, tuple(chains))


_XPATH_STEP = re.compile(r"(?P<axis>//?)(?P<tag>\*|[\w-]+)(?P<conditions>(?:\[[^\]]*\])*)")
_XPATH_TEST = re.compile(
    r"contains\(\s*@(?P<part>[\w:-]+)\s*,\s*['\"](?P<piece>[^'\"]*)['\"]\s*\)"
    r"|@(?P<attr>[\w:-]+)(?:\s*=\s*['\"](?P<value>[^'\"]*)['\"])?"
    r"|(?:position\(\)\s*=\s*)?(?P<nth>\d+)"
)


def xpath(text: str) -> Selector:
    """``//div[@id='x']/p[2]``, ``//*[contains(@class,'a')]`` and the like.

    A class test is a substring test here, unlike ``css('.x')``.
    """
    chains = []
    for alternative in text.split("|"):
        alternative = alternative.strip()
        steps = list(_XPATH_STEP.finditer(alternative))
        if not steps or "".join(m[0] for m in steps) != alternative:
            raise ValueError(f"unsupported expression: {text!r}")
        chain = []
        for m in steps:
            tests, nth = [], None
            for t in _XPATH_TEST.finditer(m["conditions"]):
                if t["part"]:
                    tests.append((t["part"].lower(), "*=", t["piece"]))
                elif t["attr"]:
                    tests.append((t["attr"].lower(), "present" if t["value"] is None else "=", t["value"]))
                else:
                    nth = int(t["nth"])
            tag = None if m["tag"] == "*" else m["tag"].lower()
            chain.append(Step(tag, tuple(tests), nth, m["axis"] == "/" and bool(chain)))
        chains.append(tuple(chain))
    return Selector(text, tuple(chains))


# ---- selector strings held in a table ---------------------------------------


def css_to_xpath(selector: Column) -> Column:
    """Convert a column of CSS selectors; the first matching shape decides.

    Shapes that mix several kinds are converted by their leading kind only, and a
    bracket that cannot be read gives an empty string.
    """
    pattern = r"^([A-Za-z0-9_]+)?\[([^=]+)=?\"?([^\"]*)\"?\]\z"
    readable = F.rlike(selector, F.lit(pattern))
    tag = F.coalesce(F.nullif(F.regexp_extract(selector, pattern, 1), F.lit("")), F.lit("*"))
    attr = F.regexp_extract(selector, pattern, 2)
    value = F.regexp_extract(selector, pattern, 3)
    by_attr = F.when(value != "", F.format_string("//%s[@%s='%s']", tag, attr, value)).otherwise(
        F.format_string("//%s[@%s]", tag, attr)
    )
    children = F.array_join(F.transform(F.split(selector, ">"), lambda s: F.trim(s)), "/")
    below = F.array_join(F.filter(F.split(selector, " "), lambda s: F.trim(s) != ""), "//")
    return (
        F.when(F.startswith(selector, F.lit("#")), F.format_string("//*[@id='%s']", F.substr(selector, F.lit(2))))
        .when(
            F.startswith(selector, F.lit(".")),
            F.format_string("//*[contains(@class,'%s')]", F.substr(selector, F.lit(2))),
        )
        .when(
            F.contains(selector, F.lit("[")) & F.contains(selector, F.lit("]")),
            F.when(readable, by_attr).otherwise(F.lit("")),
        )
        .when(F.contains(selector, F.lit(">")), F.concat(F.lit("//"), children))
        .when(F.contains(selector, F.lit(" ")), F.concat(F.lit("//"), below))
        .otherwise(F.concat(F.lit("//"), selector))
    )


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def xpath_error(expression: Column) -> Column:
    """Reason why an expression is not acceptable, null if it is."""
    return (
        F.when(F.coalesce(expression, F.lit("")) == "", F.lit("not_a_string"))
        .when(~F.startswith(expression, F.lit("/")), F.lit("no_leading_slash"))
        .when(_count(expression, "[") != _count(expression, "]"), F.lit("unbalanced_brackets"))
        .when(
            (_count(expression, "'") % 2 != 0) | (_count(expression, '"') % 2 != 0),
            F.lit("unbalanced_quotes"),
        )
    )


def rewrite_xpath(expression: Column) -> Column:
    """Single leading ``//``, class equality as containment, short position test."""
    slashes = F.regexp_replace(expression, r"^//+", "//")
    classes = F.regexp_replace(slashes, r"@class='([^']+)'", r"contains(@class,'$1')")
    return F.replace(classes, F.lit("[position()=1]"), F.lit("[1]"))


def normalize_selectors(selectors: Column) -> Column:
    """Fill the defaults of an array of xpath field structs.

    An entry without a name counts as the short (string) form.
    """
    return F.transform(
        selectors,
        lambda s, i: F.struct(
            s["xpath"].alias("xpath"),
            F.coalesce(s["name"], F.concat(F.lit("xpath_field_"), (i + 1).cast("string"))).alias("name"),
            F.coalesce(F.nullif(s["type"], F.lit("")), F.lit("text")).alias("type"),
            F.nullif(s["attribute"], F.lit("")).alias("attribute"),
            F.coalesce(s["multiple"], F.lit(False)).alias("multiple"),
            F.nullif(s["fallback"], F.lit("")).alias("fallback"),
        ),
    )
