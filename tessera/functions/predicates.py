"""Predicates on columns with the engine's null rules.

Nulls sort below every value, so `lt` and `le` match them; `ne` and `not_in` keep them; `gt`, `ge`
and `between` do not. Text matching is case-insensitive. nulls="sql" gives SQL's rules instead."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eq(c: ColumnOrName, v) -> Column:
    return _c(c) == F.lit(v)


def ne(c: ColumnOrName, v, nulls: str = "engine") -> Column:
    return _c(c) != F.lit(v) if nulls == "sql" else ~_c(c).eqNullSafe(F.lit(v))


def gt(c: ColumnOrName, v) -> Column:
    return _c(c) > F.lit(v)


def ge(c: ColumnOrName, v) -> Column:
    return _c(c) >= F.lit(v)


def lt(c: ColumnOrName, v, nulls: str = "engine") -> Column:
    return _c(c) < F.lit(v) if nulls == "sql" else _c(c).isNull() | (_c(c) < F.lit(v))


def le(c: ColumnOrName, v, nulls: str = "engine") -> Column:
    return _c(c) <= F.lit(v) if nulls == "sql" else _c(c).isNull() | (_c(c) <= F.lit(v))


def between(c: ColumnOrName, low, high) -> Column:
    return _c(c).between(F.lit(low), F.lit(high))


def one_of(c: ColumnOrName, values) -> Column:
    return _c(c).isin(*values)


def not_in(c: ColumnOrName, values, nulls: str = "engine") -> Column:
    return ~_c(c).isin(*values) if nulls == "sql" else _c(c).isNull() | ~_c(c).isin(*values)


def void(c: ColumnOrName) -> Column:
    return _c(c).isNull()


def defined(c: ColumnOrName) -> Column:
    return _c(c).isNotNull()


def contains(c: ColumnOrName, part: str) -> Column:
    return F.coalesce(F.lower(_c(c)).contains(part.lower()), F.lit(False))


def starts_with(c: ColumnOrName, part: str) -> Column:
    return F.coalesce(F.lower(_c(c)).startswith(part.lower()), F.lit(False))


def ends_with(c: ColumnOrName, part: str) -> Column:
    return F.coalesce(F.lower(_c(c)).endswith(part.lower()), F.lit(False))


def matches(c: ColumnOrName, regex: str) -> Column:
    """An unanchored search (Java's dialect); a pattern that cannot be read matches nothing."""
    try:
        re.compile(regex)
    except re.error:
        return F.lit(False)
    return F.coalesce(_c(c).rlike(regex), F.lit(False))


def glob(c: ColumnOrName, pattern: str) -> Column:
    """* for any run, ? for one character, over the whole text."""
    body = "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in pattern)
    return matches(c, f"(?s)^{body}$")


def all_of(*p: Column) -> Column:
    return reduce(lambda a, b: a & b, p, F.lit(True))


def any_of(*p: Column) -> Column:
    return reduce(lambda a, b: a | b, p)


def any_group(groups) -> Column:
    """OR of ANDs: each group is a sequence of predicates."""
    return any_of(*[all_of(*g) for g in groups])


def search(fields, text: str) -> Column:
    """Free text over several fields."""
    return any_of(*[contains(f, text) for f in fields])


def at(literal) -> Column:
    """A timestamp literal: YYYY-MM-DD, with time and Z if wanted, epoch milliseconds, or NOW."""
    if isinstance(literal, int):
        return F.timestamp_millis(F.lit(literal)).cast("timestamp_ntz")
    text = str(literal).strip()
    if text.upper() == "NOW":
        return F.current_timestamp().cast("timestamp_ntz")
    if not re.fullmatch(r"\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d(?::\d\d(?:\.\d{1,3})?)?Z?)?", text):
        raise ValueError(f"not a timestamp: {literal!r}")
    return F.lit(text.rstrip("Z").replace("T", " ")).cast("timestamp_ntz")


def iso(field) -> Column:
    """A timestamp as ISO 8601 text in UTC with milliseconds, as at() reads it."""
    return F.date_format(field, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
