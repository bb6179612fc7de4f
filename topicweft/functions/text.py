"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"[ \t\n\f\r]+"


def words(text: Column, pattern: str = WHITESPACE) -> Column:
    """Non-empty pieces of ``text`` between matches of ``pattern``."""
    return F.filter(F.split(text, pattern), lambda w: w != "")


def fields(line: Column, sep: str) -> Column:
    """Fields of a delimited line; trailing empty fields do not count."""
    quoted = "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in sep)
    return F.split(F.regexp_replace(line, f"({quoted})+$", ""), quoted)


def list_items(text: Column, to: str) -> Column:
    """``List(a, b, ...)`` as an array; null when ``text`` has no such list."""
    body = F.regexp_extract(text, r"List\(([^)]*)\)", 1)
    return F.when(
        text.rlike(r"List\("),
        F.transform(F.filter(F.split(body, ", "), lambda x: x != ""), lambda x: x.cast(to)),
    )


def list_text(values: Column) -> Column:
    """Inverse of :func:`list_items`."""
    return F.concat(F.lit("List("), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit(")"))
