"""Expressions written as SQL text.

A function that would take a hundred ``F.*`` calls to build is written as one SQL expression here:
Spark parses it in one go, and the text is what one would type into a query. Values used several
times are bound to a name, so that they are worked out once per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def texts(values: Iterable[str]) -> str:
    """A comma-separated list of SQL string literals."""
    return ", ".join(text(value) for value in values)


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def evaluate(body: str, **columns: Column) -> Column:
    """The SQL expression ``body``, in which ``arg.<name>`` stands for the given columns."""
    argument = F.struct(*[c.alias(name) for name, c in columns.items()])
    return F.get(F.call_function("transform", F.array(argument), F.expr(f"arg -> {body}")), F.lit(0))
