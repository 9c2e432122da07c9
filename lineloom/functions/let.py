"""Bind an expression to a name inside one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimizer inlines a column that is mentioned once, even when that
    mention sits inside a lambda that runs per array element.  A lambda
    variable cannot be inlined, so expensive values stay evaluated once.
    """
    return F.transform(F.array(value), body).getItem(0)
