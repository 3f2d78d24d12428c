"""Naming an intermediate value inside a column expression.

A Python variable holding a Column is copied into every place that uses it, so a chain of steps that each use the
previous one twice doubles with every step. ``bind`` evaluates the value once and hands it on as a lambda variable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), lambda named: use(named)), F.lit(0))
