"""Expressions that follow JavaScript where its rules differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's ``\s`` has it (a fixed value).
JS_SPACE = r"[\s\x0B   -     　﻿]"

#: The characters of ``JS_SPACE``, one by one.
_SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def trim(c: Column) -> Column:
    """``String.prototype.trim``."""
    return F.trim(c, F.lit(_SPACES))


def round2(c: Column) -> Column:
    """Two decimals, halves towards plus infinity, on doubles."""
    return F.floor(c.cast("double") * 100 + F.lit(0.5)) / F.lit(100.0)


def round0(c: Column) -> Column:
    """``Math.round``."""
    return F.floor(c.cast("double") + F.lit(0.5))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
