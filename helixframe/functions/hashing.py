"""Seeded pseudo-random numbers as plain columns.

All draws are derived from ``md5(purpose:seed:key...)``. The purpose is part of
the text so that two random steps over the same key are independent, and the
value depends only on the row, so a recomputed task draws the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(purpose: str, seed: int, *keys: Column | str) -> Column:
    """32 hex digits for a row; sorting by them is a random order."""
    parts = [F.lit(f"{purpose}:{seed}")]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def digits_to_int(hex_text: Column, start: int = 1, length: int = 8) -> Column:
    """``length`` hex digits from 1-based ``start`` as a whole number."""
    return F.conv(F.substring(hex_text, start, length), 16, 10).cast("bigint")


def unit(hex_text: Column, start: int = 1) -> Column:
    """Eight hex digits as a number in [0, 1)."""
    return digits_to_int(hex_text, start, 8) / F.lit(4294967296.0)


def unit_below(hex_text: Column, bound: float, start: int = 1) -> Column:
    """``unit(...) < bound`` as a comparison of hex digits, without a conversion."""
    whole = math.ceil(bound * 4294967296.0)
    if whole > 0xFFFFFFFF:
        return F.lit(True)
    # the text goes on after its eight digits, which does not change whether it comes before the bound
    return (hex_text if start == 1 else F.substring(hex_text, start, 8)) < F.lit(f"{whole:08x}")


def uniform(purpose: str, seed: int, *keys: Column | str) -> Column:
    return unit(digest(purpose, seed, *keys))
