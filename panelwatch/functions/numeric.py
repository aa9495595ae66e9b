"""Null-safe numeric column helpers; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, digits: int) -> Column:
    """Round half up at ``digits`` places, free of binary noise such as 2.67499999; from 1e20 on as a double."""
    exact = F.round(col.try_cast("decimal(30,10)"), digits).cast("double")
    return F.coalesce(exact, F.round(col.cast("double"), digits))


def clamp(col: Column, lo, hi) -> Column:
    """Bound to [lo, hi]; null stays null (``greatest``/``least`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), col)))


def clamped_share(col: Column, lo: Column, hi: Column, missing: float = 0.5) -> Column:
    """Position of ``col`` in [lo, hi], kept in 0..1; missing input gives ``missing``."""
    share = (col - lo) / (hi - lo)
    return F.when(col.isNull() | F.isnan(col), F.lit(missing)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    )


def nan_to_null(col: Column) -> Column:
    """Model output and pandas hand-over mark missing as NaN; the engine uses null."""
    return F.when(~F.isnan(col), col)


def truthy(col: Column) -> Column:
    """Present and not zero: how readings are accepted for the text rules."""
    return col.isNotNull() & (col != 0)
