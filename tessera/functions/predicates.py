"""Row predicates that treat nulls as the data model does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Risk tiers and their rank; an unknown tier ranks as medium.
RISK_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4, "prohibited": 5}


def excluded_free(column: str, values: list) -> Column:
    """Not one of ``values``; null passes."""
    return F.col(column).isNull() | ~F.col(column).isin(*values)


def open_scope(column: str, value: str) -> Column:
    """Of the domain, or of none."""
    return (F.col(column) == value) | F.col(column).isNull()


def strict_scope(column: str, value: str | None) -> Column:
    """Exactly of the domain; None: of none."""
    return F.col(column).eqNullSafe(F.lit(value))


def risk_rank(tier: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in RISK_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, F.lower(F.trim(tier))), F.lit(RISK_RANK["medium"]))


def valid_at(moment: Column | None, start: str = "valid_from", end: str = "valid_to") -> Column:
    """In the interval [start, end); None: still open."""
    if moment is None:
        return F.col(end).isNull()
    return (F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment))
