"""Bike and trip types.

There are two forms on purpose. ``bike_type`` puts every bike somewhere: a
missing number counts as plus. ``is_classic`` is three-valued: a missing number
is neither classic nor plus, so conditional counts leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spokeworks.schemas import CLASSIC_PREFIXES

CLASSIC = "Classic"
PLUS = "Plus"


def is_classic(bike: Column | str, prefixes: tuple[str, ...] = CLASSIC_PREFIXES) -> Column:
    """True, false, or NULL for a missing bike number."""
    return F.left(_col(bike), F.lit(1)).isin(*prefixes)


def bike_type(
    bike: Column | str,
    classic: str = CLASSIC,
    plus: str = PLUS,
    prefixes: tuple[str, ...] = CLASSIC_PREFIXES,
) -> Column:
    """``classic`` or ``plus``; a missing bike number is ``plus``."""
    return F.when(is_classic(bike, prefixes), classic).otherwise(plus)


def known_bike_type(
    bike: Column | str,
    classic: str = CLASSIC,
    plus: str = PLUS,
    prefixes: tuple[str, ...] = CLASSIC_PREFIXES,
) -> Column:
    """``classic`` or ``plus``; NULL for a missing bike number."""
    flag = is_classic(bike, prefixes)
    return F.when(flag, classic).when(~flag, plus)


def trip_type(
    bike: Column | str,
    member: Column | str,
    classic: str = CLASSIC,
    plus: str = PLUS,
    prefixes: tuple[str, ...] = CLASSIC_PREFIXES,
) -> Column:
    """Classic trips by member type, all plus trips together, NULL for the rest."""
    flag = is_classic(bike, prefixes)
    member = _col(member)
    return (
        F.when(flag & (member == "Member"), f"{classic}, Member")
        .when(flag & (member == "Casual"), f"{classic}, Casual")
        .when(~flag, plus)
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
