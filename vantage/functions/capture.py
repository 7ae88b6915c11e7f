"""Capture times of mixed precision, ids, tokens, and link arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = r"^[A-Za-z0-9_+/=-]{1,240}$"
CLOCK = r"^([01][0-9]|2[0-3]):[0-5][0-9]$"
MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])$"


_SECOND = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_MONTH = r"^[0-9]{4}-[0-9]{2}$"


def capture_parts(text: Column) -> dict[str, Column]:
    """capture_date, precision, month, day and clock of a capture time; what a time doesn't say is null.

    A time is a whole month, day, or day with hours, minutes and seconds, whatever white space is around it. All
    else, a null, and a date or clock that doesn't exist, has precision "unknown" and no parts.
    """
    raw = F.regexp_replace(text, r"^\s+|\s+$", "")
    shape = F.when(raw.rlike(_SECOND), F.lit("second")).when(raw.rlike(_DAY), F.lit("day")).when(raw.rlike(_MONTH), F.lit("month"))
    date = F.when(shape == "month", F.concat(raw, F.lit("-01"))).when(shape.isNotNull(), F.substr(raw, F.lit(1), F.lit(10)))
    real = F.coalesce((F.substr(raw, F.lit(1), F.lit(4)) != "0000") & F.try_to_date(date, "yyyy-MM-dd").isNotNull(), F.lit(False))
    fine = real & shape.isin("day", "second")
    return {
        "capture_date": F.when(real, F.substr(raw, F.lit(1), F.lit(10))),
        "capture_precision": F.when(real, shape).otherwise(F.lit("unknown")),
        "month": F.when(real, F.substr(raw, F.lit(1), F.lit(7))),
        "day": F.when(fine, F.substr(raw, F.lit(1), F.lit(10))),
        "clock": F.when(real & (shape == "second"), F.substr(raw, F.lit(12), F.lit(5))),
    }


def checked_bound(value: str | None, pattern: str) -> str | None:
    """A bound in the form of ``CLOCK`` or ``MONTH``, or None; ValueError for anything else."""
    if value is not None and not re.fullmatch(pattern.strip("^$"), value):
        raise ValueError(f"not a valid bound: {value!r}")
    return value


def policy(mode: str, value: str | None, month: Column, day: Column) -> Column:
    """Whether a capture meets a policy (any, same_month, same_day); unknown parts never do."""
    if mode == "any":
        return F.lit(True)
    checked_bound(value, MONTH if mode == "same_month" else MONTH[:-1] + r"-(0[1-9]|[12][0-9]|3[01])$")
    column = {"same_month": month, "same_day": day}[mode]
    return F.coalesce(column == value, F.lit(False))


def clock_between(clock: Column, start: str | None, end: str | None, strict: bool = False) -> Column:
    """HH:MM within inclusive bounds; an unknown clock fails, or is an error if ``strict``."""
    if checked_bound(start, CLOCK) is None and checked_bound(end, CLOCK) is None:
        return F.lit(True)
    unknown = F.raise_error(F.lit("a capture has no clock")).cast("boolean") if strict else F.lit(False)
    out = F.lit(True)
    if start is not None:
        out &= clock >= start
    if end is not None:
        out &= clock <= end
    return F.when(clock.isNull(), unknown).otherwise(out)


def token(prefix: str, fingerprint: Column, size: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substr(fingerprint, F.lit(1), F.lit(size)))


def station_id(member_ids: Column) -> Column:
    """The station of a set of member ids, whatever their order."""
    return token("station_", F.sha2(F.to_json(F.array_sort(member_ids)), 256))


def seed(text: Column, modulus: int = 1 << 31) -> Column:
    return F.pmod(F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(modulus))


def clean_links(links: Column, lat: str = "lat", lng: str = "lng") -> Column:
    """Links with usable ids and places, in order; others are left out."""
    from .geo import valid_place

    return F.filter(links, lambda x: F.coalesce(x["id"].rlike(ID) & valid_place(x[lat], x[lng]), F.lit(False)))


def sanitised(text: Column, size: int = 64) -> Column:
    """A label of letters, digits, dot, dash and underscore, of bounded length."""
    return F.trim(F.substr(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit(1), F.lit(size)))
