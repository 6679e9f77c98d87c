"""Number, interval and level functions as native Column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Improvement levels from lowest to highest.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# How far a suggestion has proved itself, from worst to best.
EFFECTIVENESS = ("FAILED", "PENDING", "CONFIRMED")


def at(moment: Column | str | datetime) -> Column:
    """A point in time, free of the session time zone: a fixed one, or that of a column."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.to_timestamp_ntz(F.lit(text))


def days_before(moment: str | datetime, days: int) -> Column:
    return at(moment) - F.make_dt_interval(F.lit(days))


def interval_to_ms(interval: Column) -> Column:
    """Day-to-second interval to milliseconds with microsecond fractions."""
    seconds = (
        F.extract(F.lit("DAY"), interval) * 86400
        + F.extract(F.lit("HOUR"), interval) * 3600
        + F.extract(F.lit("MINUTE"), interval) * 60
        + F.extract(F.lit("SECOND"), interval)
    )
    return (seconds * 1000).cast("decimal(18,3)")


def plain_number(value: Column, digits: int) -> Column:
    """Fixed digits without separators, half-even on the binary value."""
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def _fixed(value: Column, digits: int) -> Column:
    # Exact ties go up.  With d digits a binary number can only be a tie when
    # it is an odd multiple of 1/2**(d+1).
    steps = 2 ** (digits + 1)
    scaled = value * steps
    tie = (scaled == F.floor(scaled)) & (F.floor(scaled) % 2 == 1)
    nudge = F.when(tie, F.lit(0.25 / 10**digits)).otherwise(F.lit(0.0))
    return plain_number(value + nudge, digits)


def duration_label(ms: Column) -> Column:
    """``850ms``, ``2.34s`` or ``1.50m``."""
    value = ms.cast("double")
    return (
        F.when(value < 1000, F.concat(_fixed(value, 0), F.lit("ms")))
        .when(value < 60000, F.concat(_fixed(value / 1000, 2), F.lit("s")))
        .otherwise(F.concat(_fixed(value / 60000, 2), F.lit("m")))
    )


def efficiency_ratio(examined: Column, returned: Column) -> Column:
    """Rows examined per row returned; null when nothing was examined."""
    per_row = F.greatest(F.coalesce(returned, F.lit(1)), F.lit(1))
    return F.when(examined > 0, examined.cast("double") / per_row.cast("double"))


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    rank = F.lit(0)
    for position, name in reversed(list(enumerate(order, start=1))):
        rank = F.when(value == name, F.lit(position)).otherwise(rank)
    return rank


def improvement_rank(level: Column) -> Column:
    """LOW 1, MEDIUM 2, HIGH 3, CRITICAL 4, anything else 0."""
    return _rank(level, LEVELS)


def level_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(level) for level in LEVELS]), rank - 1)


def effectiveness_rank(value: Column) -> Column:
    return _rank(value, EFFECTIVENESS)


def effectiveness_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(value) for value in EFFECTIVENESS]), rank - 1)


def gain_ratio(old: Column, new: Column) -> Column:
    """(old - new) / old; null when old is 0."""
    before, after = old.cast("double"), new.cast("double")
    return F.try_divide(before - after, before)
