"""Event-time expressions. All arithmetic is on whole microseconds since the epoch."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000

# The usual form of a timestamp text, which a plain cast reads.
PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?$"

# All accepted texts: extended or compact ISO date, optional time of day, optional offset.
ISO_TIME = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8})"
    r"(?:[^0-9](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}|\d{6}(?:[.,]\d+)?)"
    r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def micros(time: Column | str) -> Column:
    return F.unix_micros(time)


def timestamp(us: Column | str) -> Column:
    return F.timestamp_micros(us)


def floor_to(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def ceil_to(us: Column, step: int) -> Column:
    return us + F.pmod(-us, F.lit(step))


def iso_timestamp(text: Column) -> Column:
    """Timestamp of an ISO text, UTC when it names no offset; null when it is not one."""
    return F.when(text.rlike(PLAIN_TIME), text.try_cast("timestamp")).when(
        text.rlike(ISO_TIME), _plain_form(text).try_cast("timestamp")
    )


def _plain_form(text: Column) -> Column:
    date = F.regexp_replace(F.regexp_extract(text, ISO_TIME, 1), "-", "")
    clock = F.regexp_replace(F.regexp_extract(text, ISO_TIME, 2), ":", "")
    zone = F.regexp_replace(F.regexp_extract(text, ISO_TIME, 3), "[:Z]", "")
    # Padded to yyyyMMdd HHmmss ffffff zzzzz, then cut into the usual form.
    digits = F.concat(
        date,
        F.rpad(F.regexp_extract(clock, r"^\d*", 0), 6, "0"),
        F.rpad(F.regexp_extract(clock, r"[.,](\d+)", 1), 6, "0"),
        F.when(zone == "", "+0000").otherwise(F.rpad(zone, 5, "0")),
    )
    return F.regexp_replace(
        digits,
        r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)(\d{6})(.\d\d)(\d\d)$",
        "$1-$2-$3 $4:$5:$6.$7$8:$9",
    )


def epoch_timestamp(seconds: Column) -> Column:
    """Timestamp of a decimal number of seconds, null outside the years 1 to 9999."""
    first, end = -62_135_596_800, 253_402_300_800
    # Bounded before it is multiplied, so that no number is too large for the product.
    bounded = F.when((seconds >= first) & (seconds < end), seconds).cast("decimal(21,9)")
    us = F.bround(bounded * SECOND, 0).cast("bigint")
    return F.when(us < end * SECOND, F.timestamp_micros(us))


@dataclass(frozen=True)
class Windows:
    """Windows ``[start, start + size)`` with starts at the multiples of ``slide`` since the epoch."""

    size_seconds: int = 300
    slide_seconds: int = 1

    def __post_init__(self):
        if self.size_seconds <= 0 or self.slide_seconds <= 0:
            raise ValueError("window size and slide must be positive")
        if self.size_seconds < self.slide_seconds:
            raise ValueError("window size must not be smaller than the slide")

    @property
    def size(self) -> int:
        return self.size_seconds * SECOND

    @property
    def slide(self) -> int:
        return self.slide_seconds * SECOND

    @property
    def pane(self) -> int:
        """Longest slice no window boundary cuts."""
        return gcd(self.size, self.slide)

    @property
    def wide(self) -> bool:
        """Whether many windows share each pane."""
        return self.size % self.slide == 0 and self.size // self.slide >= 12

    def pane_of(self, us: Column) -> Column:
        return floor_to(us, self.pane)

    def first_start(self, us: Column) -> Column:
        """Start of the earliest window that contains the instant."""
        return floor_to(us - self.size, self.slide) + self.slide

    def last_start(self, us: Column) -> Column:
        return floor_to(us, self.slide)

    def first_open_start(self, watermark_us: Column) -> Column:
        """Start of the earliest window that a watermark leaves open (it closes ends <= it)."""
        return floor_to(watermark_us - self.size, self.slide) + self.slide

    def starts(self, first: Column, last: Column) -> Column:
        return F.sequence(first, last, F.lit(self.slide))

    def bounds(self, start_us: Column | str) -> list[Column]:
        start = F.col(start_us) if isinstance(start_us, str) else start_us
        return [
            window_id(start, start + self.size).alias("window_id"),
            timestamp(start).alias("window_start"),
            timestamp(start + self.size).alias("window_end"),
        ]


def window_id(start_us: Column, end_us: Column) -> Column:
    """``{start}_{end}`` in epoch seconds, written as floats: ``1704067200.0_1704070800.0``."""
    return F.concat_ws("_", _seconds_text(start_us), _seconds_text(end_us))


def _seconds_text(us: Column) -> Column:
    return F.concat((floor_to(us, SECOND) / SECOND).cast("bigint").cast("string"), F.lit(".0"))


def window_bounds(identifier: Column) -> list[Column]:
    """Start and end timestamps of a window id."""
    parts = F.split(identifier, "_")
    return [
        timestamp((F.get(parts, F.lit(i)).try_cast("double") * SECOND).try_cast("bigint")).alias(name)
        for i, name in enumerate(("window_start", "window_end"))
    ]
