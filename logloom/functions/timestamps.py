"""Text to naive-UTC timestamps. Whatever is not a valid time becomes NULL.

The session time zone has to be UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import MONTHS, S, SPACES

_EPOCH = datetime(1970, 1, 1)
_FIRST_SECOND = -62135596800  # 0001-01-01 00:00:00
_LAST_SECOND = 253402300799  # 9999-12-31 23:59:59

_ACCESS = r"^[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-](?:0[0-9]|1[0-7])[0-5][0-9]\z"
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?\z"
# groups: year, -, month, day, hour, :, minute, second, fraction, zone, sign, hours, :, minutes, seconds
_ISO = (
    r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})"
    r"(?:[\s\S]([0-9]{2})(?:(:?)([0-9]{2})(?:\6([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(Z|([+-])([0-9]{2})(?:(:?)([0-9]{2})(?:\13([0-9]{2}))?)?)?)?\z"
)


def _naive(text: Column) -> Column:
    """A canonical ``yyyy-MM-dd HH:mm:ss[.f]`` text; years run from 1."""
    return F.when(~text.startswith("0000"), text.try_cast("timestamp_ntz"))


def app_ts(date: Column, separator: Column, time: Column) -> Column:
    """Date and time of an application line: one separator character, ``,`` or ``.`` before the fraction."""
    return F.when(
        F.length(separator) == 1, _naive(F.concat(date, F.lit(" "), F.replace(time, F.lit(","), F.lit("."))))
    )


def android_ts(date: Column, time: Column, reference_year: int | None = None) -> Column:
    """``MM-dd`` and ``HH:mm:ss.f`` carry no year: take ``reference_year`` or the current one."""
    year = F.lit(reference_year) if reference_year is not None else F.year(F.current_date())
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), date, F.lit(" "), time)
    # At most six digits of fraction after "HH:mm:ss.".
    return F.when(F.length(time) <= 15, _naive(text))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def access_ts(text: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss +hhmm`` to UTC; a zone of another shape is ignored."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])

    def read(words: Column) -> Column:
        clock = words[0]
        zone = F.coalesce(F.get(words, F.lit(1)), F.lit("+0000"))
        local = _naive(
            F.concat(
                F.substring(clock, 8, 4), F.lit("-"),
                F.try_element_at(months, F.substring(clock, 4, 3)), F.lit("-"),
                F.substring(clock, 1, 2), F.lit(" "),
                F.substring(clock, 13, 2), F.lit(":"),
                F.substring(clock, 16, 2), F.lit(":"),
                F.substring(clock, 19, 2),
            )
        )
        hours = F.concat(F.substring(zone, 1, 1), F.substring(zone, 2, 2)).try_cast("int")
        minutes = F.concat(F.substring(zone, 1, 1), F.substring(zone, 4, 2)).try_cast("int")
        offset = F.when(zone.rlike(r"^[+-][0-9]{4}\z"), F.make_dt_interval(hours=hours, mins=minutes))
        signed = (F.length(zone) == 5) & F.substring(zone, 1, 1).isin("+", "-")
        return F.when(
            clock.rlike(r"^[0-9]{2}.[A-Z][a-z]{2}.[0-9]{4}.[0-9]{2}.[0-9]{2}.[0-9]"),
            F.when(signed, local - offset).otherwise(local),
        )

    # The usual notation needs no taking apart.
    return F.when(
        text.rlike(_ACCESS), F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).cast("timestamp_ntz")
    ).otherwise(_once(F.split(F.btrim(text, F.lit(SPACES)), f"{S}+"), read))


def iso_ts(text: Column) -> Column:
    """ISO 8601 date, or date and time with any one separator; offsets are applied, none means UTC."""
    picked = ["$1", "$3", "$4", "$5", "$7", "$8", "$9", "$11", "$12", "$14", "$15"]

    def read(f: Column) -> Column:
        def part(i: int, empty: str) -> Column:
            return F.when(f[i] == "", F.lit(empty)).otherwise(f[i])

        local = _naive(
            F.concat(
                f[0], F.lit("-"), f[1], F.lit("-"), f[2], F.lit(" "), part(3, "00"),
                F.lit(":"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit("."), part(6, "0"),
            )
        )
        hours, minutes, seconds = (F.concat(f[7], part(i, "0")).try_cast("int") for i in (8, 9, 10))
        size = F.abs(hours * 3600 + minutes * 60 + seconds)
        valid = (F.abs(minutes) < 60) & (F.abs(seconds) < 60) & (size < 86400)
        offset = F.make_dt_interval(hours=hours, mins=minutes, secs=seconds.cast("decimal(18,6)"))
        return F.when(f[7] == "", local).when(valid, local - offset)

    fields = F.split(F.regexp_replace(text, _ISO, "\u0000".join(picked)), "\u0000")
    # The usual notation needs no taking apart.
    return F.when(text.rlike(_PLAIN), _naive(F.rtrim(text, F.lit("Z")))).when(
        text.rlike(_ISO), _once(fields, read)
    )


def epoch_ts(seconds: Column) -> Column:
    """Epoch seconds as a double, rounded to the nearest microsecond; out of range is NULL."""
    whole = F.floor(seconds)
    fraction = (F.rint((seconds - whole) * 1_000_000) / 1_000_000).cast("decimal(18,6)")
    span = F.make_dt_interval(secs=(whole.cast("decimal(18,0)") + fraction).cast("decimal(18,6)"))
    in_range = (seconds >= _FIRST_SECOND) & (seconds <= _LAST_SECOND) & ~F.isnan(seconds)
    return F.when(in_range, F.lit(_EPOCH).cast("timestamp_ntz") + span)
