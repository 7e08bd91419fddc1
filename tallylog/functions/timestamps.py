"""ISO 8601 text to timestamps and back, and time buckets."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The end is "no further character", since "$" also matches before a final newline.
# year [-month [-day]] [T hour:minute [:second [.fraction]] [zone]]; the T may be a space or
# lower case, the zone may lack its colon or minutes, a six-digit year may have a sign.
_YEAR = r"(\d{4}|\+00\d{4})"
_DATE = rf"{_YEAR}(?:-(0[1-9]|1[0-2])(?:-(0[1-9]|[12]\d|3[01]))?)?"
_CLOCK = r"([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.(\d+))?)?"
_MIDNIGHT = r"24:00(?::00(?:\.0+)?)?"
_ZONE = r"([Zz]|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?"
ISO_SHAPE = rf"^{_DATE}(?:[Tt ](?:{_CLOCK}|({_MIDNIGHT})){_ZONE})?(?![\s\S])"

_ISO = re.compile(ISO_SHAPE, re.ASCII)

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _from_parts(parts: Column) -> Column:
    """Timestamp from the nine groups of the shape, an empty text where one is absent."""

    def number(n: int, default: int = 0) -> Column:
        return F.coalesce(parts[n - 1].try_cast("bigint"), F.lit(default))

    zone = F.replace(parts[8], F.lit(":"), F.lit(""))
    zone_minutes = F.coalesce(
        F.substring(zone, 2, 2).try_cast("bigint") * 60
        + F.coalesce(F.substring(zone, 4, 2).try_cast("bigint"), F.lit(0)),
        F.lit(0),
    ) * F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    first_of_month = F.make_date(number(1).cast("int"), number(2, 1).cast("int"), F.lit(1))
    days = F.unix_date(first_of_month).cast("bigint") + number(3, 1) - 1
    hours = F.when(parts[7] != "", F.lit(24)).otherwise(number(4))
    seconds = days * 86400 + hours * 3600 + number(5) * 60 + number(6) - zone_minutes * 60
    millis = F.substring(F.rpad(parts[6], 3, "0"), 1, 3).cast("bigint")
    return F.timestamp_millis(seconds * 1000 + millis)


def parse_iso(text: Column) -> Column:
    """Timestamp at millisecond precision, NULL when the text is not ISO 8601.

    The shape check is needed because a cast alone also takes texts such as
    ``14:00``. The cast reads the usual forms; the few it refuses (minutes with
    a zone, ``24:00``, a day past the month's end, which rolls over) are put
    together from their parts. That part is a lambda, which keeps it out of
    the generated code of the common path.
    """
    groups = F.split(F.regexp_replace(text, ISO_SHAPE, "$1|$2|$3|$4|$5|$6|$7|$8|$9"), r"\|")
    rare = F.transform(F.array(groups), _from_parts)[0]
    return F.when(
        text.rlike(ISO_SHAPE),
        F.date_trunc("MILLISECOND", F.coalesce(text.try_cast("timestamp"), rare)),
    )


def parse_iso_text(text: object) -> datetime | None:
    """Driver-side counterpart of :func:`parse_iso` for call arguments."""
    match = _ISO.match(text) if isinstance(text, str) else None
    if match is None:
        return None
    year, month, day, hour, minute, second, fraction, midnight, zone = match.groups()
    try:
        moment = datetime(int(year), int(month or 1), 1, tzinfo=timezone.utc)
        moment += timedelta(
            days=int(day or 1) - 1,
            hours=24 if midnight else int(hour or 0),
            minutes=int(minute or 0),
            seconds=int(second or 0),
            milliseconds=int((fraction or "0").ljust(3, "0")[:3]),
        )
        if zone and zone not in "Zz":
            offset = timedelta(hours=int(zone[1:3]), minutes=int(zone[3:].lstrip(":") or 0))
            moment = moment + offset if zone[0] == "-" else moment - offset
    except (ValueError, OverflowError):
        # Before year 1 or after 9999: the first or last moment there is bounds the same rows.
        edge = datetime.min if int(year) <= 1 else datetime.max
        return edge.replace(tzinfo=timezone.utc)
    return moment


def literal(moment: datetime) -> Column:
    """Timestamp literal for an aware datetime, whatever the driver's own zone is."""
    micros = (moment - _EPOCH) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def date_literal(moment: datetime) -> Column:
    """The UTC day of an aware datetime; as text, which holds for every year."""
    return F.lit(moment.date().isoformat()).cast("date")


def iso_millis(ts: Column) -> Column:
    """``2024-01-31T08:00:00.123Z``"""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(ts: Column) -> Column:
    """``2024-01-31T08:00:00.123456Z``"""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def bucket_start_seconds(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket, in seconds, rounding toward the past.

    A BIGINT is the cheapest grouping key for the hash aggregate, and plain
    integer arithmetic is exact for timestamps before 1970 too.
    """
    at = F.unix_seconds(ts)
    return at - F.pmod(at, F.lit(seconds).cast("bigint"))


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(bucket_start_seconds(ts, seconds))
