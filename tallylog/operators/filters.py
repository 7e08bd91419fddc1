"""Log filters: argument checks and the predicates they stand for."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog import model
from tallylog.functions.cursors import Cursor, decode_text
from tallylog.functions.patterns import message_matches
from tallylog.functions.timestamps import date_literal, literal, parse_iso_text


class InvalidArgument(ValueError):
    """A call argument that no query can be made of."""


def check_limit(raw: object) -> int:
    if raw is None:
        return model.DEFAULT_LIMIT
    number = _number(raw.strip()) if isinstance(raw, str) else raw
    if not isinstance(number, (int, float)) or not float(number).is_integer():
        raise InvalidArgument(model.LIMIT_INTEGER)
    if not 1 <= number <= model.MAX_LIMIT:
        raise InvalidArgument(model.LIMIT_RANGE % model.MAX_LIMIT)
    return int(number)


_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)
_PREFIXED = re.compile(r"0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")


def _number(text: str) -> float | int | None:
    """Number of a parameter's text: decimal, or with a 0x, 0o or 0b prefix; empty counts as 0."""
    if not text:
        return 0
    if _PREFIXED.fullmatch(text):
        return int(text, 0)
    return float(text) if _DECIMAL.fullmatch(text) else None


def check_level(raw: object) -> str | None:
    if raw is not None and raw not in model.LEVELS:
        raise InvalidArgument(model.UNSUPPORTED_LEVEL % raw)
    return raw


def check_time(raw: object, name: str) -> datetime | None:
    if raw is None:
        return None
    moment = parse_iso_text(raw)
    if moment is None:
        raise InvalidArgument(model.INVALID_TIME % name)
    return moment


def check_cursor(raw: str | None) -> Cursor | None:
    if not raw:
        return None
    cursor = decode_text(raw)
    if cursor is None:
        raise InvalidArgument(model.INVALID_CURSOR)
    return cursor


def check_order(start: datetime | None, end: datetime | None) -> None:
    if start is not None and end is not None and end <= start:
        raise InvalidArgument(model.END_BEFORE_START)


_FIRST_MOMENT = datetime.min.replace(tzinfo=timezone.utc)


def _just_before(end: datetime) -> datetime:
    return end - timedelta(microseconds=1) if end > _FIRST_MOMENT else end


_QUERY_PARAMETERS = ("service", "level", "start", "end", "q", "limit", "cursor")
_AGGREGATE_PARAMETERS = ("service", "level", "start", "end", "q", "bucket", "group_by")
_ATTRIBUTE = "attributes."


def _arguments(parameters: Mapping[str, object], names: tuple[str, ...]) -> dict:
    found = {n: parameters[n] for n in names if n in parameters}
    for name in ("service", "q", "cursor"):
        if not isinstance(found.get(name, ""), str):
            del found[name]
    found["attributes"] = {
        name.removeprefix(_ATTRIBUTE): value
        for name, value in parameters.items()
        if name.startswith(_ATTRIBUTE) and isinstance(value, str)
    }
    return found


def query_arguments(parameters: Mapping[str, object]) -> dict:
    """Keyword arguments of a query from flat parameters such as ``attributes.region``."""
    return _arguments(parameters, _QUERY_PARAMETERS)


def aggregate_arguments(parameters: Mapping[str, object]) -> dict:
    """Keyword arguments of an aggregate call from flat parameters."""
    return _arguments(parameters, _AGGREGATE_PARAMETERS)


@dataclass(frozen=True)
class LogFilter:
    """Conditions that must all hold; one that is not given (or empty) does not apply."""

    service: str | None = None
    level: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    q: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)
    cursor: Cursor | None = None

    @classmethod
    def of(
        cls,
        service: str | None = None,
        level: str | None = None,
        start: str | None = None,
        end: str | None = None,
        q: str | None = None,
        attributes: Mapping[str, str] | None = None,
    ) -> LogFilter:
        """Filter from call arguments as text, checked in the contract's order."""
        since, until = check_time(start, "start"), check_time(end, "end")
        check_order(since, until)
        return cls(
            service=service,
            level=check_level(level),
            start=since,
            end=until,
            q=q,
            attributes=dict(attributes or {}),
        )

    def after(self, cursor: str | None) -> LogFilter:
        """The same filter, continued after the row a cursor names."""
        return replace(self, cursor=check_cursor(cursor))

    def since(self, bound: datetime | None) -> LogFilter:
        """The same filter with a lower time bound at least this late."""
        if bound is None or (self.start is not None and self.start >= bound):
            return self
        return replace(self, start=bound)

    def until(self, bound: datetime | None) -> LogFilter:
        """The same filter with this upper time bound (exclusive)."""
        return replace(self, end=bound)

    def days(self) -> list[Column]:
        """Bounds on the partition column that the time range implies."""
        day, found = F.col("day"), []
        if self.start is not None:
            found.append(day >= date_literal(self.start))
        if self.end is not None:
            found.append(day <= date_literal(_just_before(self.end)))
        if self.cursor is not None:
            found.append(day <= date_literal(self.cursor.ts))
        return found

    def may_hold(self, day: date) -> bool:
        """Whether rows of this day can be in the time range."""
        lasts = [moment.date() for moment in (self.end and _just_before(self.end), self.cursor and self.cursor.ts) if moment]
        return (self.start is None or day >= self.start.date()) and all(day <= last for last in lasts)

    def predicates(self, by_day: bool) -> list[Column]:
        """One predicate per condition.

        ``by_day`` adds the same bounds on the partition column: a bound on
        ``ts`` alone opens the files of every day. The cursor condition is
        written out, since a comparison of structs does not reach the scan.
        """
        ts = F.col("ts")
        found = self.days() if by_day else []
        if self.start is not None:
            found.append(ts >= literal(self.start))
        if self.end is not None:
            found.append(ts < literal(self.end))
        if self.cursor is not None:
            at = literal(self.cursor.ts)
            found.append(ts <= at)
            found.append((ts < at) | (F.col("id") < self.cursor.id))
        if self.service:
            found.append(F.col("service") == self.service)
        if self.level:
            found.append(F.col("level") == self.level)
        if self.q:
            found.append(message_matches(F.col("message"), self.q))
        for key, value in self.attributes.items():
            found.append(F.col("attr")[key] == value)
        return found

    def apply(self, logs: DataFrame) -> DataFrame:
        """Rows that meet every condition; all rows when there is none."""
        predicates = self.predicates(by_day="day" in logs.columns)
        return logs.where(reduce(operator.and_, predicates)) if predicates else logs
