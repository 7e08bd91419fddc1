"""Case-insensitive message patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WILDCARDS = "%_"
_ESCAPE = "\\"


def contains_pattern(q: str) -> str:
    """LIKE pattern for "contains ``q``", where ``%``, ``_`` and ``\\`` in ``q`` keep
    their pattern meaning.

    A backslash before an ordinary character stands for that character, which
    LIKE in Spark refuses, so the backslash is left out there. A backslash at
    the end of ``q`` escapes the closing ``%``: the message must then end in
    a percent sign.
    """
    pattern = "%" + q + "%"
    out = []
    escaped = False
    for char in pattern:
        if escaped:
            out.append(_ESCAPE + char if char in _WILDCARDS + _ESCAPE else char)
            escaped = False
        elif char == _ESCAPE:
            escaped = True
        else:
            out.append(char)
    return "".join(out)


def plain_text(pattern: str) -> str | None:
    """The text ``t`` if ``pattern`` means just "contains t", else None."""
    if len(pattern) < 2 or not pattern.startswith("%") or not pattern.endswith("%"):
        return None
    text, escaped = [], False
    for char in pattern[1:-1]:
        if escaped:
            text.append(char)
            escaped = False
        elif char == _ESCAPE:
            escaped = True
        elif char in _WILDCARDS:
            return None
        else:
            text.append(char)
    return None if escaped else "".join(text)


def message_matches(message: Column, q: str) -> Column:
    """Message matches ``%q%`` regardless of case.

    Without live wildcards this is a substring search, which runs inside
    generated code; the general form needs a regular expression per row.
    """
    pattern = contains_pattern(q)
    text = plain_text(pattern)
    if text is not None:
        return F.lower(message).contains(F.lower(F.lit(text)))
    return message.ilike(pattern)


def literal_parts(q: str) -> list[str]:
    """The texts between live wildcards that a message matching ``%q%`` must hold, case aside."""
    parts, text, escaped = [], [], False
    for char in "%" + q + "%":
        if escaped:
            text.append(char)
            escaped = False
        elif char == _ESCAPE:
            escaped = True
        elif char in _WILDCARDS:
            parts.append("".join(text))
            text = []
        else:
            text.append(char)
    return [part for part in [*parts, "".join(text)] if part]
