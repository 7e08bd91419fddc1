"""Opaque page cursors: base64url of ``{"ts": ..., "id": ...}``."""

from __future__ import annotations

import base64
import binascii
import json
import re
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_MICROS = "%Y-%m-%dT%H:%M:%S.%fZ"
_MICROS_SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"


class Cursor(NamedTuple):
    ts: datetime
    id: str


def cursor_column(ts: Column, id: Column) -> Column:
    """Cursor that continues after each row."""
    moment = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(moment.alias("ts"), id.alias("id")))
    encoded = F.base64(F.encode(body, "UTF-8"))
    # base64() breaks lines after 76 characters unless the session says otherwise.
    return F.translate(encoded, "+/=\r\n", "-_")


def decode_column(text: Column) -> Column:
    """``struct(ts, id)`` of a cursor, NULL when the text is not a valid one."""
    binary = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    body = F.from_json(F.try_validate_utf8(binary.cast("string")), "ts string, id string")
    ts = F.when(body["ts"].rlike(_MICROS_SHAPE), body["ts"].try_cast("timestamp"))
    return F.when(
        ts.isNotNull() & body["id"].rlike(_UUID),
        F.struct(ts.alias("ts"), F.lower(body["id"]).alias("id")),
    )


def decode_text(text: str) -> Cursor | None:
    """Driver-side counterpart of :func:`decode_column` for the one cursor of a call."""
    plain = text.rstrip("=").replace("+", "-").replace("/", "_")
    try:
        raw = base64.b64decode(plain + "=" * (-len(plain) % 4), altchars=b"-_", validate=True)
        body = json.loads(raw.decode("utf-8"))
        if not re.fullmatch(_UUID, body["id"]):
            return None
        moment = datetime.strptime(body["ts"], _MICROS).replace(tzinfo=timezone.utc)
    except (binascii.Error, ValueError, KeyError, TypeError):
        return None
    return Cursor(moment, body["id"].lower())
