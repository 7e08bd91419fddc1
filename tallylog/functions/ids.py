"""Row ids and partition names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_from(*parts: Column) -> Column:
    """UUID-shaped text derived from the parts.

    The same parts give the same id, so a task that runs again, or a stream
    batch that is replayed, produces the same rows.
    """
    text = F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)))
    for position in (21, 17, 13, 9):
        text = F.overlay(text, F.lit("-"), position, 0)
    return text


def partition_name(day: Column) -> Column:
    """``logs_2024_01_31``"""
    return F.date_format(day, "'logs_'yyyy_MM_dd")
