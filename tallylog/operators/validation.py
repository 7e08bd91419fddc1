"""Entry validation: one projection gives each entry a reason, or none."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog import model
from tallylog.functions.ids import uuid_from
from tallylog.functions.json_text import (
    VARIANT_MAP,
    attribute_classes,
    attribute_json,
    attribute_map,
    has_nested,
    kind_word,
)
from tallylog.functions.timestamps import literal, parse_iso
from tallylog.session import fresh_name


_TEXT_FIELDS = ("timestamp", "level", "service", "message")


def _missing_or_not_text(name: str, required: str) -> list[tuple[Column, Column]]:
    schema = F.col(f"{name}_schema")
    return [
        (schema.isNull(), F.lit(required)),
        (schema != "STRING", F.format_string(model.WRONG_TYPE, F.lit("string"), kind_word(schema))),
    ]


def validate(
    entries: DataFrame, as_of: Column | datetime, metrics: str | None = None
) -> DataFrame:
    """Check entries against the contract; the first failing rule gives ``reason``.

    ``entries`` comes from :func:`tallylog.sources.envelopes.explode_entries`.
    A timestamp more than five minutes after ``as_of`` is refused. A whole
    batch that was refused stays as one row with a NULL index.

    Adds ``reason`` and ``ingested_at`` (``as_of``), and for accepted entries ``ts`` (milliseconds), ``level``,
    ``service``, ``message``, ``attributes`` (JSON), ``attr`` (text map) and ``id``.
    No shuffle is needed. The counts of accepted and rejected entries and of
    refused batches are observed under the name ``metrics`` (a new one if not given, so that
    validated frames can be combined); a stream shows them in its progress.
    """
    now = literal(as_of) if isinstance(as_of, datetime) else as_of
    latest = F.date_trunc("MILLISECOND", now) + F.expr(
        f"INTERVAL {model.FUTURE_TOLERANCE_SECONDS} SECONDS"
    )

    # Each step is its own projection, so that later ones use the column and
    # not a copy of the expression.
    field = F.col("field")
    given = field["attributes"]
    typed = entries.select(
        "batch_id",
        "index",
        "entry",
        "unknown",
        "body",
        "text",
        "beyond_limit",
        field.isNull().alias("not_object"),
        *(F.schema_of_variant(field[name]).alias(f"{name}_schema") for name in _TEXT_FIELDS),
        *(F.try_variant_get(field[name], "$", "string").alias(name) for name in _TEXT_FIELDS),
        F.schema_of_variant(given).alias("attributes_schema"),
        F.coalesce(given, F.parse_json(F.lit("{}"))).alias("given"),
        F.when(given.isNull(), F.expr(f"cast(map() as {VARIANT_MAP})"))
        .otherwise(F.try_variant_get(given, "$", VARIANT_MAP))
        .alias("values"),
    )
    parsed = typed.withColumns(
        {"ts": parse_iso(F.col("timestamp")), "classes": attribute_classes(F.col("values"))}
    )

    quoted = F.transform("unknown", lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    rules = [
        (F.col("index").isNull() & F.col("beyond_limit"), F.lit(model.BODY_LIMIT)),
        (F.col("index").isNull(), F.lit(model.REFUSED_BODY)),
        (F.col("beyond_limit"), F.lit(model.ENTRY_LIMIT)),
        (F.col("not_object"), F.lit(model.NOT_AN_OBJECT)),
        *_missing_or_not_text("timestamp", model.TIMESTAMP_REQUIRED),
        (F.col("ts").isNull(), F.lit(model.TIMESTAMP_INVALID)),
        *_missing_or_not_text("level", model.LEVEL_REQUIRED),
        *_missing_or_not_text("service", model.SERVICE_REQUIRED),
        (F.col("service") == "", F.lit(model.SERVICE_EMPTY)),
        *_missing_or_not_text("message", model.MESSAGE_REQUIRED),
        (F.col("message") == "", F.lit(model.MESSAGE_EMPTY)),
        (
            F.col("values").isNull(),
            F.format_string(
                model.WRONG_TYPE, F.lit("object"), kind_word(F.col("attributes_schema"))
            ),
        ),
        (has_nested(F.col("classes")), F.lit(model.ATTRIBUTE_VALUE)),
        (
            F.size("unknown") > 0,
            F.format_string(model.UNKNOWN_KEYS, F.array_join(quoted, ", ")),
        ),
        (
            ~F.col("level").isin(*model.LEVELS),
            F.format_string(model.LEVEL_INVALID, F.col("level")),
        ),
        (F.col("ts") > latest, F.lit(model.TIMESTAMP_FUTURE)),
    ]
    reason = F.coalesce(*(F.when(broken, text) for broken, text in rules))

    accepted = F.col("reason").isNull()
    # Counting here also keeps a later filter on the reason above this point; pushed
    # further down, it would evaluate all the rules a second time.
    checked = parsed.withColumn("reason", reason).observe(
        metrics or fresh_name("validation"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(~accepted & F.col("index").isNotNull()).alias("rejected"),
        F.count_if(F.col("index").isNull()).alias("refused_batches"),
    )
    attributes = (F.col("given"), F.col("values"), F.col("classes"))
    return checked.select(
        "batch_id",
        "index",
        "reason",
        F.when(accepted, uuid_from(F.col("batch_id"), F.col("index"))).alias("id"),
        F.when(accepted, F.col("ts")).alias("ts"),
        F.when(accepted, F.col("level")).alias("level"),
        F.when(accepted, F.col("service")).alias("service"),
        F.when(accepted, F.col("message")).alias("message"),
        F.when(accepted, attribute_json(*attributes)).alias("attributes"),
        F.when(accepted, attribute_map(*attributes)).alias("attr"),
        F.when(~accepted, F.coalesce(F.to_json("entry"), F.col("text"), F.col("body"))).alias("raw"),
        now.alias("ingested_at"),
    )


def accepted_entries(validated: DataFrame) -> DataFrame:
    """Entries without a reason, with the columns of the log table's input."""
    return validated.where(F.col("reason").isNull()).drop("reason", "raw")


def rejected_entries(validated: DataFrame) -> DataFrame:
    """Entries with their reason; a refused batch has one row with a NULL index."""
    return validated.where(F.col("reason").isNotNull()).select(
        "batch_id", "index", "reason", "raw", "ingested_at"
    )


def batch_outcome(validated: DataFrame) -> DataFrame:
    """Accepted and rejected counts per batch, ``refused`` when nothing was accepted.

    ``error`` is the reason of a batch refused as a whole. The entries of a batch come
    out of one row and are still together, so the partial aggregate shrinks each batch to one
    row before the shuffle.
    """
    ok = F.col("reason").isNull()
    whole = F.col("index").isNull()
    counts = validated.groupBy("batch_id").agg(
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok & ~whole).alias("rejected"),
        F.max(F.when(whole, F.col("reason"))).alias("error"),
        F.max("ingested_at").alias("ingested_at"),
    )
    return counts.select(
        "batch_id",
        "accepted",
        "rejected",
        F.when(F.col("accepted") > 0, "accepted").otherwise("refused").alias("outcome"),
        "error",
        "ingested_at",
    )
