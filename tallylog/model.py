"""Data model of the log store: table schema and the fixed values of its contract."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: these must equal the published contract word for word. ---

LEVELS = ("debug", "info", "warn", "error")

ENTRY_FIELDS = ("timestamp", "level", "service", "message", "attributes")

BUCKET_SECONDS = {"1m": 60, "1h": 3600, "1d": 86400}

GROUP_COLUMNS = ("service", "level")

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000

FUTURE_TOLERANCE_SECONDS = 300

RETENTION_DAYS = 30

REFUSED_BODY = "request body must be a JSON object with a non-empty 'logs' array"

START_REQUIRED = "'start' is required"
END_REQUIRED = "'end' is required"
BUCKET_INVALID = "bucket must be one of: 1m, 1h, 1d"
GROUP_INVALID = "group_by must be 'service' or 'level'"
LIMIT_INTEGER = "limit must be an integer"
LIMIT_RANGE = "limit must be between 1 and %s"
UNSUPPORTED_LEVEL = "unsupported log level: '%s'"
INVALID_TIME = "invalid timestamp for '%s'"
INVALID_CURSOR = "invalid or malformed cursor"
END_BEFORE_START = "'end' must be later than 'start'"

# Not in the contract: what this engine can't read, whatever the contract says of it.
BODY_LIMIT = "request body exceeds a limit of the JSON reader (key length or nesting)"
ENTRY_LIMIT = "entry exceeds a limit of the JSON reader"

NOT_AN_OBJECT = "entry must be a JSON object"
TIMESTAMP_REQUIRED = "timestamp is required"
TIMESTAMP_INVALID = "invalid timestamp: must be a valid ISO 8601 string"
TIMESTAMP_FUTURE = "timestamp must not be more than five minutes in the future"
LEVEL_REQUIRED = "level is required"
LEVEL_INVALID = "invalid level: '%s'"
SERVICE_REQUIRED = "service is required"
SERVICE_EMPTY = "service must be a non-empty string"
MESSAGE_REQUIRED = "message is required"
MESSAGE_EMPTY = "message must be a non-empty string"
WRONG_TYPE = "Expected %s, received %s"
ATTRIBUTE_VALUE = "Invalid input"
UNKNOWN_KEYS = "Unrecognized key(s) in object: %s"

# --- Table schemas ---

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("attr", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ingested_at", T.TimestampType()),
        # Names the write that stored the row, e.g. "<stream>/<micro-batch>". One
        # file holds one load, so its min/max statistics find a load's files.
        T.StructField("load", T.StringType()),
        # How many attributes had a column of their own when the row was written.
        T.StructField("promoted", T.IntegerType()),
        T.StructField("day", T.DateType()),
    ]
)

REJECT_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        # NULL when the whole batch was refused.
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("load", T.StringType()),
        # UTC day of ``ingested_at``; a rejected entry may have no time of its own.
        T.StructField("day", T.DateType()),
    ]
)

#: What became of one delivery, partitioned by day of ingest.
OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("load", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

PAGE_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")
