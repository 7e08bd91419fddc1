"""The same results in SQL for DuckDB, written from the rules and not from the engine."""

from __future__ import annotations

from tallylog import model
from tallylog.sources.event_logs import BROKEN_SQL, ENTRY_SQL, MORE_ENTRY_SQL

_MILLIS = "'%Y-%m-%dT%H:%M:%S.%gZ'"
_MICROS = "'%Y-%m-%dT%H:%M:%S.%fZ'"

LOGS = """
logs AS (
  SELECT
    concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-',
           substr(h, 17, 4), '-', substr(h, 21, 12)) AS id,
    date_trunc('millisecond', ts) AS ts,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn'
                    WHEN 'purchase' THEN 'info' ELSE 'debug' END AS level,
    concat('svc-', CAST(user_id % 7 AS VARCHAR)) AS service,
    concat(event_type, '_', CAST(user_id AS VARCHAR),
           CASE WHEN event_id % 10 = 0 THEN ' 100% DONE' ELSE ' ok' END) AS message,
    concat(substr(props, 1, length(props) - 1), ', "user_id": "', CAST(user_id AS VARCHAR),
           '", "vip": ', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS attributes,
    CAST(ts AS DATE) AS day
  FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
)
"""

_PAGE = f"id, strftime(ts, {_MILLIS}) AS timestamp, level, service, message, attributes"


def _attr(key: str) -> str:
    return f"""json_extract_string(attributes, '$."{key}"')"""


def _filtered(condition: str) -> str:
    return f"WITH {LOGS} SELECT {_PAGE} FROM logs WHERE {condition}"


def _bodies(entry_sql: str) -> str:
    entry = entry_sql.replace("{iso}", f"strftime(ts, {_MICROS})")
    return f"""
bodies AS (
  SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch_id,
         concat('{{"logs":[', string_agg({entry}, ',' ORDER BY event_id), ']}}') AS raw
  FROM events GROUP BY 1
)
"""


_DELIVERIES = f"""
{_bodies(ENTRY_SQL)},
deliveries AS (
  SELECT batch_id, raw FROM bodies
  UNION ALL SELECT -batch_id - 1, {BROKEN_SQL} FROM bodies
  UNION ALL SELECT batch_id + 1000000000, '{{"logs":[{{"level":"info","service":"s","message":"m"}}]}}'
  FROM bodies
)
"""

_REASON = """
CASE event_id % 20
  WHEN 0 THEN 'timestamp is required'
  WHEN 1 THEN 'invalid level: ''critical'''
  WHEN 2 THEN 'service must be a non-empty string'
  WHEN 3 THEN 'entry must be a JSON object'
  WHEN 4 THEN 'Invalid input'
  WHEN 5 THEN 'Unrecognized key(s) in object: ''host'''
  WHEN 6 THEN 'timestamp must not be more than five minutes in the future'
  WHEN 7 THEN 'Expected string, received number'
  WHEN 8 THEN 'invalid timestamp: must be a valid ISO 8601 string'
END
"""

_MORE_REASON = """
CASE event_id % 20
  WHEN 0 THEN 'Expected string, received null'
  WHEN 1 THEN 'level is required'
  WHEN 2 THEN 'Expected string, received boolean'
  WHEN 3 THEN 'service is required'
  WHEN 4 THEN 'Expected string, received object'
  WHEN 5 THEN 'message is required'
  WHEN 6 THEN 'message must be a non-empty string'
  WHEN 7 THEN 'Expected object, received null'
  WHEN 8 THEN 'Expected object, received array'
  WHEN 9 THEN 'Invalid input'
  WHEN 10 THEN 'Unrecognized key(s) in object: ''zone'', ''host'''
  WHEN 11 THEN 'invalid timestamp: must be a valid ISO 8601 string'
  WHEN 12 THEN 'entry must be a JSON object'
  WHEN 13 THEN 'entry must be a JSON object'
  WHEN 14 THEN 'timestamp must not be more than five minutes in the future'
  WHEN 16 THEN 'Invalid input'
  WHEN 17 THEN 'invalid level: ''INFO'''
  WHEN 18 THEN 'Expected string, received number'
END
"""

_BATCH = "CAST(floor(event_id / 100) AS BIGINT)"
_INDEX = "CAST(event_id % 100 AS INTEGER)"


def _uuid(text: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "concat_ws('-', " + ", ".join(f"substr(md5({text}), {a}, {n})" for a, n in cuts) + ")"


_ACCEPTED_ID = _uuid(f"concat({_BATCH}, '/', {_INDEX})")


def _reasons(reason: str) -> str:
    return f"SELECT {_BATCH} AS batch_id, {_INDEX} AS index, {reason} AS reason FROM events"


def _counts(bucket: str, group: str | None, condition: str) -> str:
    seconds = model.BUCKET_SECONDS[bucket]
    start = f"make_timestamp(CAST(floor(epoch_us(ts) / {seconds}000000.0) * {seconds} AS BIGINT) * 1000000)"
    return f"""
WITH {LOGS}
SELECT strftime({start}, {_MILLIS}) AS start,
       {group or "CAST(NULL AS VARCHAR)"} AS "group",
       CAST(count(*) AS INTEGER) AS count
FROM logs WHERE {condition} GROUP BY 1{", 2" if group else ""}
"""


_IN_MONTH = "ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"

# base64url of the JSON text, without padding
_CURSOR = f"""
translate(rtrim(to_base64(encode(concat('{{"ts":"', strftime(ts, {_MICROS}), '","id":"', id, '"}}'))), '='), '+/', '-_')
"""


def _page(condition: str, limit: int, offset: int) -> str:
    """The page as the rows of a range of ranks; the cursor is that of its last row."""
    return f"""
WITH {LOGS},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS r, count(*) OVER () AS n
  FROM logs WHERE {condition}
)
SELECT {_PAGE},
       (SELECT {_CURSOR} FROM ranked WHERE r = {offset + limit} AND n > {offset + limit}) AS next_cursor
FROM ranked WHERE r > {offset} AND r <= {offset + limit}
"""


_RETAINED = "day + 1 > DATE '2024-01-16'"


def _oracles() -> dict[str, str]:
    return {
        "scan_logs": f"""
WITH {LOGS} SELECT id, strftime(ts, {_MICROS}) AS ts, level, service, message, attributes FROM logs
""",
        "project_rows": _filtered("true"),
        "filter_service": _filtered("service = 'svc-3'"),
        "filter_level": _filtered("level = 'error'"),
        "filter_time": _filtered(
            "ts >= TIMESTAMP '2024-01-10 06:30:00.5' AND ts < TIMESTAMP '2024-01-19 22:00:00'"
        ),
        "filter_message": _filtered("message ILIKE '%purchase%'"),
        "filter_message_wildcard": _filtered("message ILIKE '%e%_1_ O%' ESCAPE '\\'"),
        "filter_message_escape": _filtered("message ILIKE '%00\\% Done%' ESCAPE '\\'"),
        "filter_message_end": _filtered("message ILIKE '%0\\% done%' ESCAPE '\\'"),
        "filter_attr": _filtered(f"{_attr('k')} = '69'"),
        "filter_attr_boolean": _filtered(f"{_attr('vip')} = 'true'"),
        "filter_attr_absent": _filtered(f"{_attr('region')} = 'eu'"),
        "filter_attr_multi": _filtered(f"{_attr('user_id')} = '42' AND {_attr('vip')} = 'true'"),
        "filter_none": _filtered("true"),
        "filter_combined": _filtered(
            "service = 'svc-2' AND level = 'debug' AND ts >= TIMESTAMP '2024-01-03' "
            f"AND ts < TIMESTAMP '2024-01-28' AND message ILIKE '%CLICK_%' AND {_attr('vip')} = 'false'"
        ),
        "filter_message_documents": "SELECT doc_id, text AS message FROM documents WHERE text ILIKE '%étre%'",
        "filter_message_documents_wildcard": (
            "SELECT doc_id, text AS message FROM documents WHERE text ILIKE '%ér_ %çon%'"
        ),
        "attr_as_text": f"""
WITH {LOGS}
SELECT id, {_attr('k')} AS k, {_attr('user_id')} AS user_id, {_attr('vip')} AS vip,
       {_attr('region')} AS region
FROM logs
""",
        "number_text": """
SELECT event_id,
       regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS plain,
       CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS whole,
       concat(event_id % 9 + 1, '00000000000000000000') AS json_e20,
       concat(event_id % 9 + 1, 'e+21') AS json_e21,
       concat('0.00000', event_id % 9 + 1) AS json_millionth,
       concat(event_id % 9 + 1, 'e-7') AS json_smaller,
       true AS plain_reads_back,
       true AS json_reads_back
FROM events
""",
        "attributes_canonical": """
SELECT event_id,
       concat('{"b":true,"dup":"', event_type, '","e":', user_id * 100, ',"k":', event_id,
              ',"user_id":"', user_id, '","v":',
              regexp_replace(CAST(value AS VARCHAR), '\\.0$', ''), '}') AS attributes,
       CAST(event_id AS VARCHAR) AS k,
       CAST(user_id * 100 AS VARCHAR) AS e,
       event_type AS dup,
       'true' AS b
FROM events
""",
        "parse_iso": f"""
SELECT event_id, strftime(
  CASE event_id % 16
    WHEN 0 THEN date_trunc('millisecond', ts)
    WHEN 1 THEN date_trunc('millisecond', ts) - INTERVAL 2 HOURS
    WHEN 2 THEN date_trunc('millisecond', ts) + INTERVAL 330 MINUTES
    WHEN 3 THEN date_trunc('day', ts)
    WHEN 4 THEN date_trunc('minute', ts)
    WHEN 5 THEN date_trunc('day', ts) + INTERVAL 1 DAY
    WHEN 6 THEN NULL
    WHEN 7 THEN date_trunc('millisecond', ts) - INTERVAL 2 HOURS
    WHEN 8 THEN date_trunc('millisecond', ts) + INTERVAL 5 HOURS
    WHEN 10 THEN date_trunc('second', ts)
    WHEN 11 THEN date_trunc('second', ts)
    WHEN 12 THEN NULL
    ELSE date_trunc('millisecond', ts)
  END, {_MICROS}) AS timestamp
FROM events
""",
        "bucket_expr": f"""
WITH {LOGS}
SELECT id,
       strftime(time_bucket(INTERVAL 1 MINUTE, ts), {_MILLIS}) AS minute,
       strftime(time_bucket(INTERVAL 1 HOUR, ts), {_MILLIS}) AS hour,
       strftime(date_trunc('day', ts), {_MILLIS}) AS day,
       strftime(date_trunc('hour', ts - INTERVAL 60 YEARS), {_MILLIS}) AS hour_before_1970
FROM logs
""",
        "page_first": _page("true", 100, 0),
        "page_filtered": _page("level = 'debug'", 1000, 0),
        "page_next": _page("level = 'debug'", 100, 100),
        "export_ordered": f"WITH {LOGS} SELECT {_PAGE}, {_CURSOR} AS cursor FROM logs",
        "cursor_column": f"WITH {LOGS} SELECT id, {_CURSOR} AS cursor FROM logs",
        "cursor_decode": f"""
WITH {LOGS}
SELECT id, id AS cursor_id, strftime(ts, {_MICROS}) AS cursor_ts, true AS cut_is_null,
       true AS reversed_is_null
FROM logs
""",
        "agg_1m": _counts("1m", None, _IN_MONTH),
        "agg_1h": _counts("1h", None, _IN_MONTH),
        "agg_1d": _counts("1d", None, _IN_MONTH),
        "agg_1m_service": _counts("1m", "service", _IN_MONTH),
        "agg_1h_service": _counts("1h", "service", _IN_MONTH),
        "agg_1d_level": _counts("1d", "level", _IN_MONTH),
        "agg_filtered": _counts(
            "1h",
            "level",
            "ts >= TIMESTAMP '2024-01-02 03:04:05' AND ts < TIMESTAMP '2024-01-29 12:00:00' "
            f"AND service = 'svc-4' AND message ILIKE '%ok%' AND {_attr('vip')} = 'true'",
        ),
        "agg_errors": _counts("1h", "service", f"{_IN_MONTH} AND level = 'error'"),
        "ingest_envelopes": f"""
WITH {_DELIVERIES},
checked AS (
  SELECT batch_id, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS raw FROM deliveries
),
sized AS (
  SELECT batch_id,
         CASE WHEN json_type(raw) = 'OBJECT' AND json_type(raw, '$.logs') = 'ARRAY'
              THEN json_array_length(raw, '$.logs') ELSE 0 END AS n
  FROM checked
)
SELECT batch_id, n = 0 AS refused, CAST(CASE WHEN n > 0 THEN n END AS INTEGER) AS n_entries
FROM sized
""",
        "ingest_entries": f"""
WITH {_bodies(MORE_ENTRY_SQL)},
listed AS (SELECT batch_id, json_extract(raw, '$.logs[*]') AS entries FROM bodies),
entries AS (
  SELECT batch_id, unnest(entries) AS entry, generate_subscripts(entries, 1) - 1 AS index FROM listed
)
SELECT batch_id, CAST(index AS INTEGER) AS index,
       CASE json_type(entry) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
                             WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' END AS kind,
       json_extract_string(entry, '$.timestamp') AS timestamp,
       CASE json_type(entry) WHEN 'OBJECT' THEN CAST(len([k for k in json_keys(entry)
         if k NOT IN ('timestamp', 'level', 'service', 'message', 'attributes')]) AS INTEGER)
         END AS n_unknown
FROM entries
""",
        "unnest_arrays": f"""
SELECT {_BATCH} AS batch_id, strftime(ts, {_MICROS}) AS ts,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level,
       concat('svc-', user_id % 7) AS service, concat(event_type, '_', user_id) AS message,
       props AS attributes
FROM events
""",
        "validate_reasons": _reasons(_REASON),
        "validate_reasons_more": _reasons(_MORE_REASON),
        "validate_accepted": f"""
SELECT {_BATCH} AS batch_id, {_INDEX} AS index, {_ACCEPTED_ID} AS id,
       strftime(date_trunc('millisecond', ts), {_MICROS}) AS timestamp,
       'info' AS level, 's' AS service, 'm' AS message,
       concat('{{"k":', json_extract_string(props, '$.k'), '}}') AS attributes,
       json_extract_string(props, '$.k') AS k
FROM events WHERE {_REASON} IS NULL
""",
        "rejects": f"""
WITH {_bodies(ENTRY_SQL)}
{_reasons(_REASON)} WHERE {_REASON} IS NOT NULL
UNION ALL SELECT -batch_id - 1, NULL, '{model.REFUSED_BODY.replace("'", "''")}' FROM bodies
UNION ALL SELECT batch_id + 1000000000, 0, 'timestamp is required' FROM bodies
""",
        "batch_outcome": f"""
WITH counted AS (
  SELECT {_BATCH} AS batch_id, count(*) FILTER ({_REASON} IS NULL) AS accepted,
         count(*) FILTER ({_REASON} IS NOT NULL) AS rejected
  FROM events GROUP BY 1
)
SELECT batch_id, accepted, rejected, 'accepted' AS outcome, CAST(NULL AS VARCHAR) AS error FROM counted
UNION ALL SELECT -batch_id - 1, 0, 0, 'refused', '{model.REFUSED_BODY.replace("'", "''")}' FROM counted
UNION ALL SELECT batch_id + 1000000000, 0, 1, 'refused', NULL FROM counted
""",
        "with_defaults": f"""
SELECT event_id, {_uuid("CAST(event_id AS VARCHAR)")} AS id,
       CASE WHEN event_type = 'click' THEN props ELSE '{{}}' END AS attributes, true AS has_time
FROM events
""",
        "day_routing": f"""
WITH {LOGS}
SELECT id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, 'logs_%Y_%m_%d') AS partition_name FROM logs
""",
        "insert_if_absent": f"""
WITH {LOGS},
keyed AS (SELECT *, strftime(date_trunc('minute', ts), {_MILLIS}) AS minute FROM logs)
SELECT service, minute, arg_min(id, (ts, id)) AS id FROM keyed k
WHERE NOT EXISTS (
  SELECT 1 FROM keyed e WHERE e.level = 'error' AND e.service = k.service AND e.minute = k.minute
)
GROUP BY service, minute
""",
        "append_counts": f"""
SELECT count(*) FILTER ({_REASON} IS NULL) AS stored, count(*) FILTER ({_REASON} IS NULL) AS inserted,
       count(*) FILTER ({_REASON} IS NOT NULL) AS rejected
FROM events
""",
        "partition_inventory": f"""
WITH {LOGS}
SELECT strftime(day, 'logs_%Y_%m_%d') AS partition_name, CAST(day AS VARCHAR) AS range_start,
       CAST(CAST(day + 1 AS DATE) AS VARCHAR) AS range_end, count(*) AS rows,
       strftime(min(ts), {_MILLIS}) AS min_ts, strftime(max(ts), {_MILLIS}) AS max_ts
FROM logs GROUP BY day
""",
        "retention_expired": f"""
WITH {LOGS}
SELECT strftime(day, 'logs_%Y_%m_%d') AS partition_name, count(*) AS rows
FROM logs WHERE NOT ({_RETAINED}) GROUP BY day
""",
        "retention_kept": _filtered(_RETAINED),
        "retention_run": f"""
WITH {LOGS}
SELECT DISTINCT strftime(day, 'logs_%Y_%m_%d') AS partition_name,
       CASE WHEN {_RETAINED} THEN 'kept' ELSE 'dropped' END AS state
FROM logs
""",
        "stream_ingest_accepted": f"""
SELECT {_ACCEPTED_ID} AS id,
       strftime(date_trunc('millisecond', ts), {_MILLIS}) AS timestamp,
       'info' AS level, 's' AS service, 'm' AS message,
       concat('{{"k":', json_extract_string(props, '$.k'), '}}') AS attributes
FROM events WHERE {_REASON} IS NULL
""",
        "stream_ingest_rejects": f"""
SELECT CAST({_BATCH} AS VARCHAR) AS batch_id, {_INDEX} AS index, {_REASON} AS reason
FROM events WHERE {_REASON} IS NOT NULL
""",
    }


def all_oracles() -> dict[str, str]:
    found = _oracles()
    for name in ("page_first", "page_filtered", "page_next", "agg_1m", "agg_1h_service", "agg_filtered"):
        found[f"store_{name}"] = found[name]
    purchases = f"service = 'svc-3' AND message ILIKE '%purchase%' AND {_attr('k')} = '69'"
    within = "ts >= TIMESTAMP '2024-01-10 06:30:00.5' AND ts < TIMESTAMP '2024-01-19 22:00:00'"
    left = "ts >= TIMESTAMP '2024-01-03'"
    unaligned = "ts >= TIMESTAMP '2024-01-03 10:20:30.5' AND ts < TIMESTAMP '2024-01-29 12:34:56'"
    exported = {
        "store_filter_message_indexed": "message ILIKE '%purchase\\_4%' ESCAPE '\\'",
        "store_filter_message_indexed_wildcard": "message ILIKE '%err%_4_ 100\\%%' ESCAPE '\\'",
        "store_filter_message_indexed_short": "contains(message, '9 ')",
        "store_filter_attr_promoted": f"{_attr('vip')} = 'true'",
        "store_filter_attr_unpromoted": f"{_attr('k')} = '69'",
        "store_filter_attr_mixed": f"{_attr('vip')} = 'false' AND {_attr('k')} = '69' AND level = 'error'",
    }
    return found | {name: f"{found['export_ordered']} WHERE {left} AND {condition}" for name, condition in exported.items()} | {
        "store_agg_1m_rollup": _counts("1m", None, left),
        "store_agg_1m_level_rollup": _counts("1m", "level", f"service = 'svc-2' AND {unaligned}"),
        "store_agg_1h_service_rollup": _counts("1h", "service", unaligned),
        "store_agg_1d_errors_rollup": _counts("1d", None, f"level = 'error' AND {unaligned}"),
        "store_page_rollup": _page(f"service = 'svc-3' AND level = 'error' AND {left}", 50, 0),
        "store_page_rollup_next": _page(f"level = 'warn' AND {left}", 50, 50),
        "stream_ingest_outcomes": found["batch_outcome"],
        "store_page_sparse": _page(purchases, 1000, 0),
        "store_page_none": _page("false", 5, 0),
        "store_compacted": found["export_ordered"],
        "store_export": found["export_ordered"],
        "store_filter_time": f"{found['export_ordered']} WHERE {within}",
        "store_partitions": found["partition_inventory"],
        "stream_ingest_lines": f"SELECT * EXCLUDE (id) FROM ({found['stream_ingest_accepted']})",
        "ingest_renamed": """
SELECT load, count_if(ok) AS stored, count_if(NOT ok) AS reported
FROM (SELECT event_id % 20 >= 9 AS ok FROM events), (VALUES ('one'), ('two')) loads (load) GROUP BY load
""",
        "ingest_repeated": """
SELECT count_if(ok) AS stored, count_if(ok) AS ids, count_if(NOT ok) AS reported, count_if(ok) AS accepted_1,
       count_if(NOT ok) AS rejected_1, CAST(0 AS BIGINT) AS accepted_2, CAST(0 AS BIGINT) AS rejected_2
FROM (SELECT event_id % 20 >= 9 AS ok FROM events)
""",
    }
