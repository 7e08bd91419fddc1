"""Ingest bodies ``{"logs": [...]}`` and the entries inside them.

Every source gives two columns: ``batch_id``, which names one delivery and never
repeats, and ``raw``, the body's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.json_text import VARIANT_MAP
from tallylog.model import ENTRY_FIELDS

# How much a file stream takes in one micro-batch.
MICRO_BATCH_BYTES = 2**36

_INTEGER_KEY = r"^(0|[1-9]\d{0,9})$"
_INTEGER_KEY_END = 2**32 - 1


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One body per file; the file's path names the delivery."""
    return _from_files(spark.read.format("text").option("wholetext", True).load(path))


def stream_bodies(
    spark: SparkSession, path: str, max_bytes: int = MICRO_BATCH_BYTES
) -> DataFrame:
    """Files as they arrive, one body each, at most ``max_bytes`` per micro-batch."""
    reader = spark.readStream.format("text").option("wholetext", True)
    return _from_files(reader.option("maxBytesPerTrigger", max_bytes).load(path))


def read_body_lines(spark: SparkSession, path: str) -> DataFrame:
    """One body per line of newline-delimited files, for bulk loads.

    File and line number name the delivery, so it has the same name whenever the file is
    read again. Line numbers need whole files: a file is read by one task and has to fit
    in it (some hundred MB). Empty lines are skipped.
    """
    return _from_lines(spark.read.format("text").option("wholetext", True).load(path))


def stream_body_lines(
    spark: SparkSession, path: str, max_bytes: int = MICRO_BATCH_BYTES
) -> DataFrame:
    """Newline-delimited files as they arrive, at most ``max_bytes`` per micro-batch."""
    reader = spark.readStream.format("text").option("wholetext", True)
    return _from_lines(reader.option("maxBytesPerTrigger", max_bytes).load(path))


def _from_lines(files: DataFrame) -> DataFrame:
    lines = files.select(
        F.col("_metadata.file_path").alias("file"),
        F.posexplode(F.split("value", "\r?\n")).alias("line", "raw"),
    )
    named = F.concat_ws("#", "file", F.col("line") + 1)
    return lines.where(F.trim("raw") != "").select(named.alias("batch_id"), "raw")


def _from_files(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("batch_id"), F.col("value").alias("raw")
    )


def bodies_from_kafka(records: DataFrame) -> DataFrame:
    """Records of Spark's Kafka source, batch or stream, one body per record."""
    return records.select(
        F.concat_ws("/", "topic", F.col("partition"), F.col("offset")).alias("batch_id"),
        F.col("value").cast("string").alias("raw"),
    )


def _fields(entry: Column) -> Column:
    return F.try_variant_get(entry, "$", VARIANT_MAP)


def _unknown(keys: Column) -> Column:
    return F.array_except(keys, F.array(*(F.lit(k) for k in ENTRY_FIELDS)))


def _in_object_order(keys: Column) -> Column:
    """Integer-like keys first, by value, then the others as they were written."""

    def integer_like(k: Column) -> Column:
        return k.rlike(_INTEGER_KEY) & (k.try_cast("bigint") < _INTEGER_KEY_END)

    numbers = F.transform(F.filter(keys, integer_like), lambda k: k.cast("bigint"))
    return F.concat(
        F.transform(F.array_sort(numbers), lambda n: n.cast("string")),
        F.filter(keys, lambda k: ~integer_like(k)),
    )


#: The JSON reader's own limits, lifted; single quotes and NaN are no JSON.
_JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxNestingDepth": "100000",
    "maxNumLen": "2000000000",
    "maxStringLen": "2000000000",
}
#: A quote and then, after plain white space, a brace or an escape that may stand for either.
#: No repeated group: such loops overflow the stack on long texts.
_QUOTED_BRACE = r'"\s*+(?:\{|\\[ntr]|\\u00(?:09|0[aAdD]|20|7[bB]))'
#: Longer keys and deeper values can't be read, whatever the options.
LONGEST_KEY, DEEPEST = 50_000, 1_000


def parse_envelopes(bodies: DataFrame) -> DataFrame:
    """Adds ``entries``, an array of ``text, value``, NULL when the body is refused.

    A body must be a JSON object with a non-empty ``logs`` array and nothing
    after it. The JSON reader stops at the end of the first value, so the body
    is read as the first item of an array whose second item holds the body's own
    hash; text after the body would push that item out of its place.

    The body is read once, into the texts of its entries; no value ever holds more than
    one entry, so neither a large body nor one odd entry costs the others anything. A JSON
    string in place of an entry could look like an object once it is unquoted; only a
    body with a quoted brace can hold one, and it is read again to tell (``value`` is
    then the string). ``beyond_limit`` marks a refused body with a longer key or a deeper value than
    the reader can take, which says nothing about whether it is well formed.
    """
    mark = F.xxhash64("raw").cast("string")
    framed = F.concat(F.lit("["), F.col("raw"), F.lit(',{"mark":"'), mark, F.lit('"}]'))
    read = F.from_json(framed, "array<struct<logs array<string>, mark string>>", _JSON_OPTIONS)
    parsed = bodies.withColumn("read", read)
    body, tail = F.try_element_at("read", F.lit(1)), F.try_element_at("read", F.lit(2))
    complete = (F.size("read") == 2) & (tail["mark"] == mark) & (F.size(body["logs"]) > 0)
    quoted_brace = F.col("raw").rlike(_QUOTED_BRACE)
    values = F.from_json("raw", "logs array<variant>")["logs"]
    strings = F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", v))
    checked = parsed.select(
        "batch_id",
        "raw",
        F.when(complete, body["logs"]).alias("texts"),
        F.when(complete & quoted_brace, strings).alias("strings"),
    )
    none = F.array().cast("array<variant>")
    pairs = F.arrays_zip("texts", F.coalesce("strings", none).alias("strings"))
    long_key = F.col("raw").rlike(rf'"[^"]{{{LONGEST_KEY},}}"\s*:')
    bare = F.regexp_replace("raw", r'\s+|"[^"]*"\s*:', "")
    deep = bare.rlike(rf"[\[{{]{{{DEEPEST},}}")
    return checked.select(
        "batch_id",
        "raw",
        F.when(F.col("texts").isNotNull(), pairs).alias("entries"),
        (F.col("texts").isNull() & (long_key | deep)).alias("beyond_limit"),
    )


def explode_entries(envelopes: DataFrame) -> DataFrame:
    """One row per entry: ``batch_id, index, entry, text, field, unknown, body, beyond_limit``.

    ``field`` maps the entry's keys to their values, NULL if it is no object, and
    ``unknown`` lists the keys the contract does not know, in the order they were written.
    An entry that a single value can't hold (a number of over 1,000 digits, deeper
    nesting than 1,000, over 16 MiB) has its ``text`` only and is marked ``beyond_limit``. A
    refused body gives one row with a NULL ``index`` and its text in ``body``.
    """
    rows = envelopes.select(
        "batch_id",
        F.when(F.col("entries").isNull(), F.col("raw")).alias("body"),
        "beyond_limit",
        F.posexplode_outer("entries").alias("index", "pair"),
    )
    text, string = F.col("pair")["texts"], F.col("pair")["strings"]
    rows = rows.select(
        "batch_id",
        "index",
        "body",
        "beyond_limit",
        text.alias("text"),
        F.coalesce(
            string,
            F.try_parse_json(text),
            F.when(_bare_string(text), text.cast("variant")),
            F.when(text.isNull() & F.col("index").isNotNull(), F.parse_json(F.lit("null"))),
        ).alias("entry"),
    ).withColumn("field", _fields(F.col("entry")))
    unknown = _unknown(F.map_keys("field"))
    # Values sort their keys; only several unknown ones need the written order.
    as_written = _in_object_order(_unknown(F.json_object_keys("text")))
    return rows.select(
        "batch_id",
        "index",
        "entry",
        "text",
        "field",
        F.when(F.size(unknown) > 1, F.coalesce(as_written, unknown)).otherwise(unknown).alias("unknown"),
        "body",
        (F.col("beyond_limit") | (F.col("text").isNotNull() & F.col("entry").isNull())).alias("beyond_limit"),
    )


def _bare_string(text: Column) -> Column:
    """Whether an entry's text can't be a JSON object or array: it was a string, unquoted."""
    return ~F.ltrim(text).rlike(r"^[\[{]")
