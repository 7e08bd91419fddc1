"""Attribute values as text and as canonical JSON.

Numbers are 64-bit floats by contract: ``3.0`` and ``3`` are the same value, and
integers beyond 2^53 lose digits. Attribute filters compare the plain decimal
form (``1e21`` is ``1000000000000000000000``); the JSON form switches to
exponents at the places JSON writers for such numbers do (``1e+21``, ``1e-7``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Integers up to 2^53, and so all of 15 digits, are exact.
_EXACT_INTEGERS = 2**53
_EXACT_DIGITS = 15

VARIANT_MAP = "map<string,variant>"


def _java_text(d: Column) -> Column:
    """Shortest decimal text of a double.

    Java before 19 sometimes prints more digits than needed (2e23 comes out as
    1.9999999999999998E23); 15 or 16 digits are taken when they give the same
    number back.
    """
    text = d.cast("string")
    short = F.format_string("%.14e", d)
    medium = F.format_string("%.15e", d)
    return (
        F.when(F.length(text) < 17, text)
        .when(short.cast("double") == d, F.upper(short))
        .when(medium.cast("double") == d, F.upper(medium))
        .otherwise(text)
    )


_DECIMAL = r"^-?(\d+)\.(\d+)(?:E([+-]?\d+))?$"


def _digits_and_point(d: Column) -> Column:
    """``struct(digits, point)``: |d| is 0.DIGITS times ten to the power ``point``."""
    text = _java_text(d)
    whole = F.regexp_extract(text, _DECIMAL, 1)
    fraction = F.regexp_extract(text, _DECIMAL, 2)
    exponent = F.coalesce(F.regexp_extract(text, _DECIMAL, 3).try_cast("int"), F.lit(0))
    joined = F.concat(whole, fraction)
    stripped = F.ltrim(joined, F.lit("0"))
    leading = F.length(joined) - F.length(stripped)
    return F.struct(
        F.rtrim(stripped, F.lit("0")).alias("digits"),
        (F.length(whole) + exponent - leading).alias("point"),
    )


def _general(d: Column, exponents: bool) -> Column:
    """Text of any finite, non-zero double."""

    def written(parts: Column) -> Column:
        digits, point = parts["digits"], parts["point"]
        n = F.length(digits)
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(
                F.concat(
                    F.substring(digits, F.lit(1), point),
                    F.lit("."),
                    F.substring(digits, point + 1, n),
                )
            )
        )
        if exponents:
            power = point - 1
            mantissa = F.when(n == 1, digits).otherwise(
                F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))
            )
            scientific = F.concat(
                mantissa,
                F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
                F.abs(power).cast("string"),
            )
            plain = F.when((point > 21) | (point <= -6), scientific).otherwise(plain)
        return F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), plain)

    # A one-element array binds the parts once for all their uses.
    return F.transform(F.array(_digits_and_point(d)), written)[0]


def number_text(d: Column, exponents: bool = False) -> Column:
    """Canonical text of a double: plain decimal, or JSON form with ``exponents``.

    Values outside the range of a double have no text (NULL).
    """
    simple = d.cast("string")
    return (
        F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("string"))
        .when(
            (F.abs(d) <= _EXACT_INTEGERS) & (d == F.rint(d)),
            d.cast("bigint").cast("string"),
        )
        .when((F.length(simple) < 17) & ~simple.contains("E"), simple)
        .otherwise(_general(d, exponents))
    )


def kind_word(schema: Column) -> Column:
    """Word for a JSON type, as used in rejection reasons, from a variant's schema."""
    return (
        F.when(schema == "STRING", "string")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def variant_kind(v: Column) -> Column:
    return kind_word(F.schema_of_variant(v))


_AS_WRITTEN, _REWRITE, _NESTED = "as written", "rewrite", "nested"


def attribute_classes(values: Column) -> Column:
    """What each attribute value (``map<string,variant>``) asks for.

    Texts, booleans and short integers can be taken as they are; other numbers
    may have to be written anew; objects, arrays and null are not allowed.
    """

    def of(value: Column) -> Column:
        schema = F.schema_of_variant(value)
        short = F.length(F.try_variant_get(value, "$", "string")) <= _EXACT_DIGITS
        return (
            F.when(schema.isin("STRING", "BOOLEAN"), _AS_WRITTEN)
            .when((schema == "BIGINT") & short, _AS_WRITTEN)
            .when(schema.rlike("^(OBJECT|ARRAY|VOID)"), _NESTED)
            .otherwise(_REWRITE)
        )

    return F.transform(F.map_values(values), of)


def has_nested(classes: Column) -> Column:
    return F.array_contains(classes, _NESTED)


def attribute_map(attributes: Column, values: Column, classes: Column) -> Column:
    """``map<string,string>`` for equality filters.

    ``attributes`` is the variant object, ``values`` the same as a map of
    variants, and ``classes`` come from :func:`attribute_classes`.
    """

    def text(_: Column, value: Column) -> Column:
        number = number_text(F.try_variant_get(value, "$", "double"))
        as_text = F.try_variant_get(value, "$", "string")
        return F.when(F.schema_of_variant(value).isin("STRING", "BOOLEAN"), as_text).otherwise(number)

    rewritten = F.transform_values(values, text)
    plain = F.try_variant_get(attributes, "$", "map<string,string>")
    return F.when(F.array_contains(classes, _REWRITE), rewritten).otherwise(plain)


def attribute_json(attributes: Column, values: Column, classes: Column) -> Column:
    """Canonical JSON object text; arguments as for :func:`attribute_map`."""

    def member(e: Column) -> Column:
        value = e["value"]
        number = number_text(F.try_variant_get(value, "$", "double"), exponents=True)
        json = F.when(
            F.schema_of_variant(value).isin("STRING", "BOOLEAN"), F.to_json(value)
        ).otherwise(F.coalesce(number, F.lit("null")))
        return F.concat(F.to_json(e["key"].cast("variant")), F.lit(":"), json)

    members = F.array_join(F.transform(F.map_entries(values), member), ",")
    rewritten = F.concat(F.lit("{"), members, F.lit("}"))
    return F.when(F.array_contains(classes, _REWRITE), rewritten).otherwise(F.to_json(attributes))


def field_text(json: Column, key: str) -> Column:
    """Top-level field of a JSON object as text; NULL if absent or JSON null."""
    return F.from_json(json, "map<string,string>")[key]
