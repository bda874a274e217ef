"""Features in text form: a heading, then one ``TYPE<tab>value`` a line.

Line breaks, tabs and backslashes within values are written as ``\\n``, ``\\r``, ``\\t`` and two backslashes, so a value is one line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field types and the Spark types that hold them. Fixed values.
FIELD_TYPES = {
    "NULL": "string", "BOOLEAN": "boolean", "BYTE": "tinyint", "SHORT": "smallint", "INTEGER": "int", "LONG": "bigint", "FLOAT": "float",
    "DOUBLE": "double", "STRING": "string", "BOOLEAN_ARRAY": "array<boolean>", "BYTE_ARRAY": "array<tinyint>", "SHORT_ARRAY": "array<smallint>",
    "INTEGER_ARRAY": "array<int>", "LONG_ARRAY": "array<bigint>", "FLOAT_ARRAY": "array<float>", "DOUBLE_ARRAY": "array<double>",
    "STRING_ARRAY": "array<string>", "POINT": "string", "LINESTRING": "string", "POLYGON": "string", "MULTIPOINT": "string",
    "MULTILINESTRING": "string", "MULTIPOLYGON": "string", "GEOMETRYCOLLECTION": "string", "GEOMETRY": "string", "UUID": "string",
    "BIG_INTEGER": "decimal(38,0)", "BIG_DECIMAL": "decimal(38,18)", "DATETIME": "timestamp", "DATE": "date", "TIME": "string", "TIMESTAMP": "timestamp",
}


#: What may not stand in a line, and how it is written. Fixed values.
_ESCAPES = [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def escape(value: Column) -> Column:
    """A value's text on one line."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for plain, written in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(written))
    return out


def unescape(line: Column) -> Column:
    """The text that :func:`escape` wrote."""

    def part(x: Column) -> Column:
        for plain, written in _ESCAPES:
            x = F.replace(x, F.lit(written), F.lit(plain))
        return x

    whole = F.array_join(F.transform(F.split(line, r"\\\\"), part), "\\")
    return F.when(F.contains(line, F.lit("\\")), whole).otherwise(line)


def attributes(text: Column | str) -> Column:
    """``array<struct<pos:int, kind:string, value:string>>`` of a feature's text; null text gives null, other kinds of text an empty array.

    A line without a tab is left out; the value of NULL is null.
    """
    text = F.col(text) if isinstance(text, str) else text
    lines = F.split(text, "\n")
    rest = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.contains(x, F.lit("\t")))
    made = F.transform(
        rest,
        lambda x, i: F.struct(
            i.alias("pos"), F.substring_index(x, "\t", 1).alias("kind"),
            F.when(F.substring_index(x, "\t", 1) != "NULL", unescape(F.substring(x, F.instr(x, "\t") + 1, F.length(x)))).alias("value"),
        ),
    )
    return F.when(text.isNotNull(), F.when(F.element_at(lines, 1) == "FEATURE", made).otherwise(F.array().cast("array<struct<pos:int,kind:string,value:string>>")))


def render(attrs: Column | str) -> Column:
    """The text form of :func:`attributes`."""
    attrs = F.col(attrs) if isinstance(attrs, str) else attrs
    line = lambda a: F.concat_ws("\t", a["kind"], F.coalesce(escape(a["value"]), F.lit("null")))
    return F.concat_ws("\n", F.lit("FEATURE"), F.transform(attrs, line))


def object_id(text: Column | str) -> Column:
    """Content hash of a feature in text form."""
    return F.sha1(F.col(text) if isinstance(text, str) else text)


def typed(value: Column, kind: str) -> Column:
    """A value's text as the Spark type of its field type; null where it doesn't parse. Elements of arrays are parted by blanks."""
    made = FIELD_TYPES[kind]
    if made.startswith("array<"):
        parts = F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, " "))
        return parts if made == "array<string>" else F.transform(parts, lambda x: x.try_cast(made[6:-1]))
    return value if made == "string" else value.try_cast(made)


def text_of(value: Column, spark_type: str) -> Column:
    """The text of a typed value, as :func:`typed` reads it."""
    return F.array_join(value.cast("array<string>"), " ", "null") if spark_type.startswith("array<") else value.cast("string")
