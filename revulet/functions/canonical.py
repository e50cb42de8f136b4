"""Canonical JSON: any column as JSON text with sorted keys, no blanks, and numbers and strings as JavaScript writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = {"\b": r"\b", "\t": r"\t", "\n": r"\n", "\f": r"\f", "\r": r"\r"}


def camel(name: str) -> str:
    """review_id as reviewId."""
    first, *rest = name.split("_")
    return first + "".join(part.title() for part in rest)


def quoted(text: Column) -> Column:
    """A string with quotes and what must be escaped in it; other characters stay as they are."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text), F.lit('"'))


def number(value: Column) -> Column:
    """A double in its shortest form: whole numbers without a point, exponents only from 1e21 and below 1e-6; what is not
    finite is null."""
    plain = value.cast("string")
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1)
    mantissa = F.regexp_replace(F.regexp_replace(plain, r"E.*$", ""), r"\.0$", "")
    far = F.concat(mantissa, F.when(exponent.startswith("-"), F.lit("e")).otherwise(F.lit("e+")), exponent)
    digits = F.regexp_replace(plain.cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
    whole = F.regexp_replace(plain.cast("decimal(38,0)").cast("string"), r"\..*$", "")
    size = F.abs(value)
    return (
        F.when(F.isnan(value) | (size == float("inf")), F.lit("null"))
        .when(value == 0, F.lit("0"))
        .when((size >= 1e21) | (size < 1e-6), far)
        .when(value == F.floor(value), whole)
        .when(exponent == "", plain)
        .otherwise(digits)
    )


def canonical(column: Column, kind: T.DataType, name: Callable[[str], str] = camel) -> Column:
    """The JSON text of a column of any type made of structs, arrays, maps with string keys, strings, numbers, booleans,
    dates and times (UTC, milliseconds). Nulls are null; keys are sorted, the names of fields after name() is applied."""
    if isinstance(kind, T.StructType):
        fields = sorted((name(f.name), f) for f in kind.fields)
        parts = [F.concat(F.lit(f'"{n}":'), canonical(column[f.name], f.dataType, name)) for n, f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: canonical(x, kind.elementType, name)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType, name))
        keyed = F.transform(F.array_sort(F.map_keys(column)), lambda k: F.struct(k.alias("key"), column[k].alias("value")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(keyed, entry), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = quoted(column)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(column.cast("double"))
    elif isinstance(kind, T.DecimalType):
        out = number(column.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit('"'), F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"'))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = column.cast("string")
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit('"'), column.cast("string"), F.lit('"'))
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON.")
    return F.when(column.isNull(), F.lit("null")).otherwise(out)
