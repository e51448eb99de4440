"""Scalar functions over canonical JSON texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CERTIFIED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)
NESTED = (T.StructType, T.ArrayType, T.MapType, T.BinaryType)
SAFE = 9007199254740991
#: Numbers in strings: decimal ones, and unsigned ones to the bases 16, 8 and 2.
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BASES = (("x", 16, "[0-9a-fA-F]"), ("o", 8, "[0-7]"), ("b", 2, "[01]"))


def number_text(d: Column) -> Column:
    """The canonical text of a finite double: decimal digits from 1e-6 up to 1e21, else an exponent as in 1.5e-7."""
    s = F.abs(d).cast("string")
    mantissa, power = F.substring_index(s, "E", 1), F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1)).otherwise("0").cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    raw = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(raw, "^0+", ""), "0+$", "")
    point = F.length(whole) + power - (F.length(raw) - F.length(F.regexp_replace(raw, "^0+", "")))
    n = F.length(digits)
    plain = F.when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n))).when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    tail = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    powered = F.concat(F.substr(digits, F.lit(1), F.lit(1)), tail, F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
    text = F.when((point > -6) & (point <= 21), plain).otherwise(powered)
    return F.when(d == 0, "0").otherwise(F.concat(F.when(d < 0, "-").otherwise(""), text))


def canonical_column(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a scalar column; null becomes the text null, and so do numbers that are not finite."""
    if isinstance(kind, T.StringType):
        text = F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        text = F.when(~F.isnan(d) & (F.abs(d) != float("inf")), number_text(d))
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def _kind(x: Column) -> Column:
    return F.when(x == "null", "null").when(x.isin("true", "false"), "boolean").when(x.startswith('"'), "string").otherwise("number")


def _fold(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _string(x: Column) -> Column:
    """The characters of a canonical string."""
    return F.when(x.startswith('"'), F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]"))


def _unpadded(x: Column) -> Column:
    return F.regexp_replace(x, " +$", "")


def as_number(x: Column) -> Column:
    """The finite number that a canonical number or a string stands for, else null; blank strings are no numbers."""
    s = F.trim(F.translate(F.coalesce(_string(x), x), "\t\n\u000b\f\r ", "      "))
    value = F.when(s.rlike(DECIMAL), s.try_cast("double"))
    for letter, base, digit in BASES:
        prefix = rf"^0[{letter}{letter.upper()}]"
        value = F.when(s.rlike(f"{prefix}{digit}+$"), F.conv(F.substr(s, F.lit(3)), base, 10).try_cast("double")).otherwise(value)
    return F.when(~x.isin("null", "true", "false") & (F.abs(value) != float("inf")), value + 0.0)


def may_equal(a: Column, b: Column) -> Column:
    """Whether two scalars may be equal to some database: case or trailing spaces aside, numbers in strings read."""
    ka, kb = _kind(a), _kind(b)
    strings = (_fold(a) == _fold(b)) | (_unpadded(_string(a)) == _unpadded(_string(b)))
    numbers = F.coalesce(as_number(a) == as_number(b), F.lit(False))
    worded = F.lower(F.coalesce(_string(a), a)) == F.lower(F.coalesce(_string(b), b))
    either = lambda x, y: ((ka == x) & (kb == y)) | ((ka == y) & (kb == x))
    out = F.when(a == b, True).when((ka == "null") | (kb == "null"), False).when((ka == "string") & (kb == "string"), strings)
    return out.when(either("number", "number") | either("number", "string"), numbers).when(either("boolean", "string"), worded).otherwise(False)


def match_keys(x: Column, given: bool) -> Column:
    """Keys of a scalar, so that two scalars may be equal exactly if a given one and a wanted one share a key.

    A string's number meets numbers only, and its word booleans only, so these keys name both sides' kinds.
    """
    here, there = ("g", "w") if given else ("w", "g")
    n, s, kind = as_number(x).cast("string"), _string(x), _kind(x)
    word = F.lower(s)
    of_string = F.array(F.concat(F.lit("fold:"), _fold(s)), F.concat(F.lit("bare:"), _unpadded(s)), F.concat(F.lit(f"number:{here}string:"), n), F.when(word.isin("true", "false"), F.concat(F.lit(f"word:{here}string:"), word)))
    of_number = F.transform(F.array(n), lambda v: F.concat(F.lit("number:"), v))
    of_number = F.concat(of_number, F.transform(of_number, lambda v: F.concat(F.lit(f"number:{there}string:"), F.substr(v, F.lit(len("number:") + 1)))))
    of_boolean = F.array(F.concat(F.lit("word:"), x), F.concat(F.lit(f"word:{there}string:"), x))
    return F.array_compact(F.when(kind == "string", of_string).when(kind == "number", of_number).when(kind == "boolean", of_boolean).otherwise(F.array(F.lit("null"))))


def filter_may_equal(actual: Column, expected: Column) -> Column:
    """As may_equal, but values of two kinds, and numbers that are no safe integers, always may be equal."""
    ka, kb = _kind(actual), _kind(expected)
    unsafe = lambda x: ~F.coalesce(x.rlike(r"^-?[0-9]+$") & (F.abs(x.try_cast("double")) <= SAFE), F.lit(False))
    return F.when((ka == "null") | (kb == "null"), ka == kb).when(ka != kb, True).when((ka == "number") & (unsafe(actual) | unsafe(expected)), True).otherwise(may_equal(actual, expected))
