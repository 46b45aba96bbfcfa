"""The value algebra of filter expressions as Catalyst columns.

Values are null, boolean, integer, double or text. Null is a value that compares; operands of
different kinds compare as unequal; arithmetic with one null side gives the other side. Every
rewrite is chosen from the static kinds, so that a comparison of a numeric column with a literal
stays a bare predicate that reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOL, INT, DOUBLE, TEXT = "null", "bool", "int", "double", "text"
_NUMERIC = (BOOL, INT, DOUBLE)


@dataclass(frozen=True)
class Value:
    """A column with its kind; never_null tells that no null has to be thought of."""

    col: Column
    kind: str
    never_null: bool = False
    literal: object = None


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NullType):
        return NULL
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    return TEXT


def of_column(col: Column, data_type: T.DataType) -> Value:
    kind = kind_of(data_type)
    target = {NULL: "string", BOOL: "boolean", INT: "bigint", DOUBLE: "double", TEXT: "string"}[kind]
    simple = data_type.simpleString()
    return Value(col if simple == target else col.cast(target), kind)


def literal(x: object) -> Value:
    if x is None:
        return Value(F.lit(None).cast("string"), NULL)
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, True, x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), INT, True, x)
    if isinstance(x, float):
        return Value(F.lit(x), DOUBLE, True, x)
    return Value(F.lit(str(x)), TEXT, True, str(x))


def double_text(x: Column) -> Column:
    """A double with six significant digits, without trailing zeros, in exponent form below 1e-4 and from 1e6."""
    sci = F.format_string("%.5e", x)
    mantissa = F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", "")
    exponent = F.substring_index(sci, "e", -1).cast("int")
    places = F.greatest(F.lit(5) - exponent, F.lit(0))
    plain = F.call_function("format_string", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), x)
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    form = F.when((exponent < -4) | (exponent >= 6), F.concat(mantissa, F.lit("e"), F.substring_index(sci, "e", -1))).otherwise(plain)
    return F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).when(x == 0, F.lit("0")).otherwise(form)


def text(v: Value) -> Column:
    """Text form; null is the empty text."""
    if v.kind == NULL:
        return F.lit("")
    shown = {TEXT: v.col, DOUBLE: double_text(v.col) if v.kind == DOUBLE else None}.get(v.kind, v.col.cast("string"))
    return shown if v.never_null else F.coalesce(shown, F.lit(""))


def to_double(v: Value) -> Column:
    if v.kind == NULL:
        return F.lit(0.0)
    x = F.trim(v.col).try_cast("double") if v.kind == TEXT else v.col.cast("bigint").cast("double") if v.kind == BOOL else v.col.cast("double")
    return x if v.never_null and v.kind != TEXT else F.coalesce(x, F.lit(0.0))


def to_int(v: Value) -> Column:
    """Integer form: doubles become the integer part of floor(x) + 0.5, so negative ones end one above their floor."""
    if v.kind == NULL:
        return F.lit(0).cast("bigint")
    if v.kind == DOUBLE:
        x = (F.floor(v.col).cast("double") + F.lit(0.5)).cast("bigint")
    elif v.kind == TEXT:
        x = F.trim(v.col).try_cast("bigint")
    else:
        x = v.col.cast("bigint")
    return F.coalesce(x, F.lit(0).cast("bigint"))


def to_bool(v: Value) -> Column:
    if v.kind == NULL:
        return F.lit(False)
    x = v.col if v.kind == BOOL else F.length(v.col) > 0 if v.kind == TEXT else v.col != 0
    return x if v.never_null else F.coalesce(x, F.lit(False))


def is_null(v: Value) -> Column:
    return F.lit(True) if v.kind == NULL else F.lit(False) if v.never_null else v.col.isNull()


def _common(a: Value, b: Value) -> tuple[Column, Column, str]:
    if DOUBLE in (a.kind, b.kind):
        return a.col.cast("double"), b.col.cast("double"), DOUBLE
    return a.col.cast("bigint"), b.col.cast("bigint"), INT


def _one_sided(a: Value, b: Value, x: Column, y: Column, both: Column, kind: str) -> Value:
    """both where neither side is null, else the side that isn't."""
    out = both
    if not b.never_null:
        out = F.when(y.isNull(), x).otherwise(out)
    if not a.never_null:
        out = F.when(x.isNull(), y).otherwise(out)
    return Value(out, kind)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.kind == NULL:
        return b
    if b.kind == NULL:
        return a
    if TEXT in (a.kind, b.kind):
        if op == "+":
            x, y = (v.col if v.kind == TEXT else F.when(v.col.isNotNull(), text(v)) for v in (a, b))
            return _one_sided(a, b, x, y, F.concat(x, y), TEXT)
        if a.kind == b.kind:
            return _one_sided(a, b, a.col, b.col, F.lit(None).cast("string"), TEXT)
        x, y = (v.col if v.kind == TEXT else F.when(v.col.isNotNull(), text(v)) for v in (a, b))
        shown = (x if a.kind == TEXT else y) if op != "%" else x
        return _one_sided(a, b, x, y, shown, TEXT)
    x, y, kind = _common(a, b)
    if op == "+":
        both = x + y
    elif op == "-":
        both = x - y
    elif op == "*":
        both = x * y
    else:
        if a.kind == b.kind == BOOL:
            zero = x if op == "/" else F.lit(0).cast("bigint")
        else:
            zero = F.lit(None).cast("bigint" if kind == INT else "double")
        if op == "/":
            ratio = F.call_function("div", x, y) if kind == INT else x / y
        else:
            ratio = x % y
        both = F.when(y == 0, zero).otherwise(ratio)
    return _one_sided(a, b, x, y, both, kind)


def negated(a: Value) -> Value:
    if a.kind in (TEXT, NULL):
        return literal(None)
    return Value(-a.col.cast("bigint") if a.kind == BOOL else -a.col, INT if a.kind == BOOL else a.kind, a.never_null)


def _comparable(a: Value, b: Value) -> bool:
    return a.kind == b.kind or (a.kind in _NUMERIC and b.kind in _NUMERIC)


def equal(a: Value, b: Value) -> Value:
    if NULL in (a.kind, b.kind):
        return Value(is_null(b) if a.kind == NULL else is_null(a), BOOL, True)
    if not _comparable(a, b):
        both = is_null(a) & is_null(b)
        return Value(both, BOOL, True)
    x, y = (a.col, b.col) if a.kind == b.kind else _common(a, b)[:2]
    if a.never_null and b.never_null:
        return Value(x == y, BOOL, True)
    return Value(x.eqNullSafe(y), BOOL, True)


def unequal(a: Value, b: Value) -> Value:
    """The opposite of equal(), but for a null left of a text: that counts as not unequal."""
    out = ~equal(a, b).col
    if b.kind == TEXT and not a.never_null:
        out = out & ~(is_null(a) & (b.col == ""))  if b.literal in (None, "") else out
    return Value(out, BOOL, True)


def compared(op: str, a: Value, b: Value) -> Value:
    with_equal = op in ("<=", ">=")
    if NULL in (a.kind, b.kind) or not _comparable(a, b):
        return Value(is_null(a) & is_null(b) if with_equal else F.lit(False), BOOL, True)
    x, y = (a.col, b.col) if a.kind == b.kind else _common(a, b)[:2]
    holds = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if a.never_null and b.never_null:
        return Value(holds, BOOL, True)
    out = F.coalesce(holds, F.lit(False))
    if with_equal and not a.never_null and not b.never_null:
        out = out | (is_null(a) & is_null(b))
    return Value(out, BOOL, True)


def bare_comparison(op: str, a: Value, b: Value) -> Column | None:
    """A predicate without null handling that is true for the same rows, where one side is a literal: it reaches the scan."""
    if not _comparable(a, b) or NULL in (a.kind, b.kind) or (a.literal is None) == (b.literal is None):
        return None
    x, y = (a.col, b.col) if a.kind == b.kind else _common(a, b)[:2]
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y}.get(op)


def call(name: str, *args: Value) -> Value:
    d = [to_double(v) for v in args]
    if name in ("sin", "cos", "tan", "atan", "exp"):
        return Value(getattr(F, name)(d[0]), DOUBLE, True)
    if name == "abs":
        return Value(F.abs(d[0]), DOUBLE, True)
    if name == "log":
        return Value(F.when(d[0] > 0, F.log(d[0])).when(d[0] == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))), DOUBLE, True)
    if name == "length":
        return Value((F.length(F.encode(text(args[0]), "UTF-16BE")) / 2).cast("bigint"), INT, True)
    if name == "bool":
        return Value(to_bool(args[0]), BOOL, True)
    if name == "int":
        return Value(to_int(args[0]), INT, True)
    if name == "float":
        return Value(d[0], DOUBLE, True)
    if name == "str":
        return Value(text(args[0]), TEXT, True)
    if name == "min":
        return Value(F.least(*d), DOUBLE, True)
    if name == "max":
        return Value(F.greatest(*d), DOUBLE, True)
    if name == "pow":
        return Value(F.pow(*d), DOUBLE, True)
    raise ValueError(f"no function {name}")


def matches(v: Value, pattern: str) -> Value:
    return Value(text(v).rlike(rf"\A(?:{pattern})\z"), BOOL, True)


def replaced(v: Value, pattern: str, form: str) -> Value:
    return Value(F.regexp_replace(text(v), pattern, form), TEXT, True)
