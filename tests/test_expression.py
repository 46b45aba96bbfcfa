import math

import pytest
from pyspark.sql import functions as F

from atlasq.functions import expression as X

NUMBERS = [(7, 2), (-7, 2), (9, -4), (6.5, 2), (8, 0.25), (-3.0, 1.5)]
VALUES = [("null", None), ("true", True), ("4", 4), ("4.0", 4.0), ("5.5", 5.5), ("'4'", "4"), ("'oak'", "oak")]


def shown(x):
    return f"({x})" if x < 0 else str(x)


def whole(x):
    return math.floor(x) if x >= 0 else math.ceil(x)


def arithmetic():
    """All operators over pairs of whole and broken numbers: whole ones stay whole, and division drops what is behind the point."""
    for a, b in NUMBERS:
        both = isinstance(a, int) and isinstance(b, int)
        yield f"{shown(a)} + {shown(b)}", a + b
        yield f"{shown(a)} - {shown(b)}", a - b
        yield f"{shown(a)} * {shown(b)}", a * b
        yield f"{shown(a)} / {shown(b)}", whole(a / b) if both else a / b
        yield f"{shown(a)} % {shown(b)}", a - b * whole(a / b) if both else math.fmod(a, b)
        yield f"{shown(a)} / 0", None
        yield f"{shown(a)} % 0", None


def comparisons():
    """Each kind with each kind: numbers compare by value, texts by text, other pairs of kinds are unequal and unordered."""
    number = lambda x: isinstance(x, (int, float)) or x is True
    for s, a in VALUES:
        for t, b in VALUES:
            alike = (number(a) and number(b)) or (isinstance(a, str) and isinstance(b, str)) or (a is None and b is None)
            if a is True or b is True:
                continue
            yield f"{s} = {t}", bool(alike and a == b)
            yield f"{s} < {t}", bool(alike and a is not None and a < b)
            yield f"{s} >= {t}", bool(alike and (a is None or a >= b))


def logic():
    """Every and/or chain of three, from left to right, with and without not."""
    for k in range(32):
        x, y, z = (bool(k >> i & 1) for i in range(3))
        first, second = ("and" if k >> i & 1 else "or" for i in (3, 4))
        apply = lambda w, p, q: p and q if w == "and" else p or q
        yield f"{str(x).lower()} {first} {str(y).lower()} {second} {str(z).lower()}", apply(second, apply(first, x, y), z)
        yield f"not {str(x).lower()} {first} not {str(y).lower()}", apply(first, not x, not y)


CASES = [
    *arithmetic(), *comparisons(), *logic(),
    # other spellings of operators
    ("[size] gt 40 && [size] lt 42.5 || [oak]", True), ("[size] ge 41", True), ("[size] le 40.99", False), ("[size] eq 41", True), ("[size] neq 41", False), ("[size] <> 41", False), ("!false", True),
    # attributes, variables, constants
    ("[tree] = 'elm'", True), ("[tree] + '-' + [size]", "elm-41"), ("[ tree ] = null", True), ("[größe] * 2", 5.0), ("[missing] = null", True), ("[none] != null", False), ("[none] != ''", False), ("'' != [none]", True), ("@v * 3", 21), ("@unset = null", True), ("[x::geometry_type] = point", True), ("[x::geometry_type] = polygon", False),
    ("pi > 3.14159 and pi < 3.1416", True), ("deg_to_rad * 180 = pi", True), ("plain-word", "plain-word"), ("null + 5", 5), ("null - 3", 3), ("'x' - 1", "x"), ("true + true", 2), ("-true", -1), ("[tree] + [size]", "elm41"),
    # functions
    ("sin(pi / 6)", 0.5), ("cos(0)", 1.0), ("tan(atan(2.5))", 2.5), ("exp(log(7))", 7.0), ("abs(-8)", 8.0), ("pow(3, 4)", 81.0), ("min(2, -6.5)", -6.5), ("max(2, -6.5)", 2.0), ("length([tree])", 3), ("length('größe')", 5),
    # conversions
    ("int('42')", 42), ("int(-9.75)", -9), ("int(5.999)", 5), ("float('2' + '.5')", 2.5), ("str(41)", "41"), ("str(0.125)", "0.125"), ("str(20000000.0)", "2e+07"), ("str(250000.0)", "250000"), ("str(0.00002)", "2e-05"), ("str(2.718281828)", "2.71828"), ("bool('')", False), ("bool('no')", True), ("bool(0.5)", True), ("bool(0)", False),
    # patterns
    ("[tree].match('e.m')", True), ("[tree].match('el')", False), ("[city].match('.*ü.*')", True), ("[city].replace('[aeiouü]', '_')", "M_nch_n"), ("'2024-05-06'.replace('(\\d+)-(\\d+)-(\\d+)', '$3.$2.$1')", "06.05.2024"), ("'☀☁☀'.replace('☁', '☂')", "☀☂☀"),
    # escapes
    ("'\\u2600\\u2601'", "☀☁"), ("'\\U0001F40D'", "\U0001F40D"), ("'\\xE2\\x98\\x82'", "☂"), ("'\\ud83d\\udc0d'", "\U0001F40D"),
]


@pytest.fixture(scope="module")
def feature(spark):
    return spark.createDataFrame([("elm", "München", 2.5, 41, True, None, 1)], "tree string, city string, `größe` double, size long, oak boolean, none string, geom_type int")


def test_values(feature):
    cols = [X.column(e, feature, {"v": 7}).alias(f"c{i}") for i, (e, _) in enumerate(CASES)]
    row = feature.select(*cols).first()
    for (e, want), got in zip(CASES, row):
        assert got == pytest.approx(want) if isinstance(want, float) else got == want and type(got) is type(want), (e, got, want)


def test_log_edges(feature):
    row = feature.select(X.column("log(0)", feature).alias("a"), X.column("log(0-1)", feature).alias("b")).first()
    assert row.a == -math.inf and math.isnan(row.b)


@pytest.mark.parametrize("text", ["1 == 1", "not not true", "[a", "'x", "1 +", "(1"])
def test_rejected(text):
    with pytest.raises(X.ExpressionError):
        X.parse(text)


def test_unparse_round_trip():
    for e, _ in CASES:
        tree = X.parse(e)
        if "0.0" in e or "pi" in e or "rad" in e:
            continue
        assert X.unparse(X.parse(X.unparse(tree))) == X.unparse(tree), e


def test_attributes_in_calls():
    assert X.attributes(X.parse("length([a]) + [b] = min([c], 1)")) == {"a", "b", "c"}


def test_pushdown(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet")
    plan = X.where(df, "[c_acctbal] > 5000 and [c_mktsegment] = 'BUILDING'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "coalesce" not in plan


def test_path_and_transform(feature):
    row = feature.select(X.path_column("icons/[tree]-[none]-[size].png", feature).alias("p"), *[c.alias(n) for c, n in zip(X.transform_columns("translate([size], 2) scale(2)", feature), "abcdef")]).first()
    assert row.p == "icons/elm--41.png"
    assert (row.a, row.d, row.e, row.f) == (2.0, 2.0, 41.0, 2.0)
