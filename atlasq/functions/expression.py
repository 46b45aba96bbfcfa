"""Filter expressions: text to syntax tree, syntax tree to a column, and back to text.

`and` and `or` bind alike and group to the left; `not` takes one comparison; relations bind tighter
than equality; `.match(...)` and `.replace(...)` apply at the level of products. What is no
expression but has no blanks is a text by itself.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

UNARY = ("sin", "cos", "tan", "atan", "exp", "log", "abs", "length", "bool", "int", "float", "str")
BINARY = ("min", "max", "pow")
#: Geometry kinds and constants.
KINDS = {"point": 1, "linestring": 2, "polygon": 3, "collection": 4}
CONSTANTS = {"pi": 3.1415926535897932384626433832795, "deg_to_rad": 0.017453292519943295769236907684886, "rad_to_deg": 57.295779513082320876798154814105}
#: The column that [...::geometry_type] reads.
GEOMETRY_TYPE = "geom_type"


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()


_NUMBER = re.compile(r"(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+")
_INTEGER = re.compile(r"\d+")
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"'}


class _Parser:
    def __init__(self, source: str) -> None:
        self.s, self.i = source, 0

    def blank(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def take(self, *signs: str, any_case: bool = False) -> str | None:
        self.blank()
        for sign in signs:
            part = self.s[self.i : self.i + len(sign)]
            if part == sign or any_case and part.lower() == sign:
                self.i += len(sign)
                return sign
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ExpressionError(f"expected {sign!r} at {self.i} in {self.s!r}")

    def logical(self) -> Node:
        left = self.negation()
        while op := self.take("and", "&&", "or", "||"):
            left = Node("and" if op in ("and", "&&") else "or", (left, self.negation()))
        return left

    def negation(self) -> Node:
        self.blank()
        if self.s.startswith("!", self.i) and not self.s.startswith("!=", self.i) or self.s.startswith("not", self.i):
            self.i += 1 if self.s[self.i] == "!" else 3
            return Node("not", (self.equality(),))
        return self.equality()

    def equality(self) -> Node:
        left = self.relation()
        while op := self.take("=", "eq", "is", "!=", "<>", "neq"):
            left = Node("=" if op in ("=", "eq", "is") else "!=", (left, self.relation()))
        return left

    def relation(self) -> Node:
        left = self.sum()
        while True:
            self.blank()
            if self.s.startswith("<>", self.i):
                return left
            op = self.take("<=", "le", "<", "lt", ">=", "ge", ">", "gt")
            if not op:
                return left
            left = Node({"le": "<=", "lt": "<", "ge": ">=", "gt": ">"}.get(op, op), (left, self.sum()))

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            left = Node(op, (left, self.product()))
        return left

    def product(self) -> Node:
        left = self.sign()
        while op := self.take("*", "/", "%", ".match", ".replace"):
            if op == ".match":
                self.need("(")
                left = Node("match", (left, self.quoted()))
                self.need(")")
            elif op == ".replace":
                self.need("(")
                pattern = self.quoted()
                self.need(",")
                left = Node("replace", (left, pattern, self.quoted()))
                self.need(")")
            else:
                left = Node(op, (left, self.sign()))
        return left

    def sign(self) -> Node:
        op = self.take("+", "-")
        return Node("neg", (self.primary(),)) if op == "-" else self.primary()

    def quoted(self) -> str:
        self.blank()
        mark = self.s[self.i : self.i + 1]
        if mark not in ("'", '"'):
            raise ExpressionError(f"expected a quoted text at {self.i} in {self.s!r}")
        self.i += 1
        out: list[str] = []
        raw = bytearray()
        while self.i < len(self.s):
            c = self.s[self.i]
            if c != "\\" or not self.s.startswith("\\x", self.i):
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
            if c == mark:
                self.i += 1
                return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            if c == "\\" and self.i + 1 < len(self.s):
                e = self.s[self.i + 1]
                code = re.compile({"u": r"[0-9a-fA-F]{4}", "U": r"[0-9a-fA-F]{8}", "x": r"[0-9a-fA-F]{2}"}.get(e, r"(?!)")).match(self.s, self.i + 2)
                if code:
                    if e == "x":
                        raw.append(int(code[0], 16))
                    else:
                        out.append(chr(int(code[0], 16)))
                    self.i = code.end()
                    continue
                if e in _ESCAPES:
                    out.append(_ESCAPES[e])
                    self.i += 2
                    continue
            out.append(c)
            self.i += 1
        raise ExpressionError(f"a text isn't closed in {self.s!r}")

    def primary(self) -> Node:
        self.blank()
        for pattern, kind in ((_NUMBER, float), (_INTEGER, int)):
            if m := pattern.match(self.s, self.i):
                self.i = m.end()
                return Node("lit", (kind(m[0]),))
        c = self.s[self.i : self.i + 1]
        if c in ("'", '"'):
            return Node("lit", (self.quoted(),))
        if c == "[":
            end = self.s.find("]", self.i)
            if end <= self.i + 1:
                raise ExpressionError(f"an attribute isn't closed in {self.s!r}")
            name = self.s[self.i + 1 : end]
            self.i = end + 1
            return Node("attr", (name,))
        if m := re.compile(r"@[A-Za-z_][A-Za-z0-9_]*").match(self.s, self.i):
            self.i = m.end()
            return Node("var", (m[0][1:],))
        if self.take("("):
            inner = self.logical()
            self.need(")")
            return inner
        word = re.compile(r"[A-Za-z_]+").match(self.s, self.i)
        if word:
            low = word[0].lower()
            after = self.s[word.end() :].lstrip()[:1]
            if word[0] in UNARY + BINARY and after == "(":
                self.i = word.end()
                self.need("(")
                args = [self.logical()]
                for _ in range(word[0] in BINARY):
                    self.need(",")
                    args.append(self.logical())
                self.need(")")
                return Node("call", (word[0], *args))
            found = {"true": True, "false": False, "null": None, **KINDS}
            if low in found:
                self.i = word.end()
                return Node("lit", (found[low],))
            if word[0] in CONSTANTS:
                self.i = word.end()
                return Node("lit", (CONSTANTS[word[0]],))
        raise ExpressionError(f"no value at {self.i} in {self.s!r}")


def parse(source: str) -> Node:
    p = _Parser(source)
    try:
        tree = p.logical()
        p.blank()
        if p.i == len(source):
            return tree
        problem = ExpressionError(f"unexpected {source[p.i:]!r} in {source!r}")
    except ExpressionError as error:
        problem = error
    bare = source.strip()
    if bare and not re.search(r"[\s\[\]()'\"=<>!@]", bare):
        return Node("lit", (bare,))
    raise problem


def attributes(tree: Node) -> set[str]:
    """Names that an expression reads, those inside function calls included."""
    if tree.op == "attr":
        return {GEOMETRY_TYPE if tree.args[0].strip().endswith("::geometry_type") else tree.args[0]}
    return set().union(*(attributes(a) for a in tree.args if isinstance(a, Node)))


def bind(tree: Node, variables: Mapping[str, object]) -> Node:
    """The tree with variables replaced by their values (null where missing)."""
    if tree.op == "var":
        return Node("lit", (variables.get(tree.args[0]),))
    return Node(tree.op, tuple(bind(a, variables) if isinstance(a, Node) else a for a in tree.args))


def value(tree: Node, schema: T.StructType, variables: Mapping[str, object] | None = None) -> V.Value:
    fields = {f.name: f.dataType for f in schema.fields}

    def go(n: Node) -> V.Value:
        if n.op == "lit":
            return V.literal(n.args[0])
        if n.op == "var":
            return V.literal((variables or {}).get(n.args[0]))
        if n.op == "attr":
            name = n.args[0]
            if name.strip().endswith("::geometry_type"):
                name = GEOMETRY_TYPE
            return V.of_column(F.col(f"`{name.replace('`', '``')}`"), fields[name]) if name in fields else V.literal(None)
        if n.op == "call":
            return V.call(n.args[0], *map(go, n.args[1:]))
        a = go(n.args[0])
        if n.op == "not":
            return V.Value(~V.to_bool(a), V.BOOL, True)
        if n.op == "neg":
            return V.negated(a)
        if n.op == "match":
            return V.matches(a, n.args[1])
        if n.op == "replace":
            return V.replaced(a, n.args[1], n.args[2])
        b = go(n.args[1])
        if n.op == "and":
            return V.Value(V.to_bool(a) & V.to_bool(b), V.BOOL, True)
        if n.op == "or":
            return V.Value(V.to_bool(a) | V.to_bool(b), V.BOOL, True)
        if n.op == "=":
            return V.equal(a, b)
        if n.op == "!=":
            return V.unequal(a, b)
        if n.op in ("<", "<=", ">", ">="):
            return V.compared(n.op, a, b)
        return V.arithmetic(n.op, a, b)

    return go(tree)


def column(source: str | Node, df: DataFrame, variables: Mapping[str, object] | None = None) -> Column:
    """An expression over df's columns."""
    return value(parse(source) if isinstance(source, str) else source, df.schema, variables).col


def predicate(source: str | Node, df: DataFrame, variables: Mapping[str, object] | None = None) -> Column:
    """An expression as a condition. Comparisons with literals joined by `and` stay bare, so that they reach the scan."""
    tree = parse(source) if isinstance(source, str) else source

    def go(n: Node) -> Column:
        if n.op == "and":
            return go(n.args[0]) & go(n.args[1])
        if n.op in ("<", "<=", ">", ">=", "="):
            bare = V.bare_comparison(n.op, value(n.args[0], df.schema, variables), value(n.args[1], df.schema, variables))
            if bare is not None:
                return bare
        return V.to_bool(value(n, df.schema, variables))

    return go(tree)


def where(df: DataFrame, source: str, variables: Mapping[str, object] | None = None) -> DataFrame:
    return df.where(predicate(source, df, variables))


def unparse(tree: Node) -> str:
    """Text that parses to the same tree."""
    if tree.op == "lit":
        x = tree.args[0]
        if x is None or isinstance(x, bool):
            return {None: "null", True: "true", False: "false"}[x]
        if isinstance(x, float):
            return f"{x:g}"
        return str(x) if isinstance(x, int) else _quote(x)
    if tree.op == "attr":
        return f"[{tree.args[0]}]"
    if tree.op == "var":
        return f"@{tree.args[0]}"
    if tree.op == "call":
        return f"{tree.args[0]}({','.join(map(unparse, tree.args[1:]))})"
    if tree.op == "neg":
        return f"-{unparse(tree.args[0])}"
    if tree.op == "not":
        return f"not ({unparse(tree.args[0])})"
    if tree.op == "match":
        return f"{unparse(tree.args[0])}.match({_quote(tree.args[1], False)})"
    if tree.op == "replace":
        return f"{unparse(tree.args[0])}.replace({_quote(tree.args[1], False)},{_quote(tree.args[2], False)})"
    return f"({unparse(tree.args[0])}{f' {tree.op} ' if tree.op in ('and', 'or') else tree.op}{unparse(tree.args[1])})"


def _quote(text: str, escape: bool = True) -> str:
    return "'" + (text.replace("\\", "\\\\") if escape else text).replace("'", "\\'") + "'"


_PATH_PART = re.compile(r"\[([^\]]+)\]")


def path_column(source: str, df: DataFrame) -> Column:
    """A path with attributes in brackets, each replaced by its text (nothing for null)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    at = 0
    for m in _PATH_PART.finditer(source):
        parts.append(F.lit(source[at : m.start()]))
        parts.append(V.text(V.of_column(F.col(f"`{m[1]}`"), fields[m[1]])) if m[1] in fields else F.lit(""))
        at = m.end()
    return F.concat(*parts, F.lit(source[at:]))


_STEP = re.compile(r"\s*(matrix|translate|scale|rotate|skewX|skewY)\s*\(")


def transform_steps(source: str) -> list[tuple[str, list[Node]]]:
    """A list of affine steps whose arguments are expressions, divided by commas or blanks."""
    out, at = [], 0
    while at < len(source.rstrip().rstrip(",")):
        m = _STEP.match(source, at)
        if not m:
            raise ExpressionError(f"no transform at {at} in {source!r}")
        p = _Parser(source)
        p.i = m.end()
        args = [p.sum()]
        while not p.take(")"):
            p.take(",")
            args.append(p.sum())
        if len(args) not in {"matrix": (6,), "translate": (1, 2), "scale": (1, 2), "rotate": (1, 3), "skewX": (1,), "skewY": (1,)}[m[1]]:
            raise ExpressionError(f"{m[1]} doesn't take {len(args)} numbers")
        out.append((m[1], args))
        p.take(",")
        p.blank()
        at = p.i
    return out


def transform_columns(source: str, df: DataFrame, variables: Mapping[str, object] | None = None) -> tuple[Column, ...]:
    """The six columns (sx, shy, shx, sy, tx, ty) of a transform; the first step is applied last, as nested frames are."""
    one, zero = F.lit(1.0), F.lit(0.0)
    m: tuple[Column, ...] = (one, zero, zero, one, zero, zero)

    def times(p: tuple[Column, ...], q: tuple[Column, ...]) -> tuple[Column, ...]:
        """First p, then q."""
        return (p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3], p[4] * q[0] + p[5] * q[2] + q[4], p[4] * q[1] + p[5] * q[3] + q[5])

    for name, args in transform_steps(source):
        x = [V.to_double(value(a, df.schema, variables)) for a in args]
        if name == "matrix":
            step = tuple(x)
        elif name == "translate":
            step = (one, zero, zero, one, x[0], x[1] if len(x) > 1 else zero)
        elif name == "scale":
            step = (x[0], zero, zero, x[1] if len(x) > 1 else x[0], zero, zero)
        elif name == "rotate":
            a = F.radians(x[0])
            step = (F.cos(a), F.sin(a), -F.sin(a), F.cos(a), zero, zero)
            if len(x) == 3:
                step = times(times((one, zero, zero, one, -x[1], -x[2]), step), (one, zero, zero, one, x[1], x[2]))
        else:
            t = F.tan(F.radians(x[0]))
            step = (one, zero, t, one, zero, zero) if name == "skewX" else (one, t, zero, one, zero, zero)
        m = times(step, m)
    return m


#: Label text transforms by name.
TEXT_TRANSFORMS = {"none": lambda c: c, "uppercase": F.upper, "lowercase": F.lower, "capitalize": F.initcap, "reverse": F.reverse}
