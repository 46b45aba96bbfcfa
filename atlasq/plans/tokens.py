"""SQL texts with tokens for the viewport, as table sources take them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.boxes import Box, Extent
from .spec import SpatialQuery

_TOKEN = re.compile(r"!(@?\w+)!")


def shown(x: float) -> str:
    """Sixteen significant digits with a decimal point."""
    text = f"{x:#.16g}"
    if "." not in text or "e" in text:
        return text
    text = text.rstrip("0")
    return text + "0" if text.endswith(".") else text


def box_sql(e: Extent) -> str:
    """A struct literal of a box; its fields compare with the box columns."""
    return f"named_struct('minx', {shown(e.minx)}D, 'miny', {shown(e.miny)}D, 'maxx', {shown(e.maxx)}D, 'maxy', {shown(e.maxy)}D)"


def literal(x: object) -> str:
    return "'" + str(x).replace("\\", "\\\\").replace("'", "''") + "'"


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fill(sql: str, q: SpatialQuery) -> str:
    """Tokens replaced: !bbox!, !unbuffered_bbox!, !scale_denominator!, !pixel_width!, !pixel_height!, !@variable!. Unknown ones become NULL."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name.startswith("@"):
            x = q.variables.get(name[1:])
            return "NULL" if x is None else literal(x)
        known = {
            "bbox": lambda: box_sql(q.extent),
            "unbuffered_bbox": lambda: box_sql(q.unbuffered or q.extent),
            "scale_denominator": lambda: shown(q.scale_denominator) + "D",
            "pixel_width": lambda: shown(1 / q.resolution[0]) + "D",
            "pixel_height": lambda: shown(1 / q.resolution[1]) + "D",
        }
        return known[name]() if name in known else "NULL"

    return _TOKEN.sub(one, sql)


def scan(spark: SparkSession, table: str, q: SpatialQuery, row_limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows of a table or of a subquery with tokens. Without !bbox! in the text the box columns are filtered; columns are pruned."""
    text = table.strip()
    source = fill(text, q)
    df = spark.sql(f"SELECT * FROM {source}") if text.startswith("(") or " " in text else spark.table(text)
    if "!bbox!" not in text and {"minx", "miny", "maxx", "maxy"} <= set(df.columns):
        df = df.where(Box.columns().intersects(q.extent))
    if q.names is not None:
        core = [c for c in ("id", "geom", "minx", "miny", "maxx", "maxy") if c in df.columns]
        df = df.select(*core, *[n for n in q.names if n not in core])
    if offset:
        df = df.offset(offset)
    return df.limit(row_limit) if row_limit > 0 else df


_FROM = re.compile(r"\bfrom\b", re.IGNORECASE)
_NAME = re.compile(r"""\s*((?:"[^"]*"|[\w$]+)(?:\s*\.\s*(?:"[^"]*"|[\w$]+))?)""")


def table_from_sql(sql: str) -> str:
    """The table that a text reads: itself, or the first name after the last FROM that a name follows."""
    last = None
    for m in _FROM.finditer(sql):
        name = _NAME.match(sql, m.end())
        if name:
            last = name[1]
    return last if last is not None else sql.strip()
