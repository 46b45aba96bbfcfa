"""Delimited text with geometry."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..operators.ordering import numbered
from ..plans.processor import SpatialTable

SAMPLE = 4000
_NUMERIC = re.compile(r"[-+.eE0-9]+")


@dataclass(frozen=True)
class Dialect:
    separator: str
    quote: str


def sniff(head: str) -> Dialect:
    """Separator and quote from a file's first characters.

    Before the first line end: tabs win if there are more of them than commas, then bars, then
    semicolons. A single quote needs an even number of them and as many columns in every line.
    """
    head = head[:SAMPLE]
    lines = re.split(r"\r\n|\n|\r", head)
    first = lines[0]
    best, count = ",", first.count(",")
    for sign in ("\t", "|", ";"):
        n = first.count(sign)
        if n and n > count:
            best, count = sign, n
    whole = [line for line in (lines[:-1] if len(head) == SAMPLE and len(lines) > 1 else lines) if line.strip()]
    single = bool(whole) and "'" in head and all(line.count("'") % 2 == 0 for line in whole)
    if single:
        columns = {len(_split(line, best, "'")) for line in whole}
        single = len(columns) == 1 and any(re.search(rf"(^|{re.escape(best)})\s*'", line) for line in whole)
    return Dialect(best, "'" if single else '"')


def _split(line: str, separator: str, quote: str) -> list[str]:
    out, own, inside = [], [], False
    for c in line:
        if c == quote:
            inside = not inside
        elif c == separator and not inside:
            out.append("".join(own))
            own = []
        else:
            own.append(c)
    return [*out, "".join(own)]


@dataclass
class Geometries:
    """Which columns hold geometry."""

    wkt: str | None = None
    geojson: str | None = None
    x: str | None = None
    y: str | None = None


def geometry_columns(headers: list[str]) -> Geometries:
    """By name, case ignored; a later column takes the place of an earlier one."""
    out = Geometries()
    for h in headers:
        low = h.strip().lower()
        if low == "wkt" or "geom" in low:
            out.wkt, out.geojson = h, None
        elif low == "geojson":
            out.geojson, out.wkt = h, None
        if low in ("x", "lon", "lng", "long") or "longitude" in low:
            out.x = h
        if low in ("y", "lat") or "latitude" in low:
            out.y = h
    return out


def cell_kind(text: str) -> str:
    """How a cell reads: text if empty, longer than 20, or with a leading zero and no point; else double, integer, boolean or text."""
    t = text.strip()
    if not t or len(t) > 20 or (len(t) > 1 and t[0] == "0" and "." not in t):
        return "string"
    if _NUMERIC.fullmatch(t):
        if any(c in t for c in ".eE"):
            try:
                float(t)
                return "double"
            except ValueError:
                return "string"
        if re.fullmatch(r"[-+]?\d+", t) and -(1 << 63) <= int(t) < 1 << 63:
            return "bigint"
        return "string"
    return "boolean" if t.lower() in ("true", "false") else "string"


def typed(c: Column) -> dict[str, Column]:
    """The same rule as columns: the kind of each cell and its value in each kind."""
    t = F.trim(c)
    plain = (t == "") | (F.length(t) > 20) | ((F.length(t) > 1) & t.startswith("0") & ~t.contains("."))
    number = t.rlike(r"^[-+.eE0-9]+$")
    dotted = t.rlike(r"[.eE]")
    kind = F.when(plain, "string").when(number & dotted & t.try_cast("double").isNotNull(), "double").when(number & ~dotted & t.try_cast("bigint").isNotNull(), "bigint").when(F.lower(t).isin("true", "false"), "boolean").otherwise("string")
    return {"kind": kind, "l": F.when(kind == "bigint", t.try_cast("bigint")), "d": F.when(kind == "double", t.try_cast("double")), "b": F.when(kind == "boolean", F.lower(t) == "true"), "s": c}


@dataclass
class Options:
    separator: str | None = None
    quote: str | None = None
    headers: str | None = None
    strict: bool = False
    row_limit: int = 0
    encoding: str = "utf-8"
    extra: dict = field(default_factory=dict)


def read(spark: SparkSession, path: str | None = None, inline: str | None = None, options: Options | None = None) -> SpatialTable:
    """A spatial table from a file or a text.

    Blank lines are skipped; a line with another number of columns or without readable geometry is an
    error if strict, else left out. Ids count the rows that stay, from 1, in file order. row_limit counts
    lines of the file, its header among them. Types come from the first row that stays; a cell that
    doesn't fit its column's type is null.
    """
    o = options or Options()
    if (path is None) == (inline is None):
        raise ValueError("give a path or an inline text")
    if inline is not None:
        rows = [x for x in re.split(r"\r\n|\n|\r", inline)]
        lines = spark.createDataFrame([("", i, x) for i, x in enumerate(rows)], "_file string, _n long, value string")
        head = inline[:SAMPLE]
    else:
        reader = spark.read.option("encoding", o.encoding)
        # scans take large files first, so the order of files is that of their names
        lines = reader.text(path).withColumns({"_file": F.input_file_name(), "_n": F.monotonically_increasing_id()})
        head = "\n".join(r["value"] for r in lines.orderBy("_file", "_n").limit(50).collect())
    guess = sniff(head)
    sep, quote = o.separator or guess.separator, o.quote or guess.quote
    filled = lines.where(F.length(F.regexp_replace("value", r"""[",' ]""", "")) > 0)
    head_row = None
    if o.headers:
        names = _split(o.headers, sep, quote)
    else:
        head_row = filled.orderBy("_file", "_n").first()
        if head_row is None:
            raise ValueError("there is no header")
        names = _split(head_row["value"], sep, quote)
        filled = filled.where((F.col("_file") > head_row["_file"]) | (F.col("_file") == head_row["_file"]) & (F.col("_n") > head_row["_n"]))
    clean: list[str] = []
    for i, n in enumerate(x.strip() for x in names):
        if not n and o.strict:
            raise ValueError("a header is empty")
        clean.append(n or f"_{i + 1}")
    at = geometry_columns(clean)
    if not (at.wkt or at.geojson or (at.x and at.y)):
        raise ValueError(f"no geometry among the columns {clean}")
    if o.row_limit:
        allowed = lines.orderBy("_file", "_n").limit(o.row_limit).select("_file", "_n")
        filled = filled.join(allowed, ["_file", "_n"], "left_semi")
    schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(clean))), T.StructField("_bad", T.StringType())])
    parsed = filled.withColumn("_r", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), {"sep": sep, "quote": quote, "columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\u0000", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}))
    rows = parsed.select("_file", "_n", *[F.coalesce(F.col(f"_r.c{i}"), F.lit("")).alias(f"c{i}") for i in range(len(clean))], (F.col("_r._bad").isNotNull()).alias("_bad"))
    index = {n: f"c{i}" for i, n in enumerate(clean)}
    if at.wkt or at.geojson:
        rows = rows.withColumn("geom", G.from_wkt(index[at.wkt]) if at.wkt else G.from_geojson(index[at.geojson]))
        good = F.col("geom").isNotNull()
    else:
        rows = rows.withColumns({"_x": F.trim(index[at.x]).try_cast("double"), "_y": F.trim(index[at.y]).try_cast("double")})
        good = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    good = good & ~F.col("_bad")
    if o.strict:
        bad = rows.where(~good).select("_n").limit(1).collect()
        if bad:
            raise ValueError(f"line {bad[0]['_n'] + 1} can't be read")
    rows = rows.where(good)
    first = rows.orderBy("_file", "_n").first()
    kinds = {n: cell_kind(first[c]) if first else "string" for n, c in index.items()}
    out = numbered(rows, [("_file", True), ("_n", True)], "id")
    skip = {at.wkt, at.geojson}
    attributes = [(F.trim(c).try_cast(kinds[n]) if kinds[n] != "string" else F.col(c)).alias(n) for n, c in index.items() if n not in skip]
    if at.wkt or at.geojson:
        e = G.envelope("geom")
        out = out.withColumn("_e", e)
        core = [F.col("id"), F.col("geom"), *[F.col(f"_e.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")], G.simple_kind(G.wkb_kind(F.col("geom"))).alias("geom_type")]
    else:
        core = [F.col("id"), F.col("_x").alias("minx"), F.col("_y").alias("miny"), F.col("_x").alias("maxx"), F.col("_y").alias("maxy"), F.lit(1).alias("geom_type")]
        attributes += [F.col("_x").alias("x") if "x" not in clean else F.lit(None).alias("_x0"), F.col("_y").alias("y") if "y" not in clean else F.lit(None).alias("_y0")]
    return SpatialTable(out.select(*core, *attributes).drop("_x0", "_y0"))
