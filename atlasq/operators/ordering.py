"""Sorting, runs of equal values, limits and choices by order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A column's name, and whether it ascends; nulls are last either way.
Key = tuple[str, bool]
#: Ranges of an order at most, rows drawn for each, and branches before a row's range is looked up in a table.
MOST, SAMPLE, FAN = 4096, 16, 64

_SORT = re.compile(r"\s*([A-Za-z0-9_-]+)(?:\s+(ASC|DESC))?\s*$", re.IGNORECASE)


def parse_sort(text: str) -> tuple[str, bool]:
    m = _SORT.match(text)
    if not m:
        raise ValueError(f"not a sort order: {text!r}")
    return m[1], (m[2] or "ASC").upper() == "ASC"


def sort_order(text: str, tie: str = "id") -> list[Column]:
    return _columns(sort_keys(text, tie))


def sort_keys(text: str, tie: str = "id") -> list[Key]:
    return [parse_sort(text), (tie, True)]


def _columns(keys: list[Key]) -> list[Column]:
    return [F.col(f"`{name}`").asc_nulls_last() if up else F.col(f"`{name}`").desc_nulls_last() for name, up in keys]


def sort_by(df: DataFrame, text: str, tie: str = "id", number: str | None = None) -> DataFrame:
    """Rows in the order of an attribute, nulls last, equal ones by id: a total order. number adds each row's place.

    Places come from ranges of the order: rows are counted by range, and a row's place is what the
    ranges before its own hold and its rank in it. No task has all rows.
    """
    if number is None:
        return df.orderBy(*sort_order(text, tie))
    return numbered(df, sort_keys(text, tie), number)


def _before(keys: list[Key], border: list[Column]) -> Column:
    """Whether a row comes before a border in the order of keys, nulls last."""
    out = F.lit(False)
    for (name, up), b in reversed(list(zip(keys, border))):
        c = F.col(f"`{name}`")
        less = F.when(b.isNull(), c.isNotNull()).otherwise(F.coalesce((c < b) if up else (c > b), F.lit(False)))
        out = less | (c.eqNullSafe(b) & out)
    return out


def ranged(df: DataFrame, keys: list[Key], part: str = "_part") -> DataFrame:
    """df with the number of the range of the order that a row lies in: as many ranges as shuffle partitions, MOST at most.

    The borders are drawn from the table once and are then part of the plan, so that every use of the
    result deals rows alike, whatever columns it keeps. A range partitioning draws its own at each use.
    """
    n = min(MOST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"k{i}" for i in range(len(keys))]
    # one row for each of SAMPLE hash values a range: spread over all rows, combined before the shuffle
    own = df.select(*[F.col(f"`{name}`").alias(k) for (name, _), k in zip(keys, names)])
    drawn = own.groupBy(F.pmod(F.xxhash64(*names), F.lit(SAMPLE * n)).alias("slot")).agg(F.min_by(F.struct(*names), F.xxhash64(F.lit(1), *names)).alias("b")).select("b.*")
    few = drawn.orderBy(*_columns([(k, up) for k, (_, up) in zip(names, keys)])).collect()
    borders = list(dict.fromkeys(few[len(few) * i // n] for i in range(1, n))) if few else []
    step = -(-len(borders) // FAN) if borders else 1
    tops = borders[step - 1 :: step]

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        types = [drawn.schema[k].dataType for k in names]
        return F.when(_before(keys, [F.lit(v).cast(t) for v, t in zip(tops[mid], types)]), tree(low, mid)).otherwise(tree(mid + 1, high))

    if step == 1:
        return df.withColumn(part, tree(0, len(tops)))
    # one row for each of at most FAN + 1 groups of borders
    groups = [(i, borders[i * step : (i + 1) * step - 1]) for i in range(len(tops) + 1)]
    of, group, own_borders = free_names("_of _group _borders", df, part)
    table = df.sparkSession.createDataFrame(groups, T.StructType([T.StructField(group, T.IntegerType()), T.StructField(own_borders, T.ArrayType(drawn.schema))]))
    grouped = df.withColumn(of, tree(0, len(tops))).join(F.broadcast(table), F.col(of) == F.col(group))
    inner = F.size(F.filter(own_borders, lambda b: ~_before(keys, [b[k] for k in names])))
    return grouped.withColumn(part, F.col(of) * step + inner).drop(of, group, own_borders)


def free_names(names: str, *given: DataFrame | str) -> list[str]:
    """The names (parted by blanks), each lengthened until none of the given tables' columns, and no given name, is called so."""
    taken = {c.lower() for g in given for c in ([g] if isinstance(g, str) else g.columns)}
    out = []
    for name in names.split():
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, keys: list[Key], name: str) -> DataFrame:
    """df with each row's place in the order of keys, from 1."""
    part, p, before, rank = free_names("_part _p _before _rank", df, name)
    parted = ranged(df, keys, part)
    counts = parted.groupBy(F.col(part).alias(p)).count()
    # as many rows as ranges
    ahead = counts.select(p, (F.sum("count").over(Window.orderBy(p)) - F.col("count")).alias(before))
    ranked = parted.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*_columns(keys))))
    return ranked.join(F.broadcast(ahead), F.col(part) == F.col(p)).withColumn(name, (F.col(before) + F.col(rank)).cast("long")).drop(part, p, before, rank)


def group_runs(df: DataFrame, key: str, order: str, run: str = "run_id") -> DataFrame:
    """Number the runs of rows, in the given order, that share the key of the row before them (two nulls are equal).

    The order is cut into ranges; each range finds its own starts from the row before, only the first
    row of a range looks at the last row of an earlier one, and the starts are counted by range.
    """
    part, new, within, p, base = free_names("_part _new _inside _p _base", df, run)
    parted = ranged(df, [(order, True)], part)
    by = F.col(f"`{order}`").asc_nulls_last()
    w = Window.partitionBy(part).orderBy(by)
    k = F.col(f"`{key}`")
    marked = parted.withColumn(new, F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise((~k.eqNullSafe(F.lag(k).over(w))).cast("int")))
    place = F.struct(F.col(f"`{order}`").isNull(), F.col(f"`{order}`"))
    ends = marked.groupBy(F.col(part).alias(p)).agg(F.min_by(F.struct(k.alias("k")), place).alias("first"), F.max_by(F.struct(k.alias("k")), place).alias("last"), F.sum(new).alias("inner"))
    # as many rows as ranges
    seq = Window.orderBy(p)
    ends = ends.withColumn("fresh", F.when(F.lag("last").over(seq).isNull(), 1).otherwise((~F.col("first.k").eqNullSafe(F.lag("last").over(seq)["k"])).cast("int")))
    starts = ends.select(p, (F.sum(F.col("inner") + F.col("fresh")).over(seq) - F.col("inner")).alias(base))
    inside = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(within, inside).join(F.broadcast(starts), F.col(part) == F.col(p)).withColumn(run, (F.col(base) + F.col(within)).cast("long")).drop(part, new, within, p, base)


def runs(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per run: run_id, the key, first and last place, rows."""
    return group_runs(df, key, order).groupBy("run_id").agg(F.first(key).alias(key), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def first_rows(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(n)


def largest(df: DataFrame, by: list[str], part: Column, area: Column) -> DataFrame:
    """The part with the largest area of each group."""
    return df.groupBy(*by).agg(F.max_by(part, area).alias("part"), F.max(area).alias("area"))


def nearest(df: DataFrame, by: list[str], part: Column, distance: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(part, distance).alias("part"), F.min(distance).alias("distance"))
