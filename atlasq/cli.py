"""Run a map's XML and print or write what it draws: python -m atlasq.cli map.xml [--out folder]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import processor, spec
from .sources import registry


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("map")
    p.add_argument("--out", help="folder for Parquet; rows are printed without it")
    p.add_argument("--point", nargs=3, metavar=("LAYER", "X", "Y"), help="a point query instead: layer number and pixel")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    with open(o.map, encoding="utf-8") as f:
        m = spec.load_map(f.read())
    tables = registry.tables_of(spark, m)
    if o.point:
        out = processor.query_map_point(m, tables, int(o.point[0]), float(o.point[1]), float(o.point[2]))
    else:
        out = processor.draw_order(processor.run_map(m, tables))
    if o.out:
        out.write.parquet(o.out)
    else:
        out.drop("geom").show(50, truncate=False)


if __name__ == "__main__":
    main()
