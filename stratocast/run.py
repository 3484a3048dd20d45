"""Runs a registered query over a folder of tables and writes its rows: python -m stratocast.run QUERY TABLES OUTPUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stratocast import catalog, catalog_analysis, catalog_cleaning, catalog_models  # noqa: F401  the others register their queries in the first
from stratocast.session import ship_package


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("query", choices=sorted(catalog.QUERIES), help="a registered query")
    parser.add_argument("tables", help="folder of the input tables")
    parser.add_argument("output", help="folder for the result, as Parquet")
    parser.add_argument("--overwrite", action="store_true", help="replace what the output holds; else an existing one is left alone")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> bool:
    """Whether the query ran: an output that is there and not to be replaced is left as it is."""
    wanted = arguments(given)
    spark = ship_package(SparkSession.builder.getOrCreate())
    path = spark._jvm.org.apache.hadoop.fs.Path(wanted.output)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and not wanted.overwrite:
        return False
    catalog.QUERIES[wanted.query](spark, wanted.tables).write.mode("overwrite").parquet(wanted.output)
    return True


if __name__ == "__main__":
    main()
