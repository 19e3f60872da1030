"""Which variant of each package counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_path(column: Column) -> Column:
    """A package path without the note of the test that it was built for."""
    return F.regexp_replace(column, r" \[.*\]$", "")


def selected(packages: DataFrame) -> DataFrame:
    """One variant for each normal path, of (pkg_path, for_test, n_files, load_order): a test variant before others, then
    the one of most files, then the first. Synthetic test mains (``.test``) are left out.
    """
    real = packages.filter(~F.col("pkg_path").endswith(".test")).withColumn("path", normal_path(F.col("pkg_path")))
    order = Window.partitionBy("path").orderBy(F.desc("for_test"), F.desc("n_files"), "load_order")
    return real.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
