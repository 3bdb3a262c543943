"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import ROWS, join_salted, materialize, partitions, release, shared_root, sliced, spread

__all__ = ["ROWS", "free", "join_salted", "join_skewed", "lower_ascii", "materialize", "partitions", "release", "shared_root", "sliced", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def free(name: str, columns: list[str]) -> str:
    """``name``, or a longer one, that none of ``columns`` has."""
    while name.lower() in map(str.lower, columns):
        name = f"_{name}"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_skewed(rows: DataFrame, side: DataFrame, on: list[str], count: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which holds each key once and in ``count`` how many of the ``n`` rows have it.

    Keys of more rows than an eighth of a partition's share are broadcast, so that their
    rows stay where they are; of these there are at most eight a partition, whatever the
    data.  The others are shuffled.  ``count`` doesn't come out.
    """
    least = n // (8 * partitions(rows.sparkSession)) + 1
    hot, cold = side.filter(F.col(count) >= least).drop(count), side.filter(F.col(count) < least).drop(count)
    stay = rows.join(F.broadcast(hot), on, how)
    go = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return stay.unionByName(go)
