"""Selection of nodes by descendant paths such as ``table tr.row td.title``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_matches(part: str, tag: Column, classes: Column) -> Column:
    """``tag.c1.c2``: the tag is equal and all classes are there; ids play no part."""
    name, *wanted = part.split(".")
    return reduce(lambda a, c: a & F.array_contains(classes, c), wanted, tag == name)


def match_count(path: str) -> Column:
    """How many ways the path's parts fit the node and its ancestors, in order, the node being the last."""
    parts = path.split()
    if not parts:
        return F.lit(0).cast("long")
    last = part_matches(parts[-1], F.col("tag"), F.col("classes"))
    zero = F.array(*[F.lit(int(k == 0)).cast("long") for k in range(len(parts))])

    def step(ways: Column, at: Column) -> Column:
        fit = [part_matches(p, at["tag"], at["classes"]).cast("long") for p in parts[:-1]]
        return F.array(ways[0], *[ways[k + 1] + ways[k] * f for k, f in enumerate(fit)])

    above = F.slice("path", F.lit(1), F.size("path") - 1)
    return F.when(last, F.aggregate(above, zero, step)[len(parts) - 1]).otherwise(F.lit(0).cast("long"))


def find_by_path(nodes: DataFrame, path: str, repeat: bool = False) -> DataFrame:
    """The nodes that the path selects, with ``matches``; ``repeat`` gives each as often as it matches."""
    found = nodes.withColumn("matches", match_count(path)).filter("matches > 0")
    return found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("matches")))).drop("_i") if repeat else found
