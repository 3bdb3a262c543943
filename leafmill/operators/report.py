"""What a crawl prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(titles: DataFrame) -> DataFrame:
    """url, title, domain of completed URLs."""
    return titles.select("url", F.coalesce("title", F.lit("No title found")).alias("title"), "domain")


def prep_listing(titles: DataFrame) -> DataFrame:
    """domain and a line for each completed URL."""
    return titles.select("domain", F.concat(F.lit("  - "), "url", F.lit(" ("), F.coalesce("title", F.lit("No title")), F.lit(")")).alias("line"))
