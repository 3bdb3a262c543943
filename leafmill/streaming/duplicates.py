"""Duplicate counts over a stream of pages (an extension of our own)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.duplicates import FIELDS, signature_counts
from ..sources.pages import node_table, parse_pages


def streaming_duplicates(pages: DataFrame) -> DataFrame:
    """Running signature counts of a streaming ``pages`` frame, for the ``update`` or ``complete`` output mode.

    Counts only grow, so a signature that has once been a duplicate stays one.  Whether
    a domain has two pages is for the sink to check: a stream can't look back.
    """
    return signature_counts(node_table(parse_pages(pages, links=False, fields=FIELDS)))
