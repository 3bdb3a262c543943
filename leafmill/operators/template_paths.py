"""Template texts with the element paths at which they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.templates import apply_templates, with_templates


def template_paths(nodes: DataFrame) -> DataFrame:
    """domain, components, template_pattern: each path and pattern once a domain."""
    # a template replaces a number, so nothing else is looked into
    t = with_templates(nodes.filter(F.col("content").rlike(r"(?U)\d")).select("domain", "path", "content"))
    return t.filter(F.col("template_pattern").isNotNull()).select("domain", F.col("path").alias("components"), "template_pattern").distinct()


def path_text(path: str = "components") -> Column:
    """``html > body > div.comments``"""
    return F.array_join(F.transform(path, lambda p: F.array_join(F.concat(F.array(p["tag"]), p["classes"]), ".")), " > ")


def paths_json(paths: DataFrame) -> DataFrame:
    """domain and the JSON document of its template paths, sorted; a domain's distinct patterns are few."""
    one = F.struct("components", "template_pattern")
    return paths.groupBy("domain").agg(F.to_json(F.struct(F.array_sort(F.collect_set(one)).alias("detected_paths")), {"pretty": "true"}).alias("json"))


def normalized(pages: DataFrame) -> DataFrame:
    """Nodes whose contents are their patterns, signed anew, so that texts of one template are duplicates.

    ``pages``: parsed pages, or their node table; of a node table, rows of one page_id, url
    and domain must be one page's.  Pages without a host keep their nodes.  The new
    signature covers the flat list of a subtree, as the parser's own does.
    """
    page = ["page_id", "url", "domain"]
    if "nodes" in pages.columns:
        numbered = pages.withColumn("_row", F.monotonically_increasing_id())  # rows, before they become nodes
        pages = numbered.select(*page, "_row", F.inline("nodes"))
    keys = [*page, "_row"] if "_row" in pages.columns else page
    fields = [c for c in pages.columns if c not in keys and c != "sig"]
    # (domain, page) pairs are grouped null-safe, and nothing is joined back
    d = apply_templates(pages).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pre", *[c for c in fields if c != "pre"]))).alias("_all"))
    d = d.withColumn("_flat", F.transform("_all", lambda n: F.struct(n["tag"], n["classes"], n["id"], n["content"])))
    d = d.select(*page, "_flat", F.inline("_all"))
    sig = F.sha2(F.to_json(F.slice("_flat", F.col("pre") + 1, F.col("size"))), 256)
    return d.select(*page, *fields, sig.alias("sig"))
