"""``python -m leafmill --domain DOMAIN [--prep] --pages PATH``: one domain's crawl over stored pages."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.urls import input_domain
from .plans import site


def main(argv: list[str] | None = None) -> int:
    said = argparse.ArgumentParser(prog="leafmill", description="Crawl one domain over stored pages; look for duplicates, or for templates with --prep.")
    said.add_argument("--domain", required=True, help="a domain name or a URL")
    said.add_argument("--prep", action="store_true", help="discover template patterns across the domain's pages")
    said.add_argument("--pages", required=True, help="Parquet table of page_id, url, html")
    args = said.parse_args(argv)
    spark = SparkSession.builder.appName("leafmill").getOrCreate()
    domain = spark.range(1).select(input_domain(F.lit(args.domain)).alias("d")).first().d
    if domain is None:
        print(f"Invalid domain or URL: {args.domain}", file=sys.stderr)
        return 1
    got = site.run(spark.read.parquet(args.pages), [args.domain], args.prep)
    # at most the budget's pages
    if args.prep:
        for r in got.report.orderBy("line").collect():
            print(r.line)
        for r in got.summary.filter(F.col("domain") == domain).collect():
            print(r.json)
        return 0
    for r in got.report.orderBy("url").collect():
        print(f"URL: {r.url}\nTitle: {r.title}\nDomain: {r.domain}\n")
    for r in got.summary.filter(F.col("domain") == domain).collect():
        if r.analyzed:
            print(f"Found {r.n_duplicates} duplicate node patterns for domain {domain}" if r.n_duplicates else f"No duplicate patterns found for domain {domain}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
