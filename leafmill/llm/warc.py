"""Content-addressed WARC archive.

``write_archive`` stores every payload once, under its SHA-256, and every record's
exact header text apart from it; ``read_archive`` checks each stored payload against
its digest and joins headers and payloads back into the records.

A payload's digest is verified while writing: all rows of one SHA-256 must have the
same SHA-1 and length, else the write fails.  Of records with equal payloads of at
least ``min_revisit_bytes`` bytes, that with the largest page_id is the response and
the others revisit it; shorter payloads are stored once as well, but their records are
all responses.

Defined cases: a null html is an empty payload; a null url an empty WARC-Target-URI; a
null page_id is smaller than any other (a group of nulls alone is all responses);
repeated rows of the largest page_id are all responses.  Other columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_salted, shared_root, table

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The capture time of all records: the table has none.
WARC_DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(hexed: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a digest given in hex; five hex digits are four base32 ones."""
    groups = []
    for at in range(0, digits, 5):
        n = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            groups.append(F.substring(F.lit(_B32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*groups)


def _header(*lines: tuple[str, Column]) -> Column:
    out = [F.lit("WARC/1.1\r\n")]
    for name, value in lines:
        out += [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in out])


def _uri(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", "")


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write the tables ``payloads`` and ``headers`` under ``path``."""
    rec = pages.select(
        "page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # equal payloads of a task fold before the shuffle, so a hot one costs a row per task
    store = rec.groupBy("digest").agg(
        F.max("page_id").alias("owner"),
        F.count("*").alias("records"),
        F.first("payload").alias("payload"),
        F.min(F.struct(F.sha1("payload").alias("s"), F.octet_length("payload").alias("n"))).alias("lo"),
        F.max(F.struct(F.sha1("payload").alias("s"), F.octet_length("payload").alias("n"))).alias("hi"),
    )
    store = store.select(
        "digest", "owner", "records", F.col("lo.s").alias("sha1"), F.col("lo.n").cast("long").alias("bytes"),
        F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(
            F.raise_error(F.lit("two payloads share a SHA-256")).cast("binary")).alias("payload"),
    )
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "owner", "records", "sha1", "bytes")
    # the records of a payload that many pages share are dealt to several tasks
    total = owners.agg(F.sum("records")).first()[0] or 0
    heads = join_salted(rec.select("page_id", "url", "digest"), owners, ["digest"], "records", total, ["page_id", "url"])
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    block = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    ident = F.concat(F.lit("<urn:leafmill:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    head = F.when(
        revisit,
        _header(
            ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(WARC_DATE)),
            ("WARC-Target-URI", _uri(F.col("url"))), ("WARC-Payload-Digest", block),
            ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.concat(F.lit("<urn:leafmill:page:"), F.col("owner").cast("string"), F.lit(">"))),
            ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.lit("0")),
        ),
    ).otherwise(
        _header(
            ("WARC-Type", F.lit("response")), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(WARC_DATE)),
            ("WARC-Target-URI", _uri(F.col("url"))), ("WARC-Payload-Digest", block),
            ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes").cast("string")),
        )
    )
    heads.select("digest", head.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str, pattern: str = "[^\r\n]*") -> Column:
    return F.regexp_extract("header", f"\r\n{name}: ({pattern})\r\n", 1)


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """The payloads, each read whole and compared with the digest it is stored under."""
    return spark.read.parquet(f"{path}/payloads").select(
        "digest", "records",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.lit("a stored payload doesn't match its digest")).cast("binary")).alias("payload"),
    )


def _joined(spark: SparkSession, path: str, facts: DataFrame) -> DataFrame:
    """The headers with what is known of their payloads; a hot payload goes to several tasks."""
    heads = spark.read.parquet(f"{path}/headers")
    return join_salted(heads, facts, ["digest"], "records", heads.count(), ["header"])


def _page(name: str) -> Column:
    return F.regexp_extract("header", f"\r\n{name}: <urn:leafmill:page:(-?[0-9]+)>\r\n", 1).try_cast("long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the stored header and the stored payload's bytes; the payload itself isn't moved."""
    facts = _checked(spark, path).select(
        "digest", "records", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest")
    )
    return _joined(spark, path, facts).select(
        _page("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest", _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, header, payload and the record's exact bytes; a revisit's record has no block of its own."""
    rec = _joined(spark, path, _checked(spark, path))
    own = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rec.select(
        _page("WARC-Record-ID").alias("page_id"), _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"),
        "header", "payload", F.concat(F.encode("header", "UTF-8"), F.lit(b"\r\n"), own, F.lit(b"\r\n\r\n")).alias("record"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_root(spark)}/leafmill-warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    # the digest columns are taken from the payloads as they come out of the rebuilt records
    return read_archive(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to"
    )
