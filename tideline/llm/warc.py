"""Content-addressed WARC archive.

Payload bytes are stored once, keyed by their SHA-256; the exact header block of every record is stored apart;
records are put together again by a join on the digest, which recomputes and checks it.

Cases: a null payload is an empty one; a null url has no ``WARC-Target-URI`` line, line breaks in one are
percent-encoded; a null id gives an empty id in the record's URN and is read back as null; rows that repeat the
largest id of a group are all responses, being the same record; payloads of any length are stored whole, each in one
row (a row holds at most 2 GB); an empty table gives empty archives.
Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import new_path

URN = "urn:tideline:page:"


def _line(name: str, value: Column) -> Column:
    """``name: value`` and CRLF; null where the value is null, so that concat_ws leaves it out."""
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
) -> str:
    """Write ``path/headers`` and ``path/payloads``; returns ``path``.

    Of the records with equal payloads of at least ``revisit_from`` bytes the one with the largest id is the
    response and the others revisit it; shorter ones are all responses. Each distinct payload is stored once.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    records = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("sha256", F.sha2("payload", 256))
    slim = records.select(
        "id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")
    )
    owners = slim.groupBy("sha256").agg(F.max("id").alias("owner"))
    named = slim.join(owners, "sha256")
    response = (F.col("n") < revisit_from) | F.col("id").eqNullSafe(F.col("owner"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block_length = F.when(response, F.col("n")).otherwise(0).cast("string")
    header = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Target-URI", uri),
        _line("WARC-Date", F.lit(date)),
        F.when(~response, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(~response, _line("WARC-Refers-To", _urn(F.col("owner")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", block_length),
        F.lit("\r\n"),
    )
    named.select("sha256", header.alias("header")).write.parquet(f"{path}/headers")
    records.select("sha256", "payload").dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")
    return path


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``header``, ``payload`` (of a revisit: that of the record it refers to) and fields of the header.

    Fails if stored bytes don't have the digest they are filed under.
    """
    headers = spark.read.schema("sha256 string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    verified = payloads.select(
        "sha256",
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("stored payload does not match its digest")).cast("binary"))
        .alias("payload"),
    )

    def field(name: str) -> Column:
        found = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(found != "", found)

    def page(name: str) -> Column:
        return F.regexp_extract(field(name), f"{URN}(-?[0-9]+)>", 1).try_cast("long")

    return headers.join(verified, "sha256").select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        "header",
        "payload",
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """The records of ``read_archive`` as the bytes a WARC file holds: header, block and two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    end = F.lit("\r\n\r\n").cast("binary")
    return records.select("page_id", F.concat(F.col("header").cast("binary"), block, end).alias("record"))


def archive_report(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder, read it back and describe each record."""
    spark = pages.sparkSession
    path = write_archive(pages, new_path(spark, "warc", keep=True))
    return read_archive(spark, path).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
