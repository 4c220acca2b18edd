"""A content-addressed WARC archive: payloads once by digest, headers apart, records by join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MIN_REVISIT_BYTES = 100
CAPTURED_AT = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Two tables under ``path``: payloads by digest, and the exact header of every record."""

    path: str
    id_type: T.DataType

    def payloads(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType().add("digest", T.BinaryType()).add("payload", T.BinaryType()).add("first", self.id_type)
        return spark.read.schema(schema).parquet(f"{self.path}/payloads")

    def headers(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType().add("page_id", self.id_type).add("digest", T.BinaryType()).add("header", T.BinaryType())
        return spark.read.schema(schema).parquet(f"{self.path}/headers")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END))


def _uri(url: Column) -> Column:
    # White space and control characters would end the header line.
    bare = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.regexp_replace(bare, r"[\x00-\x20\x7F]", "%20")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    captured_at: str = CAPTURED_AT,
) -> Archive:
    """Writes one record per row; the payload is the html in UTF-8, NULL as empty.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the
    smallest id is the response and the others revisit it; smaller ones are all responses.
    Copies are combined in the reading task, by digest and whole payload; reading fails if
    different payloads ever had one digest.  Rows that repeat an id are records of the same
    type; NULL ids come after all others.  A NULL url leaves out its header line.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    digest = F.unhex(F.sha2(payload, 256))
    rows = pages.select(F.col(page_id).alias("page_id"), payload.alias("payload"))
    archive = Archive(path, pages.schema[page_id].dataType)
    (
        rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
        .groupBy("digest", "payload")
        .agg(F.min("page_id").alias("first"))
        .select("digest", "payload", "first")
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )

    firsts = archive.payloads(pages.sparkSession).select("digest", "first")
    records = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        digest.alias("digest"), F.octet_length(payload).alias("bytes"),
    ).join(firsts, "digest")
    revisits = (F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit("WARC/1.1" + END),
        _line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", captured_at),
        F.coalesce(_line("WARC-Target-URI", _uri(F.col("url"))), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        F.when(
            revisits,
            F.concat(_line("WARC-Profile", REVISIT_PROFILE), _line("WARC-Refers-To", _record_id(F.col("first")))),
        ).otherwise(""),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.when(revisits, 0).otherwise(F.col("bytes")).cast("string")),
        F.lit(END),
    )
    records.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/headers")
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``page_id, header, payload, record``: headers joined with their payloads.

    ``record`` is the WARC record, byte for byte; a revisit has an empty block there, while
    ``payload`` is the full payload it stands for.  Every stored payload is hashed again and
    must have the digest it is stored under, once.
    """
    payloads = archive.payloads(spark)
    verified = payloads.select(
        "digest",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("a payload does not have the digest it is stored under")).cast("binary"))
        .alias("payload"),
    )
    repeated = payloads.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if repeated.take(1):
        raise ValueError("different payloads have one digest")
    joined = archive.headers(spark).join(verified, "digest")
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        "page_id", "header", "payload", F.concat("header", block, F.lit((END * 2).encode())).alias("record")
    )


def field(header: Column, name: str) -> Column:
    """The value of a header line, NULL if there is none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def record_facts(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, from the records.

    Fails on a record whose block is not as long as its header says.
    """
    header = F.col("header")
    block = F.octet_length("record") - F.octet_length(header) - len(END * 2)
    kind = field(header, "WARC-Type")
    refers_to = F.regexp_extract(field(header, "WARC-Refers-To"), "<urn:page:(.*)>", 1)
    id_type = records.schema["page_id"].dataType
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.substring_index(field(header, "WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.when(block == field(header, "Content-Length").cast("int"), kind)
        .otherwise(F.raise_error(F.lit("a record is not as long as its header says")).cast("string"))
        .alias("record_type"),
        F.when(refers_to != "null", refers_to).cast(id_type).alias("refers_to"),
    )
