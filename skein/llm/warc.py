"""Content-addressed WARC archive.

``write`` turns records (id, uri, payload) into an archive of two tables:

* ``payloads``: each distinct payload once, addressed by its SHA-256, with its
  length, SHA-1 and the id of the record that is its *response*;
* ``headers``: the exact header block of every record (WARC/1.1 header lines
  and the HTTP status lines before the payload), its id, its uri and the address.

``read`` rebuilds the records by joining headers to payloads; the digest and
length of every payload are computed again from the stored bytes and compared
with what the header states.  ``record_bytes`` gives the original record.

Of records with equal payloads of at least ``least`` bytes the one with the
largest id is the response and the others are revisits of it; smaller payloads
are always responses.  Equal SHA-256 with another length or SHA-1 would be a
collision and fails the write.

Defined results: a null payload is empty; records with a null id revisit the
response of their payload (without any id in the group, all are responses);
repeated rows give repeated records, all of them responses if the id is the
largest; an empty table gives an empty archive; extra input columns are not
read, so their names cannot clash.  All records of one ``write`` have its date.
Control characters and blanks of a uri, and what could end a line or the brackets of
an id, are percent-encoded in the header lines, so no value can add or end a header;
``read`` gives uris and ids as they were.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

#: fixed RFC 4648 alphabet
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1."""
    return base32_digits(F.sha1(payload))


def base32_digits(sha1: Column) -> Column:
    """Base32 of a SHA-1 in hex: five hex digits make four symbols."""
    def symbols(at: int) -> Column:
        bits = F.conv(F.substring(sha1, at, 5), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1,
                                      F.lit(1)) for s in (15, 10, 5, 0)])
    return F.concat(*[symbols(at) for at in range(1, 41, 5)])


#: characters that a header value cannot hold, beside %
_UNSAFE = [chr(c) for c in range(33)] + ["<", ">", chr(127)]


def _escaped(value: Column, percent: bool) -> Column:
    """``value`` with unsafe characters percent-encoded (``percent``: % as well, so
    that the original can be told)."""
    out = value
    for c in ["%"] * percent + _UNSAFE:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(value.rlike(r"[\x00-\x20<>%\x7f]"), out).otherwise(value)


def _plain(value: Column) -> Column:
    out = value
    for c in [*_UNSAFE, "%"]:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(value.contains("%"), out).otherwise(value)


def _record_id(value: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(_escaped(value.cast("string"), True), F.lit("none")), F.lit(">"))


def header_text() -> Column:
    """The header block of a record from ``id, uri, date, n, sha1, refers_to, kind``."""
    http = F.when(F.col("kind") == "response",
                  F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
                  ).otherwise(F.lit("HTTP/1.1 200 OK\r\n\r\n"))
    size = F.length(http) + F.when(F.col("kind") == "response", F.col("n")).otherwise(0)
    lines = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), _escaped(F.col("uri"), False)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(F.col("kind") == "revisit", F.concat_ws(
            CRLF, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"))),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), size.cast("string")))
    return F.concat(lines, F.lit(CRLF + CRLF), http)


def write(records: DataFrame, path: str, id_col: str = "page_id", uri: str = "url",
          payload: str = "html", least: int = 0, date: datetime | None = None) -> None:
    """Write the archive of ``records``, captured at ``date`` (now), under ``path``."""
    spark = records.sparkSession
    stamp = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = (records.select(F.col(id_col).alias("id"), F.col(uri).cast("string").alias("uri"),
                           body.alias("body"))
            .withColumn("address", F.unhex(F.sha2("body", 256)))
            .withColumn("n", F.octet_length("body").cast("long")))
    # copies meet map-side before the shuffle; one payload per address is moved on
    (rows.withColumn("sha1", F.sha1("body"))
     .groupBy("address")
     .agg(F.max("id").alias("response_id"), F.first("body").alias("payload"),
          F.max("n").alias("n"), F.max("sha1").alias("hex"),
          (F.min("n") == F.max("n")).alias("same_n"), (F.min("sha1") == F.max("sha1")).alias("same_h"))
     .select("address", "response_id", "payload", "n",
             F.when(F.col("same_n") & F.col("same_h"), F.col("hex"))
             .otherwise(F.raise_error(F.lit("two payloads share one SHA-256"))).alias("hex"))
     .withColumn("sha1", base32_digits(F.col("hex")))
     .write.parquet(f"{path}/payloads"))
    # digests are made once for a payload; its records take them from there
    stored = spark.read.parquet(f"{path}/payloads").select("address", "response_id", "sha1")
    linked = (rows.select("id", "uri", "address", "n", F.lit(stamp).alias("date"))
              .join(stored, "address")
              .withColumn("kind", F.when((F.col("n") < least) | F.col("response_id").isNull()
                                         | F.col("id").eqNullSafe(F.col("response_id")), "response")
                          .otherwise("revisit"))
              .withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("response_id"))))
    (linked.select("id", "uri", "address", header_text().alias("header"))
     .write.parquet(f"{path}/headers"))


def _field(name: str) -> Column:
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(value == "", None).otherwise(value)


def read(spark, path: str) -> DataFrame:
    """The records of an archive: ``id, uri, payload, payload_bytes,
    payload_digest, record_type, refers_to, date, header``.

    Facts about a payload are computed once per stored payload, from its bytes;
    a stated digest that does not fit them is an error.  Columns that are not
    asked for are pruned, the bytes included.
    """
    facts = (spark.read.parquet(f"{path}/payloads")
             .select("address", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
                     base32_sha1(F.col("payload")).alias("found"),
                     (F.unhex(F.sha2("payload", 256)) == F.col("address")).alias("intact")))
    heads = (spark.read.parquet(f"{path}/headers")
             .select("address", "header", "id", "uri", _field("WARC-Type").alias("record_type"),
                     _field("WARC-Date").alias("date"),
                     F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated"),
                     _plain(F.regexp_extract(_field("WARC-Refers-To"), "^<urn:record:(.*)>$", 1))
                     .alias("referred")))
    digest = F.when(F.col("intact") & (F.col("stated") == F.col("found")), F.col("found")).otherwise(
        F.raise_error(F.lit("a stored payload does not fit its digest")))
    return (heads.join(facts, "address")
            .select("id", "uri", "payload", "payload_bytes", digest.alias("payload_digest"),
                    "record_type",
                    F.when(F.col("record_type") == "revisit", F.col("referred")).alias("refers_to"),
                    "date", "header"))


def record_bytes() -> Column:
    """The exact bytes of a record from ``read``'s columns."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return F.concat(F.col("header").cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))


def export(spark, path: str, out: str) -> None:
    """Write the archive's records as WARC files (one per task) under ``out``.

    Each row is one record without its closing blank lines, which the text
    writer adds as its line separator, so the bytes are those of the records.
    """
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    (read(spark, path).where(F.col("payload_digest").isNotNull())
     .select(F.concat(F.col("header").cast("binary"), body).cast("string").alias("value"))
     .write.option("lineSep", CRLF + CRLF).text(out))
