"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base 32 alphabet, the line end and the profile of a revisit record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(hex_digest: Column) -> Column:
    """Upper-case base 32 of a hexadecimal SHA-1: each 5 hex digits are 4 characters."""
    def four(i):
        n = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(BASE32), F.shiftright(n, by).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*[c for i in range(8) for c in four(i)])


def _digested(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).alias("page_id"), F.replace(F.replace(F.coalesce(F.col(url_col), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload")).withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})


def record_uri(page_id: Column) -> Column:
    """The id in percent-encoding, so that it can be read back from the header; a null id has a name of its own."""
    return F.coalesce(F.concat(F.lit("<urn:x-page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit("<urn:x-no-page:>"))


def _named_page(field: str, kind: T.DataType) -> Column:
    line = rf"\r\n{field}: <urn:x-page:([^\r\n]*)>\r\n"
    return F.when(F.regexp_like("header", F.lit(line)), F.url_decode(F.regexp_extract("header", line, 1))).cast(kind)


def write_archive(pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html", least_bytes=0, date="1970-01-01T00:00:00Z") -> None:
    """Writes path/payloads (each different payload once) and path/headers (a row for each record: its exact header block).

    Of the records with equal payloads of at least least_bytes bytes, the one with the smallest id is a response and the others
    are revisits that refer to it. Equal means: same length, SHA-1 and SHA-256. Copies are reduced to one before the shuffle, so a
    payload that a third of all pages share costs one row for each task. Headers carry digests, not payloads.

    A null payload is empty; a null url is an empty target; line ends in a url are percent-encoded. A null id is larger than any other and, if all copies have null ids,
    each of them is a response; rows that repeat the smallest id with the same payload are all responses. No rows make an empty
    archive. Other columns are ignored. The header is all that is known of a record: it is read back from there.
    """
    rows = _digested(pages, id_col, url_col, payload_col)
    store = rows.groupBy("sha256", "sha1", "payload_bytes").agg(F.min("page_id").alias("owner"), F.first("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    owners = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "sha1", "payload_bytes", "owner")
    rows = rows.drop("payload").join(owners, ["sha256", "sha1", "payload_bytes"])
    response = F.col("owner").isNull() | F.coalesce(F.col("page_id") == F.col("owner"), F.lit(False)) | (F.col("payload_bytes") < least_bytes)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")), F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_sha1(F.col("sha1"))),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), record_uri(F.col("owner")))), F.when(~response, F.lit(f"WARC-Profile: {REVISIT}")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), (F.length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)).cast("string")),
    ]
    header = F.concat(F.concat_ws(EOL, *lines), F.lit(EOL * 2), http)
    rows.select("sha256", "payload_bytes", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def export_warc(records: DataFrame, path: str) -> None:
    """Writes records, as read_archive() gives them with payload, as WARC files: text parts whose line end is the two line ends after each record. Bytes are written as they are."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    records.select(F.concat(F.col("header").cast("binary"), body).cast("string").alias("value")).write.option("lineSep", EOL * 2).text(path)


def read_archive(spark: SparkSession, path: str, with_payload=True) -> DataFrame:
    """The records, rebuilt: what each header says, joined with its payload, whose digests are computed again and compared.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest, header and, if asked for, payload (of a revisit
    too) and record (header, then for a response the payload, then two line ends). A payload that differs from its digest stops
    the job.
    """
    store = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1")) & (F.length("payload") == F.col("payload_bytes"))
    store = store.select("sha256", F.when(sound, F.length("payload").cast("long")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("long")).alias("_stored"), base32_of_sha1(F.sha1("payload")).alias("payload_digest"), *(["payload"] if with_payload else []))
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    heads = spark.read.parquet(f"{path}/headers")
    kind = spark.read.parquet(f"{path}/payloads").schema["owner"].dataType
    records = heads.join(store, "sha256").select(
        _named_page("WARC-Record-ID", kind).alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), _named_page("WARC-Refers-To", kind).alias("refers_to"),
        F.col("_stored").alias("payload_bytes"), "payload_digest", F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("header")).otherwise(F.raise_error(F.lit("a header differs from its payload"))).alias("header"), *(["payload"] if with_payload else []),
    )
    if not with_payload:
        return records
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files: (file, offset, header, content), header up to and with its empty line, content the Content-Length bytes after it.

    A file is one task's, so files should be of the usual size, about a gigabyte at most. A record whose length does not lead to two line ends stops the job.
    """
    end = EOL.encode() * 2

    def records(frames):
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"]):
                at, out = 0, []
                while at < len(data):
                    stop = data.index(end, at) + len(end)
                    head = data[at:stop]
                    size = next(int(x[15:]) for x in head.split(EOL.encode()) if x[:15].lower() == b"content-length:")
                    if data[stop + size:stop + size + len(end)] != end:
                        raise ValueError(f"{name}: the record at {at} does not end where its length says")
                    out.append((name, at, head.decode(), data[stop:stop + size]))
                    at = stop + size + len(end)
                    if len(out) == 100:
                        yield pd.DataFrame(out, columns=["file", "offset", "header", "content"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "offset", "header", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
    return files.mapInPandas(records, "file string, offset long, header string, content binary")
