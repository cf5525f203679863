"""Content-addressed WARC archive.

``write_archive`` stores each distinct payload once, under its SHA-256, and each
record's header block, byte for byte, in a table of its own; records whose
payload an earlier page holds become revisit records that refer to it.
``read_archive`` joins the two and gives back the original records;
``verify`` digests the stored payloads anew. ``to_warc`` and ``parse_warc``
turn records to and from the bytes of a WARC file.

The payload table is bucketed by digest, so reading back shuffles headers only. A
digest of more than ``SPREAD`` records (an empty body, an error page), or of more than
a ten-thousandth of all, has its records dealt to parts of about that many; its payload
is read once for each part. Such digests are ten thousand at most, so their list is
broadcast. Which record is a response is decided by numbers, without payloads.

Record ids hold the page's id and the record's own number, so that they are unique
where page ids repeat or are null. The block of a response is the payload alone: pages
hold no HTTP header lines.

Defined cases: null payloads are empty; a null url is an empty target URI; pages
with equal ids and payloads are all written, each as a record: the first by id, then
by url, is the response and the rest revisit it; rows with a null page_id come last (where
all are null, one of them is the response, and what revisits it refers to null); an
empty table gives no rows; further columns are ignored. No payload is too small
to be stored once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import fresh_folder, materialize, small_batches

CRLF = "\r\n"
#: Record dates are a parameter, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
#: Records of one digest that one task reads, about.
SPREAD = 2_000
#: Digests with more records than SPREAD that are broadcast, at most.
HOT = 10_000
#: Payload bytes that a bucket should hold at most, and Spark's own limit on buckets.
BUCKET_BYTES = 512 << 20
MOST_BUCKETS = 100_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of a hex digest whose length is a multiple of 10 (SHA-1 has 40): 10 hex digits are 8 letters."""
    letters = []
    for group in range(4):
        value = F.conv(F.substring(hexed, 10 * group + 1, 10), 16, 10).cast("long")
        for k in range(8):
            letters.append(F.substr(F.lit(_ALPHABET), F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), number.cast("string"), F.lit(">"))


def _header(kind: Column, uri: Column, record: Column, digest: Column, length: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", refers), line("WARC-Profile", F.lit(profile)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(length.cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, folder: str, least: int = 0, spread: int = SPREAD) -> str:
    """Archive pages (page_id, url, html) under folder/payloads and folder/headers; the name of the payloads' table is given back.

    Payloads of fewer than ``least`` bytes are not looked up: their records are
    all responses (and still share the stored bytes).
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    records = keyed.select("page_id", "url", "digest", F.sha1("payload").alias("_sha1"), F.octet_length("payload").cast("long").alias("n"))
    records = records.withColumn("sha1", base32_of_hex(F.col("_sha1"))).drop("_sha1").withColumn("number", F.monotonically_increasing_id())
    records = materialize(records, "records")
    order = F.struct(F.col("page_id").isNull().alias("null"), "page_id", "url", "number")
    first = records.groupBy(F.col("digest").alias("_d")).agg(F.count("*").alias("_count"), F.min(order).alias("_first"), F.max("n").alias("_bytes"))
    first = materialize(first, "first")
    total, stored_bytes = (x or 0 for x in first.agg(F.sum("_count"), F.sum("_bytes")).first())
    most = max(spread, total // HOT)
    # fewer than HOT rows, as each counts more than a ten-thousandth of all records
    hot = first.where(F.col("_count") > most).select(F.col("_d").alias("_hot"), F.ceil(F.col("_count") / most).cast("int").alias("copies"))

    def parted(rows: DataFrame, digest: str) -> DataFrame:
        return rows.join(F.broadcast(hot), F.col(digest) == F.col("_hot"), "left").drop("_hot").withColumn("copies", F.coalesce("copies", F.lit(1)))

    # one row a task and digest reaches the shuffle
    stored = parted(keyed.groupBy("digest").agg(F.first("payload").alias("payload")), "digest")
    # buckets follow the bytes stored, once these are more than the session's partitions should hold
    parts = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes // BUCKET_BYTES)))
    table = f"tidewell_payloads_{uuid.uuid4().hex}"
    stored.repartition(parts, "digest").write.bucketBy(parts, "digest").format("parquet").option("path", f"{folder}/payloads").saveAsTable(table)

    own = parted(records, "digest").withColumn("part", F.pmod("number", "copies").cast("int"))
    firsts = parted(first, "_d").select("_d", "_first", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_part"))
    out = own.join(firsts, (F.col("digest") == F.col("_d")) & (F.col("part") == F.col("_part")))
    is_response = (F.col("n") < least) | (F.col("number") == F.col("_first.number"))
    kind = F.when(is_response, F.lit("response")).otherwise(F.lit("revisit"))
    record, refers = _record_id(F.col("page_id"), F.col("number")), _record_id(F.col("_first.page_id"), F.col("_first.number"))
    header = _header(kind, F.col("url"), record, F.col("sha1"), F.col("n"), refers)
    # the part matters for digests of several only
    part = F.when(F.col("copies") > 1, F.col("part"))
    out.select("page_id", "digest", part.alias("part"), header.alias("header")).write.parquet(f"{folder}/headers")
    return table


def read_archive(spark: SparkSession, folder: str, table: str | None = None) -> DataFrame:
    """The original records: page_id, header, digest, payload (of the response, for a revisit too).

    With the payloads' table, Spark knows their buckets and moves headers only; without, it reads the same files.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.table(table) if table else spark.read.parquet(f"{folder}/payloads")
    stored = payloads.where("copies = 1").select(F.col("digest").alias("_d"), "payload")
    names = ["page_id", "header", "digest", "payload"]
    plain = headers.where("part IS NULL").join(stored, F.col("digest") == F.col("_d")).select(names)
    spread = payloads.where("copies > 1").select(F.col("digest").alias("_d"), "payload", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_part"))
    split = headers.where("part IS NOT NULL").join(spread, (F.col("digest") == F.col("_d")) & (F.col("part") == F.col("_part"))).select(names)
    return plain.unionByName(split)


def field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: (.*?)\r$", 1), F.lit(""))


def to_warc(records: DataFrame) -> DataFrame:
    """page_id and the record's bytes, as they stand in a WARC file; a revisit has no block."""
    block = F.when(F.col("header").contains("WARC-Type: revisit\r\n"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in the bytes of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        begin = end + 4
        at = begin + int(fields["Content-Length"]) + 4
        yield fields, data[begin : at - 4]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page, header, digest, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"page {page}: stored payload doesn't match its digest {digest}")
            revisit = "\r\nWARC-Type: revisit\r\n" in header
            ((fields, block),) = parse_warc(header.encode() + (b"" if revisit else payload) + b"\r\n\r\n")
            sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if fields["WARC-Payload-Digest"] != f"sha1:{sha1}" or not revisit and block != payload:
                raise ValueError(f"page {page}: record doesn't match its payload")
            refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").split(":")[0]
            rows.append((page, len(payload), sha1, fields["WARC-Type"], int(refers) if refers else None))
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archive of pages, read it back, check every record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "archive")
    table = write_archive(pages, folder)
    records = read_archive(spark, folder, table).select(F.col("page_id").cast("long").alias("page_id"), "header", "digest", "payload")
    out = records.mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    out = materialize(out, "report")
    spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay
    return out
