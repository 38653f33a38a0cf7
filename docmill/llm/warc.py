"""A content-addressed web archive.

Every different payload is stored once, as a WARC ``resource`` record named by its SHA-256, in compressed
WARC files that Spark's text writer puts in place. The exact header of every original record lies in a table beside
them, with the payload's digest. A reader parses the payload files in parallel, recomputes each digest and
fails if it differs from the name, and joins headers to payloads to rebuild the original records byte for
byte. Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest page id is
a ``response``; the others are ``revisit`` records, whose block is empty and which name it.

Defined results: a null payload is empty; null page ids come after all others and, with equal payloads,
null ids alone are responses; repeated rows with one page id and payload are the same kind of record; line
ends in a URL are percent-encoded; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.shared import bounded_batches, fresh_folder

MIN_REVISIT = 100
#: Records of a payload file of payloads up to ``SMALL`` bytes. A file is read as a whole, so files of
#: payloads of every further doubling of that size have half as many: no file but one of a single record
#: has more than their product, 32 MB. All classes are written in one pass.
FILE_RECORDS, SMALL = 2048, 16 << 10
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload binary) with digest, n, holder (smallest page id of its payload), kind."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    light = rows.drop("payload")
    holders = light.where(F.col("n") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("holder"))
    light = light.join(holders, "digest", "left")
    first = (F.col("n") < MIN_REVISIT) | F.col("page_id").eqNullSafe(F.col("holder"))
    return light.withColumn("kind", F.when(first, "response").otherwise("revisit"))


def header(kind: Column, page_id: Column, url: Column, digest: Column, n: Column, holder: Column) -> Column:
    """The exact header of a record, with the empty line that ends it."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    safe = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(page_id)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), safe),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(holder))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(n).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END))


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes path/headers (a table) and path/payloads (WARC files)."""
    bounded_batches(pages.sparkSession)
    rows = classify(pages)
    rows.select("digest", "kind", header(*(F.col(c) for c in ("kind", "page_id", "url", "digest", "n", "holder"))).alias("header")).write.parquet(f"{path}/headers")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: resource{END}WARC-Record-ID: <urn:sha256:"), "digest", F.lit(f">{END}WARC-Target-URI: urn:sha256:"), "digest",
        F.lit(f"{END}WARC-Date: {DATE}{END}WARC-Block-Digest: sha256:"), "digest",
        F.lit(f"{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END + END),
    )
    # the text writer passes these bytes through as they are, valid UTF-8 or not
    record = F.concat(head.cast("binary"), F.col("payload")).cast("string")
    size = F.greatest(F.ceil(F.log2(F.greatest(F.octet_length("payload"), F.lit(1)) / SMALL)), F.lit(0)).cast("int")
    once = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    # a task's records in order of their class are cut by their place in it, so a file holds neighbours of one class
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = once.select(record.alias("value"), size.alias("size")).sortWithinPartitions("size").withColumn("at", at)
    dealt = dealt.select("value", "size", F.floor(F.col("at") / F.greatest(F.expr(f"shiftright({FILE_RECORDS}, size)"), F.lit(1))).alias("file"))
    dealt.write.partitionBy("size", "file").option("lineSep", END + END).option("compression", "gzip").text(f"{path}/payloads")


def parse_warc(raw: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(header fields in lower case, block) of each record of one WARC file."""
    at, whole = 0, bytes(raw) if not isinstance(raw, bytes) else raw
    view = memoryview(whole)
    while at < len(whole):
        end = whole.find(b"\r\n\r\n", at)
        lines = whole[at:end].decode("utf-8", "surrogateescape").split(END) if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        size = int(fields["content-length"])
        if whole[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, view[start : start + size]
        at = start + size + 4


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, payload) of every stored payload, each verified against its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple[str, bytes]] = []
                size = 0
                for fields, block in parse_warc(gzip.decompress(content.as_buffer())):
                    name = fields["warc-record-id"].removeprefix("<urn:sha256:").removesuffix(">")
                    if hashlib.sha256(block).hexdigest() != name:
                        raise ValueError(f"the payload stored as {name} has another digest")
                    held.append((name, bytes(block)))
                    size += len(block)
                    if size >= 8 << 20:
                        yield _payload_batch(held)
                        held, size = [], 0
                if held:
                    yield _payload_batch(held)

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/payloads")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # an archive of no records
        return spark.createDataFrame([], "digest string, n long, payload binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/payloads").select("content")
    return files.mapInArrow(run, "digest string, n long, payload binary")


def _payload_batch(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held]), pa.array([len(p) for _, p in held], pa.int64()), pa.array([p for _, p in held], pa.binary())], names=["digest", "n", "payload"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record binary, kind, digest, n): the original records rebuilt, ``n`` the full payload's bytes."""
    headers = spark.read.parquet(f"{path}/headers")
    stored = read_payloads(spark, path)
    end = F.lit(END + END).cast("binary")
    whole = headers.where("kind = 'response'").join(stored, "digest").withColumn("record", F.concat(F.col("header").cast("binary"), F.col("payload"), end))
    empty = headers.where("kind = 'revisit'").join(stored.select("digest", "n"), "digest").withColumn("record", F.concat(F.col("header").cast("binary"), end))
    return whole.select("record", "kind", "digest", "n").unionByName(empty.select("record", "kind", "digest", "n"))


def record_digests(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, parsed from the rebuilt records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda v: None if v in (None, "<urn:page:null>") else int(v.removeprefix("<urn:page:").removesuffix(">"))
        for batch in batches:
            out: list[tuple] = []
            for raw, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ((fields, block),) = parse_warc(raw.as_buffer().to_pybytes())
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == "response" and (len(block) != n or hashlib.sha256(block).hexdigest() != digest):
                    raise ValueError(f"record {fields['warc-record-id']} has another payload than its header says")
                out.append((page(fields["warc-record-id"]), n, digest, fields["warc-type"], page(fields.get("warc-refers-to"))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.select("record", "n").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_digests(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive, reads it back, and returns a row per record."""
    spark = pages.sparkSession
    path = path or fresh_folder(spark, "archive")
    write_archive(pages, path)
    return record_digests(read_records(spark, path))
