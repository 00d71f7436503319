"""WARC archives: pages written as (segmented) records, and archives read back with their segments put together.

Blocks longer than a segment become a first record and continuation records. Reading groups continuations by the
identifier of their origin, orders them by segment number, verifies numbers and total length, and decodes the chunked
transfer framing of the HTTP message inside.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedfold.llm.common import slices, spread_join
from feedfold.session import fresh_path, written

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
# Smaller payloads are stored again rather than referred to.
REVISIT_BYTES = 1000
# Bounds a file to RECORDS_PER_FILE * SEGMENT_BYTES and the headers.
RECORDS_PER_FILE = 1024
SLICE_ROWS = 1 << 14
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = ("page_id long, record_type string, record_id string, refers_to_record string, url string, declared_digest string, "
          "origin string, segment int, total_length long, block binary")


def _uuid(text: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def _cut(data: Column, size: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _chunked(payload: Column) -> Column:
    """The payload in chunked transfer framing."""
    framed = F.transform(_cut(payload, CHUNK_BYTES), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c))), F.lit("\r\n"), c.cast("string"), F.lit("\r\n")))
    return F.concat(F.when(F.octet_length(payload) > 0, F.array_join(framed, "")).otherwise(F.lit("")), F.lit("0\r\n\r\n"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``, from 1 among the rows that repeat id and payload, however many do.

    Rows get a place (partition and position) and are stored. Each slice of SLICE_ROWS places of a partition is numbered by itself
    and starts after the slices before it, so a name with a third of all rows has a window row per slice and not one per row.
    """
    place = F.monotonically_increasing_id()
    placed = written(rows.withColumn("place", place), "payload-places").withColumn("slice", F.floor(F.col("place") / SLICE_ROWS))
    counts = placed.groupBy("page_id", "sha", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("page_id", "sha").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("page_id", "sha", "slice").orderBy("place")
    names = placed.select("page_id", "sha", "slice", "place").withColumn("nth", F.row_number().over(within))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "sha", "slice")]
    names = names.alias("a").join(starts.alias("b"), same).select("place", (F.col("nth") + F.col("start")).alias("copy"))
    return placed.drop("slice").join(names, "place").drop("place")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES) -> str:
    """Write a record per row into uncompressed WARC files and return their folder.

    Of rows with equal payloads of at least REVISIT_BYTES, the one with the largest id (null is smallest; any one of rows that repeat id and
    payload) is a response and the others are revisits that refer to it; smaller payloads are all responses. A null payload is empty, a null
    url or id leaves its field out, and line breaks in urls are escaped. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    once = rows.groupBy("page_id", "sha", F.octet_length("payload").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    once = written(once, "payload-names")
    repeated = not once.filter("n > 1").isEmpty()
    rows = written(_numbered(rows), "payloads") if repeated else rows.withColumn("copy", F.lit(1).cast("long"))
    groups = (once.filter(F.col("size") >= REVISIT_BYTES).groupBy("sha")
              .agg(F.max(F.struct("page_id", F.lit(1).cast("long").alias("copy"))).alias("keep"), F.sum("n").alias("n")).filter("n > 1"))
    rows = spread_join(rows, written(groups, "payload-groups"), ["sha"], "n", "left")
    own = F.struct("page_id", "copy")
    is_revisit = F.col("keep").isNotNull() & ~own.eqNullSafe(F.col("keep"))

    def name(row: Column) -> Column:
        return _uuid(F.concat_ws("|", F.col("sha"), row["copy"].cast("string"), row["page_id"].cast("string")))

    block = F.concat(F.lit(HTTP_HEAD), F.when(is_revisit, F.lit("")).otherwise(_chunked(F.col("payload")))).cast("binary")
    rows = rows.select("page_id", is_revisit.alias("is_revisit"), name(own).alias("id"),
                       F.when(is_revisit, name(F.col("keep"))).alias("refers"), F.sha1("payload").alias("digest"),
                       F.regexp_replace("url", r"[\x00-\x20]", "%20").alias("url"), block.alias("block"))
    parts = rows.select("page_id", "is_revisit", "id", "refers", "digest", "url", F.octet_length("block").alias("total"),
                        F.posexplode(_cut(F.col("block"), segment_bytes)).alias("i", "part"))
    split, further = F.col("total") > segment_bytes, F.col("i") > 0
    last = (F.col("i") + 1) * segment_bytes >= F.col("total")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(further, "continuation").when(F.col("is_revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _field("WARC-Record-ID", F.when(further, _uuid(F.concat_ws("|", "id", F.col("i").cast("string")))).otherwise(F.col("id"))),
        _field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _field("WARC-Target-URI", F.col("url")),
        _field("X-Page-ID", F.when(~further, F.col("page_id"))),
        _field("WARC-Payload-Digest", F.when(~further, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("WARC-Refers-To", F.when(~further, F.col("refers"))),
        _field("WARC-Profile", F.when(~further & F.col("is_revisit"), F.lit(REVISIT_PROFILE))),
        _field("WARC-Segment-Number", F.when(split, F.col("i") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(further, F.col("id"))),
        _field("WARC-Segment-Total-Length", F.when(split & last, F.col("total"))),
        _field("Content-Type", F.when(~further, F.lit("application/http;msgtype=response"))),
        _field("Content-Length", F.octet_length("part")), F.lit("\r\n"))
    path = fresh_path(pages.sparkSession, "warc")
    # a record ends with two line breaks, which is the line separator here: the text writer writes plain WARC
    (parts.select(F.concat(head, F.col("part").cast("string")).alias("value")).write
     .option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files, a file at a time."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            data, at, rows, held = memoryview(content.as_buffer()), 0, [], 0
            raw = content.as_buffer().to_pybytes()
            while at < len(raw):
                end = raw.find(b"\r\n\r\n", at)
                whole = end >= 0
                lines = raw[at:end if whole else len(raw)].decode(errors="replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    if not whole and b"WARC/".startswith(raw[at:at + 5]):
                        break  # a tail of less than a version tells nothing
                    raise ValueError(f"no WARC record at byte {at}")
                if not whole:
                    lines.pop()  # may be cut as well
                field = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                size, start = int(field.get("content-length", 0)), end + 4 if whole else len(raw)
                torn = not whole or start + size > len(raw)
                number = int(field.get("warc-segment-number", 0))
                digest = field.get("warc-payload-digest", "").removeprefix("sha1:").lower()
                name = field.get("warc-record-id")
                if name is not None:
                    rows.append((int(field["x-page-id"]) if "x-page-id" in field else None, field.get("warc-type"),
                                 name, field.get("warc-refers-to"), field.get("warc-target-uri"), digest or None,
                                 field.get("warc-segment-origin-id", name), number,
                                 int(field["warc-segment-total-length"]) if "warc-segment-total-length" in field else None,
                                 None if torn else bytes(data[start:start + size])))
                at, held = start + size + 4, held + size
                if rows and (held > 4 << 20 or at >= len(raw)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def unchunk(message: bytes) -> bytes | None:
    """The payload of an HTTP message, with chunked framing undone; None if it is cut short or a chunk has no size."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        digits = body[at:line].split(b";")[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        if len(body) < line + 2 + size + 2:
            return None
        out.append(body[line + 2:line + 2 + size])
        at = line + 2 + size + 2


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "block"):
        kind, block = batch.column("record_type").to_pylist(), batch.column("block").to_pylist()
        out = [unchunk(b) if k == "response" and b is not None else None for k, b in zip(kind, block, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the archives in ``path``.

    Columns: page_id, record_type, record_id, refers_to_record, url, declared_digest, n_segments, complete (all segments are
    there once and add up to the total length) and payload (null for revisits and records that are not complete). A record's segments may lie in
    any files. Where a file is cut, its last record is not complete; it is left out if its identifier is cut off too. Continuations without an origin make a row of type continuation.
    """
    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD)
    first = [F.max_by(c, F.col("segment") == 1).alias(c) for c in
             ("page_id", "record_type", "record_id", "refers_to_record", "url", "declared_digest")]
    joined = (records.filter("segment > 0").groupBy("origin")
              .agg(*first, F.count(F.lit(1)).alias("n_segments"), F.max("total_length").alias("total"),
                   F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts")))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    there = ~F.exists("parts", lambda p: p["block"].isNull())  # a torn segment has no block
    complete = in_order & there & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    joined = joined.withColumn("block", block).withColumn("complete", complete)
    columns = ["page_id", "record_type", "record_id", "refers_to_record", "url", "declared_digest", "n_segments", "complete"]
    whole = (records.filter("segment = 0").withColumn("n_segments", F.lit(1).cast("long")).withColumn("complete", F.col("block").isNotNull())
             .select(*columns, "block"))
    both = whole.unionByName(joined.select(*columns, F.when(F.col("complete"), F.col("block")).alias("block")))
    return both.mapInArrow(_payloads, "page_id long, record_type string, record_id string, refers_to_record string, url string, "
                                      "declared_digest string, n_segments long, complete boolean, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and intact per record; revisits take them from their response.

    ``intact`` tells that the record is complete and its payload has the declared digest; of a revisit, that its
    response is there with that digest.
    """
    facts = written(records.select("page_id", "record_type", "record_id", "refers_to_record", "declared_digest", "complete",
                                   F.octet_length("payload").cast("long").alias("payload_bytes"),
                                   F.sha1("payload").alias("payload_digest")), "records")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    same = F.coalesce(F.col("declared_digest") == F.col("payload_digest"), F.lit(False))
    plain = (facts.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
             .withColumn("intact", F.col("complete") & same).select(*out))
    revisits = facts.filter("record_type = 'revisit'").select("page_id", "record_type", "declared_digest", "refers_to_record")
    asked = revisits.groupBy("refers_to_record").agg(F.count(F.lit(1)).alias("n"))
    targets = facts.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    targets = written(asked.join(targets, "refers_to_record", "left"), "revisited")
    return plain.unionByName(spread_join(revisits, targets, ["refers_to_record"], "n").withColumn("intact", same).select(*out))
