"""WARC archives: records of captures written, read back, and assembled.

Writing: every page gives three records that name one another by concurrent-to
identifiers: a request, a response (or a revisit of an equal payload) and a
metadata record.  Records are built by Spark expressions and written by
Spark's text writer, whose line separator is the record end, so files appear
in the shared folder by Spark's own commit (a lost task leaves nothing) and
roll over at ``RECORDS_PER_FILE`` records.  Files are gzip as a whole.

Which page is the response: the smallest page id of each payload digest, by an
aggregate over digests; only digests that occur twice are joined back.  The
digests with over 1 / ``HOT_PARTS`` of all rows (at most ``HOT_PARTS`` of
them) are broadcast, the others (if over ``SMALL_IDS``) joined by shuffle, so
a payload that a third of all pages carry makes no large task.

Reading: the text reader streams a gzip archive in pieces ending at the record
end; pieces are put together again by Content-Length, so a record end inside a
payload does no harm and no more than one record is in memory.  Any record
types, header order and line case are read; a record that its file cuts short
is marked ``truncated``.

Transaction assembly: records are written once as a table; identifiers alone
are joined to find each record's capture (a response or revisit): directly
through concurrent-to in either direction, or over one record between.  One
aggregate by capture then makes a nested row of request, response and
metadata records.  A record of no capture is a row of its own.

Defined cases: a null page is an empty payload; a null url writes no target
URI; a null ``page_id`` writes no page id and comes after all others when the
smallest is chosen; of equal rows one is the response and the others revisit
it; line breaks, tabs, spaces and ``%`` in a url are percent-encoded in the
header and decoded when read; an empty table writes an archive of no records;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_count, cut_lineage, scratch_path
from .common import SMALL_IDS

#: shortest payload that a revisit record may stand for
MIN_REVISIT = 100
RECORDS_PER_FILE = 30_000
#: keys with more than this part of all rows are joined by broadcast; there are at most as many
HOT_PARTS = 20_000
#: pages carry no time of capture
DATE = "2024-01-01T00:00:00Z"

# fixed values of the format
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit")

NL = "\r\n"


# -------------------------------------------------------------------- writing

def _urn(kind: str, archive: str, row: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(archive), F.lit(kind), row.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


#: characters that would break a header line (or the decoding)
_ESCAPED = (37, 9, 10, 13, 32)


def _uri(url: Column) -> Column:
    for c in _ESCAPED:
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return url


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record without its end; a header with a null value is left out."""
    lines = [F.concat(F.lit(f"{NL}{name}: "), value) for name, value in headers]
    return F.concat(F.lit(f"{VERSION}{NL}WARC-Type: {kind}"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit(f"{NL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END), block)


def hot_left_join(rows: DataFrame, keyed: DataFrame, key: str, row: str) -> DataFrame:
    """``rows`` left-joined with ``keyed`` (one row per ``key``, with ``n``,
    the number of ``rows`` it meets) without a large task for a frequent key.
    Up to ``SMALL_IDS`` keys are broadcast; of more, those with over 1 / ``HOT_PARTS`` of all met rows, at most ``HOT_PARTS``
    of them, are broadcast; rows that met one get a key of their own for the
    join by shuffle, so they spread evenly.  ``row`` numbers ``rows``."""
    got = [c for c in keyed.columns if c != key]
    if bounded_count(keyed, SMALL_IDS) <= SMALL_IDS:
        return rows.join(F.broadcast(keyed), key, "left").select(*rows.columns, *got)
    most = (keyed.agg(F.sum("n")).first()[0] or 0) // HOT_PARTS + 1
    hot = F.broadcast(keyed.filter(F.col("n") > most).select(F.col(key).alias("__hot"), F.struct(*got).alias("__a")))
    cold = keyed.filter(F.col("n") <= most).select(F.col(key).alias("__key"), F.struct(*got).alias("__b"))
    x = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    own = F.when(F.col("__a").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("row "), F.col(row).cast("string")))
    x = x.withColumn("__own", own).join(cold, F.col("__own") == F.col("__key"), "left")
    found = F.coalesce("__a", "__b")
    return x.select(*rows.columns, *[found[c].alias(c) for c in got])


def numbered(pages: DataFrame) -> DataFrame:
    """``row, page_id, url, payload, digest``, written once: the numbers stay
    the same however often, and by whichever plan, the rows are read."""
    x = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"),
                     F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    at = scratch_path(pages.sparkSession, "warc-pages")
    x.withColumn("digest", F.sha2(F.col("payload"), 256)).write.option("compression", "zstd").parquet(at)
    return pages.sparkSession.read.parquet(at)


def write_pages(pages: DataFrame, path: str, archive: str | None = None, date: str = DATE) -> None:
    """A request, a response or revisit, and a metadata record per page, as
    gzip archives in ``path`` (which must not exist)."""
    archive = archive or uuid.uuid4().hex
    x = numbered(pages)
    long = F.octet_length("payload") >= MIN_REVISIT
    firsts = cut_lineage(x.filter(long).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "n", F.col("first.row").alias("first_row")))
    x = hot_left_join(x, firsts, "digest", "row")
    revisits = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row")) & long
    ids = {k: _urn(k, archive, F.col("row")) for k in ("capture", "request", "metadata")}
    uri = ("WARC-Target-URI", _uri(F.col("url")))
    at = ("WARC-Date", F.lit(date))
    # the fields stay readable beside the payload, so Content-Length of the HTTP message is the payload's
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(RECORD_END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [("WARC-Record-ID", ids["capture"]), at, uri, digest, kind], F.concat(http, F.col("payload")))
    revisit = _record("revisit", [("WARC-Record-ID", ids["capture"]), at, uri, digest, ("WARC-Profile", F.lit(PROFILE)),
                                  ("WARC-Refers-To", _urn("capture", archive, F.col("first_row"))), kind], http)
    request = _record("request", [("WARC-Record-ID", ids["request"]), at, uri, ("WARC-Concurrent-To", ids["capture"]),
                                  ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce(uri[1], F.lit("/")), F.lit(f" HTTP/1.1{RECORD_END}")))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(NL)), F.lit(""))
    metadata = _record("metadata", [("WARC-Record-ID", ids["metadata"]), at, uri, ("WARC-Concurrent-To", ids["capture"]),
                                    ("Content-Type", F.lit("application/warc-fields"))], about)
    (x.select(F.explode(F.array(request, F.when(revisits, revisit).otherwise(response), metadata)).alias("value"))
     .write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


# -------------------------------------------------------------------- reading

RECORDS = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
           "content_type string, http_head string, payload_digest string, stated_digest string, payload_bytes long, "
           "fields map<string,string>, truncated boolean")


def _headers(raw: bytes) -> list[tuple[str, str]]:
    """Names in lower case and values; a folded line goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip().lower(), value.strip()))
    return out


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes, bool]]:
    """``(header, block, whole)`` of the records of one file, given as its
    pieces between record ends; what stands before a record is passed over."""
    end = RECORD_END.encode()
    start = VERSION[:5].encode()
    header, block, want, held = None, [], 0, 0
    for piece in pieces:
        if header is not None:
            block.append(piece)
            held += len(piece)
            if held < want:
                held += len(end)
                continue
            got = end.join(block)
            yield header, got[:want], True
            # a block that ends in a line break shifts the record end: the next header is in this piece
            header, piece = None, got[want:]
        piece = piece.lstrip(b"\r\n")
        if not piece.startswith(start):
            continue
        header, block, held = piece, [], 0
        want = next((int(v) for k, v in _headers(header) if k == "content-length" and v.isdigit()), 0)
        if not want:
            yield header, b"", True
            header = None
    if header is not None:
        got = end.join(block)
        # the last record end of a file is not among the pieces; a block may end with it
        whole = bool(block) and len(got) < want <= len(got) + len(end)
        yield header, (got + end)[:want] if whole else got, whole


def _parsed(header: bytes, block: bytes, whole: bool, with_payload: bool) -> tuple:
    named = _headers(header)
    h = dict(reversed(named))
    kind = h.get("warc-type", "").lower()
    content = h.get("content-type", "").lower()
    head, payload = "", block
    if content.startswith("application/http"):
        cut = block.find(RECORD_END.encode())
        cut = len(block) if cut < 0 else cut
        head, payload = block[:cut].decode("utf-8", "replace"), block[cut + 4:]
    fields = _headers(block) if content.startswith("application/warc-fields") else []
    stated = h.get("warc-payload-digest", "")
    stated = stated.split(":", 1)[1].lower() if stated.lower().startswith("sha256:") else None
    row = (h.get("warc-record-id"), kind, [v for k, v in named if k == "warc-concurrent-to"], h.get("warc-refers-to"),
           h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), head,
           hashlib.sha256(payload).hexdigest() if kind != "revisit" else None, stated, len(payload) if kind != "revisit" else None,
           list(dict(fields).items()), not whole)
    return row + ((payload,) if with_payload else ())


def _reader(with_payload: bool, schema: pa.Schema):
    def run(batches):
        def files():
            """``(file, piece)`` in the order of the files."""
            for b in batches:
                for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield f, v

        rows, size = [], 0
        stream, ahead = files(), None
        ahead = next(stream, None)
        while ahead is not None:
            file = ahead[0]

            def pieces():
                nonlocal ahead
                while ahead is not None and ahead[0] == file:
                    yield ahead[1]
                    ahead = next(stream, None)

            for header, block, whole in split_records(pieces()):
                rows.append(_parsed(header, block, whole, with_payload))
                size += len(block) if with_payload else 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _decoded(uri: Column) -> Column:
    for c in reversed(_ESCAPED):
        uri = F.replace(uri, F.lit(f"%{c:02X}"), F.lit(chr(c)))
    return uri


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the gzip archives in ``path`` in the layout ``RECORDS``,
    with ``payload`` (bytes) unless it isn't wanted.  ``payload_digest`` and
    ``payload_bytes`` are taken from the bytes read (a revisit has none)."""
    text, one = pa.string(), pa.int64()
    schema = pa.schema([(n.split()[0], t) for n, t in zip(RECORDS.split(", "), [
        text, text, pa.list_(text), text, text, text, text, text, text, text, one, pa.map_(text, text), pa.bool_()])])
    if with_payload:
        schema = schema.append(pa.field("payload", pa.binary()))
    pieces = (spark.read.option("lineSep", RECORD_END).text(path)
              .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")))
    got = pieces.mapInArrow(_reader(with_payload, schema), RECORDS + (", payload binary" if with_payload else ""))
    return got.withColumn("target_uri", _decoded(F.col("target_uri")))


# ------------------------------------------------------------------- assembly

def capture_of(records: DataFrame) -> DataFrame:
    """``record_id, capture_id`` of every record but the captures themselves
    that concurrent-to identifiers tie to a capture, directly or over one
    record between; the smallest capture if there are several."""
    ids = records.select("record_id", F.col("record_type").isin(*CAPTURES).alias("is_capture"), "concurrent_to")
    said = ids.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = said.union(said.select("b", "a"))
    anchors = ids.filter("is_capture").select(F.col("record_id").alias("b"), F.col("record_id").alias("capture_id"))
    others = ids.filter("NOT is_capture").select(F.col("record_id").alias("a")).distinct()
    near = links.join(others, "a", "left_semi")
    one = near.join(anchors, "b").groupBy("a").agg(F.min("capture_id").alias("capture_id"))
    rest = near.join(one, "a", "left_anti")
    two = rest.join(one.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("capture_id").alias("capture_id"))
    return one.union(two).withColumnRenamed("a", "record_id")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response`` (a response or
    revisit record), ``requests, metadata, others`` (arrays in order of their
    ids).  Records that belong to no capture make rows without a response."""
    tied = capture_of(records).withColumnRenamed("record_id", "__id")
    x = records.join(tied, F.col("record_id") == F.col("__id"), "left").withColumn("__key", F.coalesce("capture_id", "record_id"))
    whole = F.struct(*records.columns)
    kind = F.col("record_type")
    listed = lambda on: F.array_sort(F.collect_list(F.when(on, whole)), lambda a, b: F.when(
        a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    return x.groupBy(F.col("__key").alias("capture_id")).agg(
        F.min_by(F.when(kind.isin(*CAPTURES), whole), F.when(kind.isin(*CAPTURES), kind)).alias("response"),
        listed(kind == "request").alias("requests"), listed(kind == "metadata").alias("metadata"),
        listed(~kind.isin("request", "metadata", *CAPTURES)).alias("others"))


def digest_rows(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, url
    and times of every capture of written pages; a revisit's payload facts are
    those of the response it refers to."""
    r = F.col("response")
    page = F.try_element_at("metadata", F.lit(1))["fields"]["page-id"].cast("long")
    x = captures.filter(r.isNotNull()).select(
        "capture_id", page.alias("page_id"), r["target_uri"].alias("url"), r["record_type"].alias("record_type"),
        r["refers_to"].alias("target"), r["payload_digest"].alias("digest"), r["payload_bytes"].alias("bytes"),
        F.size("requests").cast("long").alias("n_requests"))
    # a response that nothing refers to stays out of the join
    wanted = x.filter("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    facts = (x.filter("target IS NULL").select(F.col("capture_id").alias("target"), F.col("page_id").alias("to_page"),
                                               F.col("bytes").alias("to_bytes"), F.col("digest").alias("to_digest")).join(wanted, "target"))
    facts = cut_lineage(facts)
    return hot_left_join(x, facts, "target", "capture_id").select(
        "page_id", "url", F.coalesce("bytes", "to_bytes").alias("payload_bytes"), F.coalesce("digest", "to_digest").alias("payload_digest"),
        "record_type", F.col("to_page").alias("refers_to"), "n_requests")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives, read back and assembled."""
    spark = pages.sparkSession
    at = scratch_path(spark, "warc")
    write_pages(pages, at)
    table = scratch_path(spark, "warc-records")
    read_records(spark, at, with_payload=False).write.option("compression", "zstd").parquet(table)
    records = spark.read.parquet(table)
    captures = scratch_path(spark, "warc-captures")
    assemble(records).write.option("compression", "zstd").parquet(captures)
    return digest_rows(spark.read.parquet(captures))
