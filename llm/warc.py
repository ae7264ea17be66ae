"""WARC archives of pages: written as records in segments, read back by segment reassembly.

A page is a response record whose HTTP block is in chunked transfer framing. A block of more than
``SEGMENT`` bytes is cut into a first segment and continuation records, which may lie in any file.
Pages whose payload another record holds already are revisit records without payload.

Archives are written and read with Spark's text files: a record is one row, and ``WARC/1.``, which
begins every record, separates rows when reading. A payload may hold those letters too, so pieces are
put together until the record's Content-Length is met.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import lookup, small_batches, stored, table
from newscorpus.operators.keyed import broadcast_if_few
from newscorpus.session import work_path

#: Bytes of a chunk of transfer framing, and of a block beyond which it is cut into segments.
CHUNK, SEGMENT = 8_192, 32_768
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT = 100
#: Records of a file at most.
FILE_RECORDS = 20_000

# Fixed values of the format.
CRLF, START = "\r\n", "WARC/1."
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, record_type string, target_uri string, page string, refers_to string, payload_digest string, "
    "origin string, segment long, total long, status string, block binary"
)


def _urn(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _fields(*pairs: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs])


def _cut(data: Column, size: int, make) -> Column:
    """``make(number, last number, piece)`` of each piece of ``size`` bytes of a binary column, as an array."""

    def pieces(whole: Column) -> Column:
        last = F.floor((F.octet_length(whole) - 1) / size)
        piece = lambda i: F.substr(whole, (i * size + 1).cast("int"), F.lit(size))
        return F.when(F.octet_length(whole) > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: make(i, last, piece(i))))

    # As the argument of a function the bytes are made once, not once for each piece.
    return F.transform(F.array(data), pieces)[0]


def framed(payload: Column, chunk: int = CHUNK) -> Column:
    """The HTTP block of a binary payload, in chunked transfer framing, as binary."""

    def line(_, __, piece):
        return F.concat(F.hex(F.octet_length(piece).cast("long")), F.lit(CRLF), piece.cast("string"), F.lit(CRLF))

    chunks = F.coalesce(F.array_join(_cut(payload, chunk, line), ""), F.lit(""))
    return F.concat(F.lit(HTTP_HEAD), chunks, F.lit("0\r\n\r\n")).cast("binary")


def records(pages: DataFrame, archive: str, date: str, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """One column ``record``: head and block of each record, without the two line ends that follow.

    ``pages`` has row (unique), page_id, url, payload (binary), digest, first (row of the response
    that a revisit refers to; null: a response).
    """
    own = _urn(F.lit(archive), F.col("row"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    shared = [
        ("WARC-Target-URI", url),
        ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    ]
    revisit = F.col("first").isNotNull()
    head = F.when(
        revisit,
        _fields(
            ("WARC-Type", F.lit("revisit")),
            ("WARC-Record-ID", own),
            ("WARC-Refers-To", _urn(F.lit(archive), F.col("first"))),
            ("WARC-Profile", F.lit(PROFILE)),
            *shared,
        ),
    ).otherwise(_fields(("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), *shared))
    block = F.when(revisit, F.lit(HTTP_HEAD).cast("binary")).otherwise(framed(F.col("payload"), chunk))

    def record(i, last, piece):
        size = ("Content-Length", F.octet_length(piece).cast("string"))
        number = F.when(last > 0, (i + 1).cast("string"))
        first = F.concat(F.col("_head"), _fields(("WARC-Segment-Number", number), size))
        total = F.when(i == last, F.octet_length("_block").cast("string"))
        later = _fields(
            ("WARC-Type", F.lit("continuation")),
            ("WARC-Record-ID", _urn(F.lit(archive), F.col("row"), i)),
            ("WARC-Date", F.lit(date)),
            ("WARC-Segment-Origin-ID", F.col("_own")),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", total),
            size,
        )
        lines = F.when(i == 0, first).otherwise(later)
        return F.concat(F.lit(f"{START}1{CRLF}"), lines, F.lit(CRLF), piece.cast("string"))

    # The outer generators keep the optimizer from making the block once for each use of it.
    parts = F.struct("row", head.alias("_head"), own.alias("_own"), block.alias("_block"))
    made = pages.select(F.explode_outer(F.array(parts)).alias("_r"))
    return made.select("_r.*").select(F.explode_outer(_cut(F.col("_block"), segment, record)).alias("record"))


def write_archives(
    pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z", least: int = LEAST_REVISIT, chunk: int = CHUNK, segment: int = SEGMENT
) -> None:
    """Write rows of (page_id, url, html) as gzipped WARC files to the new folder ``path``.

    A null html is the empty payload, a null page_id or url a record without that line. Of rows with
    equal payloads of ``least`` bytes or more, that with the smallest page_id (null last, then any of
    equal rows) is the response and the others revisit it. Line ends in a url are percent-encoded.
    Other columns are ignored; an empty table makes an empty archive.
    """
    spark = pages.sparkSession
    kept = stored(pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.monotonically_increasing_id().alias("row")), "pages")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = kept.select("page_id", "url", "row", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    narrow = full.where(F.octet_length("payload") >= least).select("digest", "row", "page_id")
    narrow = stored(narrow.select(F.unhex("digest").alias("digest"), "row", "page_id"), "digests")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    again = narrow.groupBy("digest").agg(F.min(order)["row"].alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stored(again.select("digest", "first"), "again")
    met = narrow.join(F.broadcast(again), "digest", "left_semi") if again.count() <= 100_000 else narrow
    revisits = stored(lookup(met, again, "digest").where("first <> row").select("row", "first"), "revisits")
    rows = full.join(broadcast_if_few(revisits), "row", "left")
    writer = records(rows, uuid.uuid4().hex, date, chunk, segment).write
    writer.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parsed(pieces: list[bytes]) -> tuple[dict[bytes, bytes], bytes, int] | None:
    """(fields, block, bytes beyond the record) of pieces that hold a whole record, else None."""
    whole = START.encode().join(pieces) if len(pieces) > 1 else pieces[0]
    at = whole.find(b"\r\n\r\n")
    if at < 0:
        return None
    lines = (line.partition(b":") for line in whole[:at].split(b"\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return fields, b"", 0
    end = at + 4 + int(size)
    if len(whole) < end + 4:
        return None
    return fields, whole[at + 4 : end], len(whole) - end - 4


def _row(fields: dict[bytes, bytes], block: bytes, status: str) -> tuple:
    text = lambda name: fields[name].decode(errors="replace") if name in fields else None
    number = lambda name: int(fields[name]) if fields.get(name, b"").isdigit() else None
    return (
        *map(text, (b"warc-record-id", b"warc-type", b"warc-target-uri", b"x-page-id", b"warc-refers-to", b"warc-payload-digest")),
        text(b"warc-segment-origin-id"), number(b"warc-segment-number"), number(b"warc-segment-total-length"), status, block,
    )


class Splitter:
    """Records out of the pieces of files, fed in order."""

    def __init__(self) -> None:
        self.file, self.open, self.held, self.need = None, [], 0, 0

    def feed(self, file: tuple, piece: bytes) -> Iterator[tuple]:
        if file != self.file:
            yield from self.close()
            self.file = file
            if file[1] == 0:  # what comes before the first record
                return
        self.open.append(piece)
        self.held += len(piece) + len(START)
        # A record in many pieces is looked at again only when it can be whole.
        while self.open and self.held >= self.need:
            found = _parsed(self.open)
            if found is None:
                if len(self.open) == 1:
                    self.need = self._whole(self.open[0])
                return
            fields, block, beyond = found
            if beyond and len(self.open) > 1:  # a damaged record: those after it stand for themselves
                yield _row(_parsed_head(self.open[0]), b"", "wrong length")
                rest, self.open = self.open[1:], []
                self.held = self.need = 0
                for one in rest:
                    yield from self.feed(self.file, one)
                return
            status = "ok" if b"content-length" in fields and not beyond else "wrong length"
            yield _row(fields, block, status)
            self.open, self.held, self.need = [], 0, 0

    @staticmethod
    def _whole(piece: bytes) -> int:
        at = piece.find(b"\r\n\r\n")
        size = _parsed_head(piece).get(b"content-length", b"")
        return at + 8 + int(size) if at >= 0 and size.isdigit() else 0

    def close(self) -> Iterator[tuple]:
        rest, self.open = self.open, []
        self.held = self.need = 0
        if rest:
            yield _row(_parsed_head(rest[0]), b"", "wrong length")
            for one in rest[1:]:
                yield from self.feed(self.file, one)
            yield from self.close()


def _parsed_head(piece: bytes) -> dict[bytes, bytes]:
    lines = (line.partition(b":") for line in piece.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """The records of WARC files (plain or gzipped) below ``path``, as they are: columns of RECORD.

    ``segments`` keeps only those that are segments, or only those that are not. ``status`` is ``ok``
    or ``wrong length``: the Content-Length is missing or does not lead to the end of the record; its
    block is empty then, and later records are read all the same. A gzipped file is one task; a large
    plain file is split, and a record of it that crosses a split and holds ``WARC/1.`` itself is of
    wrong length. Without files there are no rows.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", START).text(path)
    pieces = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("piece"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    at = names.index("segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()

        def rows(found: list[tuple]) -> pa.RecordBatch:
            wanted = [r for r in found if segments is None or (r[at] is not None) == segments]
            columns = list(zip(*wanted)) or [()] * len(names)
            kinds = [pa.int64() if n in ("segment", "total") else pa.binary() if n == "block" else pa.string() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            found: list[tuple] = []
            for file, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                found.extend(splitter.feed((file, start), piece))
            yield rows(found)
        yield rows(list(splitter.close()))

    return pieces.mapInArrow(run, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """One record for each origin identifier of segment records, blocks joined by segment number.

    ``status`` tells what is wrong: ``missing segment`` (numbers are not 1 to the last, which names
    the total length), ``conflicting segments`` (one number, several blocks) or ``wrong length`` (the
    blocks do not add up to the total, or a segment was damaged). Repeated equal segments count once.
    """
    first = F.min(F.struct("segment", "record_id", "record_type", "target_uri", "page", "refers_to", "payload_digest")).alias("_first")
    parts = F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("_parts")
    one = segments.groupBy(F.coalesce("origin", "record_id").alias("_origin")).agg(
        first, parts, F.max("total").alias("total"), F.max("segment").alias("_last"), F.max(F.col("status") != "ok").alias("_bad"),
        F.max(F.when(F.col("total").isNotNull(), F.col("segment"))).alias("_told"),
    )
    block = F.array_join(F.transform("_parts", lambda p: p["block"].cast("string")), "").cast("binary")
    numbers = F.size(F.array_distinct(F.transform("_parts", lambda p: p["segment"])))
    status = (
        F.when(F.col("_bad"), "wrong length")
        .when(F.size("_parts") > numbers, "conflicting segments")
        .when((numbers < F.col("_last")) | (F.col("_first.segment") != 1) | ~F.coalesce(F.col("_told") == F.col("_last"), F.lit(False)), "missing segment")
        .when(F.octet_length("_block") != F.col("total"), "wrong length")
        .otherwise("ok")
    )
    joined = one.withColumn("_block", block)
    return joined.select(
        *[F.col(f"_first.{n}").alias(n) for n in ("record_id", "record_type", "target_uri", "page", "refers_to", "payload_digest")],
        status.alias("status"),
        F.col("_block").alias("block"),
    )


def unchunked(data: bytes) -> bytes | None:
    """What chunked transfer framing holds; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size <= 0:
            return b"".join(out) if size == 0 else None
        at = end + 2 + size
        if data[at : at + 2] != b"\r\n":
            return None
        out.append(data[end + 2 : at])
        at += 2


def http_payload(block: bytes) -> tuple[bytes | None, str]:
    """(payload, status) of an HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None, "no http head"
    fields = (line.partition(b":") for line in head.lower().split(b"\r\n")[1:])
    if any(name.strip() == b"transfer-encoding" and b"chunked" in value for name, _, value in fields):
        body = unchunked(body)
    return (body, "ok") if body is not None else (None, "broken chunks")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of the archives below ``path``: record_id, record_type, target_uri, page (the
    page's id as text), refers_to, payload_digest (as its record tells), status, payload (binary).

    Records of several segments are reassembled. A record that is not whole has a null payload and a
    ``status`` other than ``ok``; so has a revisit (``revisit``), whose payload another record has.
    """
    keep = ["record_id", "record_type", "target_uri", "page", "refers_to", "payload_digest", "status", "block"]
    whole = read_records(spark, path, segments=False).select(*keep)
    found = whole.unionAll(reassembled(read_records(spark, path, segments=True)).select(*keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(keep, (x.to_pylist() for x in batch.columns)))
            decoded = [
                (None, s) if s != "ok" else (None, "revisit") if t == "revisit" else http_payload(b)
                for t, s, b in zip(c["record_type"], c["status"], c["block"])
            ]
            columns = [*batch.columns[:6], pa.array([s for _, s in decoded], pa.string()), pa.array([p for p, _ in decoded], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*keep[:7], "payload"])

    return found.mapInArrow(run, ", ".join(f"{n} string" for n in keep[:7]) + ", payload binary")


def archived(pages: DataFrame, path: str, **how) -> DataFrame:
    """Write ``pages`` to archives below ``path`` and tell what is read back, a row per page:
    page_id, payload_bytes, payload_digest, record_type, refers_to, status.

    A revisit has the size and digest of the payload that its response was read back with; both are
    null where that record is not whole. ``status`` is ``ok`` for whole responses and for revisits.
    """
    spark = pages.sparkSession
    write_archives(pages, path, **how)
    kind = dict(pages.dtypes)["page_id"]
    found = stored(
        read_archives(spark, path).select(
            "record_id", "record_type", F.col("page").cast(kind).alias("page_id"), "refers_to", "status",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        ),
        "read",
    )
    given = found.where("record_type <> 'revisit'")
    of = given.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_of"), "payload_bytes", "payload_digest")
    revisits = lookup(found.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to"), of, "refers_to", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status"]
    revisits = revisits.select(*names[:4], F.col("_of").alias("refers_to"), F.lit("ok").alias("status"))
    return given.select(*names[:4], F.lit(None).cast(kind).alias("refers_to"), "status").unionAll(revisits)


def op13_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back: size, digest, record type."""
    found = archived(table(spark, sf_dir, "pages"), work_path(spark, "warc"))
    return found.drop("status")


OP13_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, row_number() OVER () AS row FROM pages),
d AS (SELECT page_id, row, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (
  SELECT *, payload_bytes >= {LEAST_REVISIT} AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS least FROM d
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, row))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN least END AS refers_to
FROM f
"""
