"""WARC archives: writer with revisit records, and a salvage reader (operator 10).

Writer: pages with equal payloads share one response record; the others are
revisit records that refer to it.  Every record is a gzip member of its own.
Members are written by a text sink whose line separator is an empty member, so
the files are valid archives on any file system that Spark can reach, with no
file access from tasks.

Salvage reader: an archive is walked record by record.  A record must have a
version line, a readable header block, its whole content and a matching block
digest.  After a failed check the reader looks for whichever comes first, a
version line with a valid record or a gzip member that holds one, goes on from
there, and logs the bytes passed over as a gap with the reason.

Defined results: a null page is empty; a null url is an empty target; a page
without an id revisits an equal page that has one, and is a response where none
has; repeated rows with the id of a response are responses too; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, saved, whole_text
from tessera.session import ensure_checkpoint_dir

VERSION = b"WARC/1.1"
SEPARATOR = "\r\n\r\n"
#: An empty gzip member, as characters of one byte each.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
GZIP_MAGIC = b"\x1f\x8b\x08"
INFLATE_BYTES = 1 << 16
VERSION_LINE = re.compile(rb"WARC/[0-9.]{1,16}[ \t]{0,16}\r\n")
START = re.compile(rb"WARC/|" + re.escape(GZIP_MAGIC))
#: Smallest payload, in bytes, of which later copies become revisits.
REVISIT_BYTES = 0
#: Payload bytes per archive file, about; a file is read as one row.
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_TYPES = "path string, at long, headers map<string,string>, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digest_udf():
    """Digests of a column of bytes, batch by batch."""
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: payload_digest(bytes(b)))

    return F.pandas_udf(digests, "string")


def with_digests(pages: DataFrame, html_col: str) -> DataFrame:
    """Add payload_bytes and payload_digest."""
    payload = whole_text(html_col).cast("binary")
    return (pages.withColumn("payload_bytes", F.octet_length(payload).cast("long"))
            .withColumn("payload_digest", _digest_udf()(payload)))


def _member_udf():
    """Bytes of a record as a gzip member."""
    def members(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: gzip.compress(bytes(b), 6, mtime=0))

    return F.pandas_udf(members, "binary")


def record_roles(digests: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Per (page_id, payload_digest): record_type and refers_to.  The response
    of a digest is found by a partial aggregate; hot digests are joined apart."""
    best = digests.groupBy("payload_digest").agg(
        F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    joined = join_by_key(digests, saved(best), "payload_digest", "n")
    revisit = ((F.col("payload_bytes") >= least_bytes) & F.col("response_id").isNotNull()
               & ~F.col("page_id").eqNullSafe(F.col("response_id")))
    return joined.select("page_id", "payload_digest", F.when(revisit, "revisit").otherwise("response")
                         .alias("record_type"), F.when(revisit, F.col("response_id")).alias("refers_to"))


def _urn(id_col) :
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = REVISIT_BYTES) -> None:
    """Write one record per page under ``path``."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        whole_text(html_col).alias("html"))
    small = saved(with_digests(slim, "html").select("page_id", "payload_bytes", "payload_digest"))
    roles = record_roles(small, least_bytes)
    # copies of one page id with one payload have one role; others differ by digest
    roles = roles.groupBy("page_id", "payload_digest").agg(
        F.first("record_type").alias("record_type"), F.first("refers_to").alias("refers_to"))
    full = with_digests(slim, "html").alias("p").join(
        roles.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id"))
        & (F.col("p.payload_digest") == F.col("r.payload_digest"))).select(
        "p.*", "r.record_type", "r.refers_to")
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    revisit = F.col("record_type") == "revisit"
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")),
             F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
             F.lit(f"WARC-Date: {DATE}"),
             F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(
                 F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "")),
             F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
             F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
             F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
             F.when(~revisit, F.concat(F.lit("WARC-Block-Digest: sha1:"), F.col("payload_digest"))),
             F.lit("Content-Type: text/html"),
             F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), body, F.lit(SEPARATOR))
    member = _member_udf()(record.cast("binary")).cast("string")
    size = small.agg(F.sum("payload_bytes"), F.count(F.lit(1))).first()
    per_file = max(1, FILE_BYTES * (size[1] or 1) // max(1, size[0] or 0))
    (full.select(member.alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER).option("maxRecordsPerFile", per_file).text(path))


class _HeaderEnds:
    """Place of the first blank line from an offset on.  The last answer holds
    for every offset up to it, so a run of broken version lines is read once."""

    def __init__(self, data: bytes):
        self.data, self.start, self.end = data, 0, -1

    def __call__(self, at: int) -> int:
        if not self.start <= at <= self.end:
            found = self.data.find(b"\r\n\r\n", at)
            self.start, self.end = at, found if found >= 0 else len(self.data)
        return self.end if self.end < len(self.data) else -1


def _header(data: bytes, at: int, cut: int) -> dict[str, str] | None:
    """Fields of the lines from ``at`` to ``cut``; None at the first line
    without a colon."""
    out = {}
    while at < cut:
        end = data.find(b"\r\n", at, cut)
        end = cut if end < 0 else end
        name, colon, value = data[at:end].partition(b":")
        if not colon:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = end + 2
    return out


def _record(data: bytes, at: int, ends: _HeaderEnds):
    """(end, headers, payload) of the record at ``at``, or the reason why there
    is none."""
    line = VERSION_LINE.match(data, at)
    if line is None:
        return "no version line"
    cut = ends(line.end() - 2)
    if cut < 0:
        return "no end of header"
    headers = _header(data, line.end(), cut)
    if headers is None or not headers.get("content-length", "").isdigit():
        return "bad header"
    start = cut + 4
    end = start + int(headers["content-length"])
    if end > len(data):
        return "content cut off"
    payload = data[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != payload_digest(payload):
        return "block digest differs"
    if data[end:end + 4] not in (b"\r\n\r\n", b""):
        return "no end of record"
    return min(end + 4, len(data)), headers, payload


def salvage_plain(data: bytes):
    """Yield ("record", at, headers, payload) and ("gap", start, end, reason)."""
    at, ends = 0, _HeaderEnds(data)
    while at < len(data):
        got = _record(data, at, ends)
        if not isinstance(got, str):
            yield "record", at, got[1], got[2]
            at = got[0]
            continue
        found, reason = at + 1, got
        while True:
            found = data.find(b"WARC/", found)
            if found < 0:
                found = len(data)
                break
            # a version line in the middle of a payload is no record
            if not isinstance(_record(data, found, ends), str):
                break
            found += 1
        yield "gap", at, found, reason
        at = found


def _member(data: bytes, at: int):
    """(end, content) of the gzip member at ``at``, or None."""
    d = zlib.decompressobj(31)
    view, pieces, fed = memoryview(data), [], at
    try:
        while not d.eof and fed < len(data):
            pieces.append(d.decompress(view[fed:fed + INFLATE_BYTES]))
            fed += INFLATE_BYTES
    except zlib.error:
        return None
    return (min(fed, len(data)) - len(d.unused_data), b"".join(pieces)) if d.eof else None


def _next(data: bytes, at: int, ends: _HeaderEnds):
    """(offset, member or None) of what first verifies from ``at`` on: a version
    line with a valid record or a gzip member that holds one."""
    for start in START.finditer(data, at):
        if start.group() != GZIP_MAGIC:
            if not isinstance(_record(data, start.start(), ends), str):
                return start.start(), None
        else:
            got = _member(data, start.start())
            if got is not None and any(x[0] == "record" for x in salvage_plain(got[1])):
                return start.start(), got
    return len(data), None


def salvage(data: bytes):
    """Records and gaps of an archive of plain records, gzip members or both.
    Offsets are those of the file."""
    at, got, ends = 0, None, _HeaderEnds(data)
    while at < len(data):
        plain = _record(data, at, ends)
        if not isinstance(plain, str):
            yield "record", at, plain[1], plain[2]
            at = plain[0]
            continue
        packed = data.startswith(GZIP_MAGIC, at)
        if got is None and packed:
            got = _member(data, at)
        if got is not None:
            for item in salvage_plain(got[1]):
                if item[0] == "record":
                    yield "record", at, item[2], item[3]
                else:
                    yield "gap", at, got[0], item[3]
            at, got = got[0], None
            continue
        found, got = _next(data, at + 1, ends)
        yield "gap", at, found, "no valid member" if packed else plain
        at = found


def read_items(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """Records, gaps or both (``kinds``) of all archives under ``path``; a gap
    has end and reason, a record headers and payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["path", "at", "headers", "payload", "end", "reason"]

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                some = []
                for kind, at, a, b in salvage(bytes(content)):
                    if kind in kinds:
                        some.append((path, at, a, b, None, None) if kind == "record" else
                                    (path, at, None, None, a, b))
                    if len(some) == 256:
                        yield pd.DataFrame(some, columns=names, dtype=object)
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=names, dtype=object)

    return files.mapInPandas(items, f"{RECORD_TYPES}, end long, reason string")


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives under ``path``.  Records: path, at,
    headers, payload; gaps: path, start, end, reason."""
    return (read_items(spark, path, "record").select("path", "at", "headers", "payload"),
            read_items(spark, path, "gap").select("path", F.col("at").alias("start"), "end", "reason"))


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html") -> DataFrame:
    """Write the pages and read the archives back."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    return read_back(spark, path, id_col, pages.schema[id_col].dataType.simpleString())


def read_back(spark: SparkSession, path: str, id_col: str, kind: str) -> DataFrame:
    """One row per record of the archives under ``path``, sizes and digests of
    responses taken from what was read, and one row per gap: no id, the bytes
    passed over and ``gap: <reason>`` as type."""
    told = read_items(spark, path, "record", "gap").select(
        "headers", F.octet_length("payload").cast("long").alias("n"),
        _digest_udf()(F.coalesce("payload", F.lit("").cast("binary"))).alias("digest"),
        (F.col("end") - F.col("at")).alias("lost"), "reason")
    h = F.col("headers")
    number = lambda name: F.nullif(F.regexp_extract(F.coalesce(h[name], F.lit("")), r"^<urn:page:(.*)>$", 1),
                                   F.lit("")).cast(kind)
    response = h["warc-type"] == "response"
    return told.select(
        number("warc-record-id").alias(id_col),
        F.when(response, F.col("n")).otherwise(F.coalesce("lost", h["x-payload-length"].cast("long")))
        .alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(
            F.regexp_replace(h["warc-payload-digest"], "^sha1:", "")).alias("payload_digest"),
        F.coalesce(F.concat(F.lit("gap: "), F.col("reason")), h["warc-type"]).alias("record_type"), number("warc-refers-to").alias("refers_to"))
