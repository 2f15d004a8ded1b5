"""WARC archives: write, normalise, index and read back.

``write_monolithic`` lets Spark's text writer put records into gzip files, each one a single stream from which no record
can be read alone. ``normalise`` inflates every such file once, as a stream in bounded memory, rewrites each record as a
gzip member of its own and writes a sidecar (``<archive>.idx.json``, a JSON object per record with file, offset and
length) beside it. Archives and sidecars appear under their names only when whole, so a task that is lost and run again
leaves no half file. ``read_records`` fetches single members by offset and checks their digests. Payloads are hashed where
they are read; only those whose digest a Bloom filter takes for a repeated one meet the groups of equal digests.

Defined cases: a null payload is empty, and payloads are archived byte by byte, well-formed UTF-8 or not; ids are exact up to
64 bits; a null URL gives no WARC-Target-URI line, control characters in URLs are percent-encoded, and replacement characters
stand for malformed bytes; of records with equal payloads the smallest id is the response and all others, null ids included, revisit
it; rows that repeat the smallest id, and groups with null ids only, are responses; an empty table gives no archives and
no records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import exact_dedup
from pagewright.llm.shared import file_system, remove, scratch, utf8, written

CHUNK = 1 << 20
#: RFC 4648's base32 digits against those of numbers in base 32.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ID_PREFIX = "urn:page:"
INDEX_SCHEMA = "file string, offset long, length long, record_id string, record_type string, payload_digest string, target_uri string"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1 of a binary column: eight times 20 bits of the hex digest, each as four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def with_revisits(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type and refers_to of each page, repeated payloads decided on digests alone."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(text_col).alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    rows = rows.withColumn("h", F.when(F.octet_length("payload") >= min_bytes, F.xxhash64("payload_digest")))
    narrow = written(rows.where("h IS NOT NULL").select("page_id", "payload_digest", "h"), "warc-digests")
    n, straight, met = narrow.count(), rows.where("false"), rows
    if exact_dedup.ranges(n) == 1:  # one filter, small enough to broadcast, tells which payloads needn't move
        cells = exact_dedup.filter_cells(n)
        bits = pages.sparkSession.sparkContext.broadcast(exact_dedup.repeated_filter(narrow.select("h"), cells))
        narrow = exact_dedup.with_maybe(narrow, "h", "maybe", cells, bits)
        met = exact_dedup.with_maybe(rows.withColumn("long_enough", F.col("h").isNotNull()).na.fill(0, ["h"]), "h", "maybe", cells, bits)
        straight, met = met.where("NOT (maybe AND long_enough)"), met.where("maybe AND long_enough")
    else:
        narrow = exact_dedup.by_ranges(narrow, n, "h", exact_dedup.MAX_CELLS)
    firsts = written(narrow.where("maybe").groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    revisits = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull() & (F.octet_length("payload") >= min_bytes)
    met = met.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to")
    )
    return met.unionByName(straight.select("page_id", "url", "payload", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def record_text(captured_at: str = "1970-01-01T00:00:00Z") -> Column:
    """The record of a ``with_revisits`` row as text, but for its last line end. A revisit holds the HTTP head without the payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string")))  # bytes as they stand
    uri = F.regexp_replace(F.make_valid_utf8("url"), r"[\x00-\x20\x7F]", "%20")
    urn = lambda value: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(captured_at)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )


def write_monolithic(records: DataFrame, path: str) -> None:
    """Writes ``with_revisits`` rows as gzip WARC files, one gzip stream each."""
    records.select(record_text().alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n").text(path)


def inflated(handle) -> Iterator[bytes]:
    """A gzip file's bytes in chunks, whether it has one member or many."""
    d = zlib.decompressobj(31)
    while data := handle.read(CHUNK):
        while data:
            yield d.decompress(data, CHUNK)
            data = d.unconsumed_tail
            if d.eof:
                data, d = d.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
    yield d.flush()


class _Bytes:
    """Reads exact lengths and heads from chunks; a cursor moves through what is held, which is cut once a chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def more(self) -> bool:
        part = next(self.chunks, None)
        if part is not None:
            self.held, self.at = self.held[self.at :] + part, 0
        return part is not None

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("a WARC record's head is cut off")
                return None
        found, self.at = self.held[self.at : end + 4], end + 4
        return found

    def body(self, n: int) -> Iterator[memoryview]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("a WARC record's block is cut off")
            part = memoryview(self.held)[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    """A head's named fields, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _record(head: bytes, stream: _Bytes, n: int) -> Iterator[bytes | memoryview]:
    yield head
    yield from stream.body(n)
    yield from stream.body(4)


def _rewrite(source: str, folder: str) -> tuple[str, int, int]:
    """Rewrites one file; the name, records and bytes of the new one."""
    fs, path = file_system(source)
    out_fs, out = file_system(folder)
    name = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc") + ".warc.gz"
    own = f"{out}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    offset = count = 0
    try:
        with fs.open_input_stream(path, compression=None) as raw, out_fs.open_output_stream(own, compression=None) as to, out_fs.open_output_stream(f"{own}.idx", compression=None) as index:
            stream = _Bytes(inflated(raw))
            while (head := stream.head()) is not None:
                got, member, length = fields(head), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                for part in _record(head, stream, int(got["content-length"])):
                    length += to.write(member.compress(part))
                length += to.write(member.flush())
                entry = {"file": f"{folder}/{name}", "offset": offset, "length": length, "record_id": got["warc-record-id"], "record_type": got["warc-type"], "payload_digest": got.get("warc-payload-digest", "").removeprefix("sha1:"), "target_uri": got.get("warc-target-uri")}
                index.write(json.dumps(entry).encode() + b"\n")
                offset, count = offset + length, count + 1
        for made, to in ((f"{own}.idx", f"{out}/{name}.idx.json"), (own, f"{out}/{name}")):
            if out_fs.get_file_info(to).type != FileType.NotFound:  # an earlier attempt's, whose records are the same
                out_fs.delete_file(to)
            out_fs.move(made, to)
    finally:
        for left in (own, f"{own}.idx"):
            if out_fs.get_file_info(left).type != FileType.NotFound:
                out_fs.delete_file(left)
    return f"{folder}/{name}", count, offset


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrites all gzip files in ``source`` into ``folder``, a record a member; returns the sidecars' rows."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    sources = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), _rewrite(path, folder), strict=True))])

    written(sources.mapInArrow(run, "file string, records long, bytes long"), "warc-files")
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.idx.json").json(folder)


def parse_member(data: bytes) -> dict:
    """A record from its member. The digest and size of a response are taken from its payload; a revisit's are those it names."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    got = fields(head + b"\r\n")
    block = rest[: int(got["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x.endswith("none>") else int(x.removeprefix(f"<{ID_PREFIX}").removesuffix(">"))
    digest, named = base64.b32encode(hashlib.sha1(payload).digest()).decode(), got["warc-payload-digest"].removeprefix("sha1:")
    revisit = got["warc-type"] == "revisit"
    if not revisit and digest != named:
        raise ValueError(f"the payload of {got['warc-record-id']} doesn't have its digest")
    return {
        "page_id": number(got["warc-record-id"]), "payload_bytes": int(fields(http)["content-length"]) if revisit else len(payload), "payload_digest": named if revisit else digest,
        "record_type": got["warc-type"], "refers_to": number(got.get("warc-refers-to")), "target_uri": got.get("warc-target-uri"), "payload": None if revisit else payload,
    }


RECORD_KINDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of an index, each read from its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = handle = None
        found, size = [], 0
        try:
            for batch in batches:
                for file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if file != name:
                        if handle is not None:
                            handle.close()
                        fs, path = file_system(file)
                        name, handle = file, fs.open_input_file(path)
                    record = parse_member(handle.read_at(length, offset))
                    size += record["payload_bytes"]
                    found.append(record if with_payload else record | {"payload": None})
                    if len(found) == 1024 or size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(found, RECORD_KINDS)
                        found, size = [], 0
            yield pa.RecordBatch.from_pylist(found, RECORD_KINDS)
        finally:
            if handle is not None:
                handle.close()

    return index.select("file", "offset", "length").mapInArrow(run, RECORD_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, keep_monolithic: bool = True) -> DataFrame:
    """Writes ``pages`` as monolithic archives, normalises them, and returns the index of the normalised ones.

    The monolithic ones can be removed once they are rewritten. ``folder``: without one, a scratch folder that ``only_last`` removes.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write_monolithic(with_revisits(pages, min_bytes=min_bytes), f"{folder}/monolithic")
    index = normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    if not keep_monolithic:
        remove(spark, f"{folder}/monolithic")
    return index
