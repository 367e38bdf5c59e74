"""WARC archives with an index: write first, then read by sorted and coalesced byte ranges.

Writing: each task appends its records to an archive of its own in the shared
folder, one gzip member a record, and returns the index rows (archive, offset,
length, URL, digest). An archive's name is unique to the task attempt and only the
attempt that Spark commits has index rows, so a lost executor leaves at most an
unreferenced file.

Of records with one payload of ``REVISIT_BYTES`` or more, the largest page id is
the response and the others are revisits that name it. Rows whose digest no other
row shares (see ``slots``) are written where they are read; only the others are
joined with their group.

Reading: selected index rows are dealt out by archive and stretch of ``MIN_READ``
bytes, to a number of tasks that follows the bytes, and sorted by offset; a task merges ranges with gaps up to ``GAP_BYTES`` and makes
one read for each.
"""

from __future__ import annotations

import base64
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, drop_later, shared_dir, text_or_empty, written
from .slots import marked, open_slots, slot, slot_bits

REVISIT_BYTES = 1000
#: Bytes of records a task reads, about; a stretch of an archive that goes to one task.
SPAN_BYTES, MIN_READ = 8 << 20, 1 << 20
GAP_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "page_id long, url string, digest string, record_type string, archive string, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, header_digest string, payload binary"


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page what its record will be: ``page_id, url, html, digest, record_type, refers_to, refers_url``."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), text_or_empty(html).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("_large", F.octet_length("html") >= REVISIT_BYTES)
    at = slot(slot_bits(pages.count()), F.col("digest"))
    rows = marked(rows, at, written(open_slots(rows.where("_large"), at, "digests")), "digests").withColumn("_open", F.col("_large") & F.col("digests")).drop("_large", "digests")
    several = rows.where("_open")
    #: Grouped by one column more than joined on: both sides get an exchange that Spark can split.
    groups = several.groupBy("digest", F.octet_length("html").alias("bytes")).agg(F.max(F.struct("page_id", "url")).alias("_top")).select(F.col("digest").alias("_digest"), F.col("_top.page_id").alias("_response"), F.col("_top.url").alias("_url"))
    several = several.join(groups, F.col("digest") == F.col("_digest"))
    revisit = F.coalesce(F.col("page_id") != F.col("_response"), F.col("_response").isNotNull())
    several = several.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_response"))).withColumn("refers_url", F.when(revisit, F.col("_url")))
    single = rows.where("not _open").withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("long")).withColumn("refers_url", F.lit(None).cast("string"))
    names = ["page_id", "url", F.when(F.col("record_type") == "response", F.col("html")).alias("html"), "digest", "record_type", "refers_to", "refers_url"]
    return single.select(*names).unionByName(several.select(*names))


def _record_id(page_id: int | None, digest: str) -> str:
    """The same for one page and payload whenever it is written, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _uri(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&()*+,;=%~")


def _assembled(head: list[str], kind: str, block: bytes) -> bytes:
    head = [VERSION, *head, f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(archive: str, date: str) -> bytes:
    """The record that describes an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {archive}"]
    return _assembled(head, "application/warc-fields", b"format: WARC File Format 1.1\r\n")


def _record(page_id: int | None, url: str | None, html: str | None, digest: str, kind: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One record, uncompressed. The page ids go into extension fields."""
    own = _record_id(page_id, digest) if kind == "response" else f"<urn:uuid:{uuid.uuid4()}>"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        head += [f"WARC-Target-URI: {_uri(url)}", f"Page-URL: {base64.b64encode(url.encode()).decode()}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    payload = (html or "").encode()
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return _assembled(head, "application/http;msgtype=response", block)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _parsed(record: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, header_digest, payload) of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no record here: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    kind = fields["WARC-Type"]
    number = lambda k: int(fields[k]) if k in fields else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    url = base64.b64decode(fields["Page-URL"]).decode() if "Page-URL" in fields else None
    return number("Page-Id"), url, kind, number("Refers-To-Page-Id"), digest, None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _layout(schema: str) -> tuple[list[str], list[pa.DataType]]:
    parts = [x.split() for x in schema.split(", ")]
    return [n for n, _ in parts], [_TYPES[t] for _, t in parts]


def write_archives(records: DataFrame, date: str = DATE) -> DataFrame:
    """Write planned records; returns the index, itself written to the shared folder.

    Each archive begins with a warcinfo record. Dropping the index drops the archives.
    Archives are opened by ``pyarrow.fs``, so the shared folder's scheme must be one it
    knows (a local path, file, hdfs, s3, gs).
    """
    folder = f"{shared_dir(records.sparkSession)}/playframe/warc-{uuid.uuid4().hex}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, path = FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        archive = f"{uuid.uuid4().hex}.warc.gz"
        offset = 0
        with store.open_output_stream(f"{path}/{archive}", compression=None) as out:
            for b in batches:
                rows = []
                for r in itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.slice(lo, 256).columns), strict=True) for lo in range(0, b.num_rows, 256)):
                    if not offset:
                        head = _member(_info(archive, date))
                        out.write(head)
                        offset = len(head)
                    member = _member(_record(*r, date))
                    out.write(member)
                    rows.append((r[0], r[1], r[3], r[4], f"{folder}/{archive}", offset, len(member)))
                    offset += len(member)
                yield _columns(rows, *_layout(INDEX_SCHEMA))

    index = written(records.select("page_id", "url", "html", "digest", "record_type", "refers_to", "refers_url").mapInArrow(task, INDEX_SCHEMA))
    drop_later(index, folder)
    return index


def read_records(index: DataFrame, span: int = SPAN_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records of the index rows given: ``page_id, url, record_type, refers_to, header_digest, payload`` (null: revisit)."""

    def runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Rows (archive, offset, length) in order, grouped into ranges to read at once."""
        run: list[tuple] = []
        for r in rows:
            if run and (r[0] != run[0][0] or r[1] > run[-1][1] + run[-1][2] + gap or r[1] + r[2] > run[0][1] + span):
                yield run
                run = []
            run.append(r)
        if run:
            yield run

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        rows = itertools.chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for b in batches)
        for archive, own in itertools.groupby(runs(rows), key=lambda run: run[0][0]):
            store, path = FileSystem.from_uri(archive)
            with store.open_input_file(path) as file:
                for run in own:
                    start = run[0][1]
                    data = memoryview(file.read_at(run[-1][1] + run[-1][2] - start, start))
                    yield _columns([_parsed(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in run], *_layout(RECORD_SCHEMA))

    #: A number of tasks that follows the bytes to read: index rows are small, and by their own size would end up in a few.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(size // span + 1, min(index.sparkSession.sparkContext.defaultParallelism, size // MIN_READ + 1))
    return index.withColumn("_span", F.expr(f"offset div {min(span, MIN_READ)}")).repartition(tasks, "archive", "_span").sortWithinPartitions("archive", "offset").select("archive", "offset", "length").mapInArrow(task, RECORD_SCHEMA)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages, read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest come from the payloads read; a revisit's from the response it
    refers to. A null html is an empty payload, a null url leaves its field out. Rows
    with the largest page id of their payload are all responses, also when the row is
    repeated; a null page id is never the largest. An empty table gives no rows. Only
    the three columns are read.
    """
    index = write_archives(planned(pages, page_id, url, html))
    read = read_records(index).select("page_id", "record_type", "refers_to", "header_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    read = written(read)
    whole = read.where("record_type = 'response'")
    bad = whole.where("header_digest <> payload_digest").limit(1).count()
    if bad:
        raise ValueError("a payload read back doesn't have the digest of its record")
    target = whole.groupBy("page_id", "payload_digest", "payload_bytes").count().select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    again = read.where("record_type = 'revisit'").join(target, (F.col("refers_to") == F.col("_page")) & (F.col("header_digest") == F.col("_digest")), "left")
    drop(index)
    again = again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again)
