"""Web archives as a table of chunks: payloads of any size go in and come out in pieces.

A payload is a run of rows ``(record, chunk_no, content)`` of at most ``CHUNK`` bytes. Writers and readers hold one
such piece at a time; the digest is carried from piece to piece, so a record is never put together in Python.
Equal payloads are stored once: the record of least key is a ``response``, the others are ``revisit`` records.

Archives are WARC 1.1, each record a gzip member of its own. A task writes files under names that no other attempt
uses and returns their names; only names in the written list are read, so what a lost executor left behind is ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resonance.llm.support import shuffles_dropped
from resonance.sources.scratch import scratch_path, written

#: Bytes of a chunk; shorter payloads than this many bytes are always stored; bytes at which a file is full.
CHUNK, LEAST, FILE_BYTES = 1 << 18, 100, 256 << 20
#: Bytes read from a file at once, and of content sent to Spark at once.
READ, BATCH_BYTES = 1 << 18, 4 << 20

# Fixed values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, BLOCK_TYPE = b"\r\n\r\n", "application/http;msgtype=response"

CHUNKS = ("record_id string, record_type string, record_key string, uri string, refers_to_id string, stated_digest string, "
          "chunk_no long, payload_bytes long, payload_digest string, last boolean, content binary")
FILES = "path string, part int, n_records long, n_bytes long"


#: Rows that Spark hands to Python together, and how many of them while chunks are written (64 MB at most).
ROWS, CHUNK_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256


@contextmanager
def few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand at most ``CHUNK_ROWS`` rows to Python at once."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(CHUNK_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def record_id(key: Column, digest: Column) -> Column:
    """A URN made from a record's key and payload digest: the same for whoever knows both."""
    h = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """``record_id, record_key, uri, digest, n_bytes, refers_to_id, payload`` of every row.

    ``refers_to_id`` names the record of least key with the same payload (null for that one, and for payloads below
    ``LEAST`` bytes); rows that refer have no payload. A null payload is empty. Rows that repeat both key and payload
    are equal records; without a key a row refers to one that has a key, if there is one. Least keys are found before
    the shuffle where they can be; Spark splits a payload that very many rows share.
    """
    content = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    row = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{uri}`").cast("string").alias("uri"), content.alias("payload"))
    row = row.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    first = row.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.min("key").alias("first"))
    # Every row with a long payload finds its digest; short ones need not travel.
    long = row.where(F.col("n_bytes") >= LEAST).join(first, "digest")
    both = long.unionByName(row.where(F.col("n_bytes") < LEAST).withColumn("first", F.col("key")))
    refers = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    return both.select(
        record_id(F.col("key"), F.col("digest")).alias("record_id"), F.col("key").cast("string").alias("record_key"), "uri",
        "digest", "n_bytes", F.when(refers, record_id(F.col("first"), F.col("digest"))).alias("refers_to_id"),
        F.when(~refers, F.col("payload")).alias("payload"),
    )


def in_chunks(rows: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """Each row as rows of ``chunk_no, last, content``, one after another; an empty or null payload is one empty chunk."""
    length = F.coalesce(F.octet_length(payload), F.lit(0))
    last = F.floor(F.greatest(length - 1, F.lit(0)) / size).cast("long")
    whole = F.coalesce(F.col(payload), F.lit(b""))
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda i: F.struct(i.alias("chunk_no"), (i == last).alias("last"),
                           F.substring(whole, (i * size + 1).cast("int"), F.lit(size)).alias("content")),
    )
    others = [c for c in rows.columns if c != payload]
    return rows.select(*others, F.inline(pieces))


def _one_line(text: str) -> str:
    """A header value: line ends and other control characters are escaped as in URLs."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def _header(fields: list[tuple[str, str | None]], length: int) -> bytes:
    lines = [VERSION, *[f"{k}: {_one_line(v)}" for k, v in fields if v is not None], f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + END


class Archive:
    """The files one task writes: a record at a time, a chunk at a time."""

    def __init__(self, folder: str, part: int, date: str):
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.part, self.date = folder, part, date
        self.out, self.files = None, []

    def open(self) -> None:
        name = f"part-{self.part:05d}-{uuid.uuid4().hex}.warc.gz"
        self.out = self.store.open_output_stream(f"{self.base}/{name}", compression=None)
        self.files.append([f"{self.folder}/{name}", self.part, 0, 0])
        info = b"format: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date),
                  ("Content-Type", "application/warc-fields")]
        self.begin(_header(fields, len(info)) + info)
        self.end()
        self.files[-1][2] = 0

    def begin(self, first: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(first)

    def put(self, piece: bytes) -> None:
        small = self.member.compress(piece)
        self.files[-1][3] += len(small)
        self.out.write(small)

    def end(self) -> None:
        small = self.member.compress(END) + self.member.flush()
        self.out.write(small)
        self.files[-1][2] += 1
        self.files[-1][3] += len(small)

    def record(self, row: dict) -> None:
        """Begin a record: all that stands before its payload."""
        if self.out is None or self.files[-1][3] >= FILE_BYTES:
            self.close()
            self.open()
        refers, n = row["refers_to_id"], row["n_bytes"]
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
        fields = [
            ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Date", self.date), ("WARC-Target-URI", row["uri"]), ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
            ("WARC-Record-Key", row["record_key"]), ("Content-Type", BLOCK_TYPE),
            *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")] if refers else []),
        ]
        self.begin(_header(fields, len(http) + (0 if refers else n)) + http)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of :func:`records` as archives under ``folder``; ``path, part, n_records, n_bytes`` of each file.

    ``folder`` is an absolute path or a URI that pyarrow can open where the tasks run (file, hdfs, s3, gs). The job
    runs here, once; the list it returns is itself written. No rows: no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, TaskContext.get().partitionId(), date)
        for batch in batches:
            names = [c for c in batch.schema.names if c != "content"]
            about = batch.select(names).to_pylist()
            content = batch.column("content")
            for i, row in enumerate(about):
                if row["chunk_no"] == 0:
                    archive.record(row)
                archive.put(content[i].as_py())
                if row["last"]:
                    archive.end()
        archive.close()
        columns = zip(*archive.files) if archive.files else [[], [], [], []]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                         names=["path", "part", "n_records", "n_bytes"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with few_rows_at_once(rows.sparkSession), shuffles_dropped(rows.sparkSession):
        return written(in_chunks(rows).mapInArrow(write, FILES), "archive-files")


class Stream:
    """Bytes of an archive in reading order, unpacked member by member if it is packed."""

    def __init__(self, raw):
        self.raw, self.buffer, self.ended = raw, b"", False
        first = raw.read(READ)
        self.unpack = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        self.rest = first
        if self.unpack is None:
            self.buffer, self.rest = first, b""

    def fill(self) -> bool:
        """Add some bytes to the buffer; False at the end."""
        while not self.ended:
            if self.unpack is None:
                piece = self.raw.read(READ)
                self.ended = not piece
            else:
                packed = self.rest or self.raw.read(READ)
                if not packed:
                    self.ended = True
                    break
                if self.unpack.eof:
                    self.unpack = zlib.decompressobj(31)
                # At most READ bytes at once, however well they are packed.
                piece = self.unpack.decompress(packed, READ)
                self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if piece:
                self.buffer += piece
                return True
        return False

    def line(self) -> bytes:
        """The next line without its end; what is left at the end of the file."""
        while (at := self.buffer.find(b"\n")) < 0 and self.fill():
            pass
        at = len(self.buffer) if at < 0 else at
        out, self.buffer = self.buffer[:at], self.buffer[at + 1:]
        return out.rstrip(b"\r")

    def some(self, most: int) -> bytes:
        """Between 1 and ``most`` bytes; none at the end of the file."""
        if not self.buffer:
            self.fill()
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out

    def over(self) -> bool:
        return not self.buffer and not self.fill()


def _fields(stream: Stream) -> dict[str, str]:
    """Header lines up to an empty one, by lower-case name; a line that begins with a blank continues the one before."""
    found, name = {}, None
    while line := stream.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    return found


def read_stream(raw, path: str, content: bool = False) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` of one archive. A damaged record is an error that names file and record."""
    stream = Stream(raw)
    while not stream.over():
        line = stream.line()
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record begins with {line[:40]!r}")
        head = _fields(stream)
        kind, name = head.get("warc-type"), head.get("warc-record-id", "").strip("<>")
        left = int(head["content-length"])
        if "application/http" in head.get("content-type", ""):
            # The payload is what follows the header of the answer.
            while left > 0:
                before = len(stream.buffer)
                while b"\n" not in stream.buffer and stream.fill():
                    before = len(stream.buffer)
                line = stream.line()
                left -= before - len(stream.buffer)
                if not line:
                    break
        digest, n, chunk_no = hashlib.sha256(), 0, 0
        stated = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        about = (name, kind, head.get("warc-record-key"), head.get("warc-target-uri"),
                 head.get("warc-refers-to", "").strip("<>") or None, stated)
        held: list[bytes] = []
        size = 0
        while True:
            piece = stream.some(min(left, CHUNK - size)) if left else b""
            if left and not piece:
                raise ValueError(f"{path}: record {name} ends {left} bytes early")
            left -= len(piece)
            size += len(piece)
            digest.update(piece)
            held.append(piece)
            if not left or size == CHUNK:
                n += size
                if not left and kind == "response" and stated and stated != digest.hexdigest():
                    raise ValueError(f"{path}: the payload of record {name} does not have its digest")
                yield (*about, chunk_no, n, digest.hexdigest(), not left, b"".join(held) if content else None)
                held, size, chunk_no = [], 0, chunk_no + 1
                if not left:
                    break


def read_archives(files: DataFrame, content: bool = False) -> DataFrame:
    """The chunk table of archives: one row per chunk, with the payload's bytes and digest so far.

    ``files`` has ``path`` and ``part``; the files of a part are read by one task. A record's last chunk carries the
    digest and length of its whole payload; a damaged record is an error. Records of all types come out. With
    ``content`` the chunks' bytes come too.
    """
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inside = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(inside, compression=None) as raw:
                    for row in read_stream(raw, path, content):
                        rows.append(row)
                        size += len(row[-1] or b"") + 400
                        if size >= BATCH_BYTES:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    parts = (files.agg(F.max("part")).first()[0] or 0) + 1
    return files.select("path", "part").repartitionById(parts, F.col("part")).mapInArrow(read, CHUNKS)


def resolved(chunks: DataFrame) -> DataFrame:
    """``record_key, payload_bytes, payload_digest, record_type, refers_to_key`` of every response and revisit.

    A revisit has the payload of the record it refers to, whose digest must be the one the revisit states; a revisit
    of a record that is not there is an error too.
    """
    whole = chunks.where("last")
    responses = whole.where("record_type = 'response'")
    kept = responses.groupBy("record_id").agg(
        *[F.max(c).alias(f"r_{c}") for c in ("record_key", "payload_bytes", "payload_digest")]
    ).withColumnRenamed("record_id", "r_id")
    revisits = whole.where("record_type = 'revisit'").join(kept, F.col("refers_to_id") == F.col("r_id"), "left")
    same = F.col("r_payload_digest").eqNullSafe(F.col("stated_digest"))
    digest = F.when(same, F.col("r_payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("revisit of another payload: "), F.col("record_id"))))
    return responses.select("record_key", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("string").alias("refers_to_key")).unionByName(
        revisits.select("record_key", F.col("r_payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"),
                        "record_type", F.col("r_record_key").alias("refers_to_key")))


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Archives of ``pages`` written to the shared folder and read back: one row per page, see :func:`resolved`.

    Keys come back in the type they had. Nulls: see :func:`records`. An empty table gives no archive and no rows.
    """
    spark: SparkSession = pages.sparkSession
    kind = dict(pages.dtypes)[key]
    files = write_archives(records(pages, key, uri, payload), scratch_path(spark, "archives"))
    back = resolved(written(read_archives(files).drop("content"), "archive-records"))
    return back.select(F.col("record_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to_key").cast(kind).alias("refers_to"))
