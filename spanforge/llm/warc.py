"""WARC archives of web pages: written as monolithic gzip, normalised, read back by offset.

Tasks write archives whose records share one gzip stream, and report every record they
wrote.  Payload digests, narrow rows, decide which record of each group of equal payloads
stays a response.  The normaliser then inflates each archive once as a stream, rewrites
every record as a gzip member of its own (a response, or a revisit of another record) and
writes a sidecar index of offsets.  Readers go through the index to single members.
Pages never cross a shuffle; only digests and offsets do.

Files are opened with ``pyarrow.fs`` at the addresses of shared storage (local paths and
``file:``, and what else that library opens, as S3, GCS or HDFS).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.stage import HEAVY_ROWS, materialize, sized_broadcast
from spanforge.sources.shared import folder

#: An archive is closed after so many bytes of records, or so many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 200_000
#: Bytes inflated, copied or read at once.
CHUNK = 1 << 20
#: Bytes of an archive that one task reads back.
READ_BLOCK = 64 << 20
LEVEL = 6
#: Longest header block of a record.
HEADER_LIMIT = 16 << 20
DATE = "2024-01-01T00:00:00Z"
#: The extension field that holds a page's id.
SOURCE_FIELD = "Source-Row-ID"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string"


def digest_of(sha1: "hashlib._Hash") -> str:
    return base64.b32encode(sha1.digest()).decode()


def _plain(value: str) -> str:
    """A header value on one line: blanks, control characters and the percent sign are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c in "%\x7f" else c for c in value)


def _unplain(value: str) -> str:
    head, *rest = value.split("%")
    return head + "".join(chr(int(r[:2], 16)) + r[2:] for r in rest)


def _header(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def _response(record_id: str, page_id: str | None, url: str | None, digest: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Date": DATE}
    if url is not None:
        # An address in a record is percent-encoded where a line could not hold it.
        fields["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)
    if page_id is not None:
        fields[SOURCE_FIELD] = _plain(page_id)
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(http) + len(payload))}
    return _header(fields) + http + payload + b"\r\n\r\n"


def _info(record_id: str) -> bytes:
    block = b"software: spanforge\r\nformat: WARC File Format 1.1\r\n"
    return _header({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id, "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}) + block + b"\r\n\r\n"


def _record_id(name: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{name}#{nth}'.encode()).digest())}>"


def _open(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


class _Sink:
    """A file that takes its place under its name when it is whole; a retry replaces it."""

    def __init__(self, address: str) -> None:
        self.fs, self.path = _open(address)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.part, self.path)


def write_monolithic(pages: DataFrame, at: str, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Archives below ``at``, each one gzip stream; one row per record: page_id, archive, nth, record_id, digest, size.

    A task attempt names its own archives; those of an attempt that failed are in no row.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(id_col).cast("string").alias("id_text"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held, nth, name = None, 0, 0, ""

        def shut() -> None:
            if sink is not None:
                sink.write(packer.flush())
                sink.close()

        for batch in batches:
            told: list[tuple[str, int, str, str, int]] = []
            for page, url, payload in zip(batch.column("id_text").to_pylist(), batch.column("url").to_pylist(), batch.column("payload")):
                if sink is None or held >= ARCHIVE_BYTES or nth > ARCHIVE_RECORDS:
                    shut()
                    name, held, nth = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 1
                    sink, packer = _Sink(name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    sink.write(packer.compress(_info(_record_id(name, 0))))
                body = payload.as_buffer().to_pybytes()
                digest, record_id = digest_of(hashlib.sha1(body)), _record_id(name, nth)
                record = _response(record_id, page, url, digest, body)
                sink.write(packer.compress(record))
                held += len(record)
                told.append((name, nth, record_id, digest, len(body)))
                nth += 1
            if told:
                columns = [pa.array(list(c)) for c in zip(*told)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", "archive", "nth", "record_id", "digest", "size"])
        shut()

    kind = rows.schema["page_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(write, f"page_id {kind}, archive string, nth long, record_id string, digest string, size long"), "warc-records")


def join_unique(rows: DataFrame, table: DataFrame, on: str, name: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once and the number ``n`` of its rows.

    Rows of a key with many rows meet it by broadcast (such keys are few and counted), and
    only the other rows are shuffled by the key.  Rows without a partner go.
    """
    heavy = materialize(table.filter(F.col("n") >= HEAVY_ROWS), name)
    n_heavy = heavy.count()
    light = table.filter(F.col("n") < HEAVY_ROWS)
    if not n_heavy:
        return rows.join(light, on)
    hot = sized_broadcast(heavy, n_heavy)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(light, on))


def revisits(records: DataFrame, least_bytes: int) -> DataFrame:
    """(archive, nth, refers_to): records that revisit the first with their payload, by page id (null last), archive and place."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "nth", "record_id")
    groups = records.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = join_unique(records.select("digest", "archive", "nth", "record_id"), materialize(groups.select("digest", F.col("first.record_id").alias("refers_to"), "n"), "warc-groups"), "digest", "warc-heavy")
    return met.filter("record_id <> refers_to").select("archive", "nth", "refers_to")


class _Stream:
    """The inflated bytes of an archive, of one member or of many, a chunk at a time."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.inflate, self.raw = file, zlib.decompressobj(47), b""
        self.have, self.at = b"", 0

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(47)
            out = self.inflate.decompress(self.raw, CHUNK)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if out:
                self.have, self.at = self.have[self.at :] + out, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the archive."""
        seen = 0
        while (end := self.have.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.have) - self.at
            if seen > HEADER_LIMIT or not self.more():
                if self.have[self.at :].strip():
                    raise ValueError("an archive ends inside a header, or has one without end")
                return None
        out = self.have[self.at : end + len(mark)]
        self.at = end + len(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.have) and not self.more():
                raise ValueError("an archive ends inside a record")
            out = self.have[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """The version line and the named fields; a continued line belongs to the field above it."""
    first, *lines = head.decode("utf-8", "surrogateescape").strip("\r\n").split("\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip(" \t")
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip(" \t")
            fields[name] = value.strip(" \t")
    return first, fields


def _records(stream: _Stream) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(fields, block) of every record; what is left of a block is skipped before the next record."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, fields = _fields(head.lstrip(b"\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts with {version[:40]!r}")
        block = stream.take(int(fields.get("Content-Length", 0)))
        yield fields, block
        for _ in block:
            pass
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _split_http(block: Iterator[bytes]) -> tuple[bytes, Iterator[bytes]]:
    """The header of an HTTP message, and its payload in chunks."""
    head = b""
    for chunk in block:
        head += chunk
        if (at := head.find(b"\r\n\r\n")) >= 0:
            rest = head[at + 4 :]
            return head[: at + 4], (c for part in ([rest], block) for c in part)
    return head, iter(())


def rewrite(source: str, target: str, refers_to: dict[int, str]) -> list[dict]:
    """One archive normalised: a member a record, the sidecar beside it; returns the index entries.

    The ``nth`` record becomes a revisit where ``refers_to`` names one: its payload goes,
    its digest stays.
    """
    system, path = _open(source)
    sink, entries = _Sink(target), []
    with system.open_input_stream(path, compression=None) as file:
        for nth, (fields, block) in enumerate(_records(_Stream(file))):
            offset, packer = sink.size, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            if nth in refers_to:
                http, _ = _split_http(block)
                fields = fields | {"WARC-Type": "revisit", "WARC-Profile": IDENTICAL, "WARC-Refers-To": refers_to[nth], "Content-Length": str(len(http))}
                block_out: Iterator[bytes] = iter([http])
            else:
                block_out = block
            head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
            sink.write(packer.compress(head.encode("utf-8", "surrogateescape")))
            for chunk in block_out:
                sink.write(packer.compress(chunk))
            sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
            entries.append({"archive": target, "offset": offset, "length": sink.size - offset, "record_id": fields.get("WARC-Record-ID"), "record_type": fields.get("WARC-Type")})
    sink.close()
    index = _Sink(f"{target}.idx")
    index.write("".join(json.dumps(e) + "\n" for e in entries).encode())
    index.close()
    return entries


def normalise(archives: DataFrame, to: str) -> int:
    """Normalise ``archives`` (archive, and changes: array of (nth, refers_to), or null) into the folder ``to``; how many there were.

    An archive is one task's stream.  Its new name follows from the old one, so a retry
    writes the same file again and the folder holds each archive once.
    """
    n = archives.count()
    if not n:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                changes = {c["nth"]: c["refers_to"] for c in row["changes"] or ()}
                made = rewrite(row["archive"], f"{to}/{row['archive'].rpartition('/')[2]}", changes)
                yield pa.RecordBatch.from_pydict({"records": pa.array([len(made)], pa.int64())})

    dealt = archives.select("archive", "changes").repartitionByRange(n, "archive")
    dealt.mapInArrow(run, "records long").agg(F.sum("records")).collect()
    return n


def read_records(spark: SparkSession, at: str, payloads: bool = False) -> DataFrame:
    """Records of the normalised archives below ``at``, by their indexes: record_id, record_type, page_id (text),
    target_uri, refers_to (a record), payload_digest, payload_bytes, payload (null unless asked for).

    A response's digest is computed from the payload that was read and must be the one its
    header names.  A revisit has the digest of its header and no length.
    """
    index = spark.read.schema(INDEX_SCHEMA).json(f"{at}/*.idx").filter(F.col("record_type").isin("response", "revisit"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = index.repartition(parts, "archive", F.expr(f"offset div {READ_BLOCK}")).sortWithinPartitions("archive", "offset")
    schema = pa.schema(
        [(c, pa.string()) for c in ("record_id", "record_type", "page_id", "target_uri", "refers_to", "payload_digest")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def member(file: pa.NativeFile, row: dict) -> dict:
        file.seek(row["offset"])
        stream = _Stream(pa.BufferReader(file.read(row["length"])))
        fields, block = next(_records(stream))
        told = (fields.get("WARC-Payload-Digest") or "").rpartition(":")[2] or None
        size = body = None
        if row["record_type"] == "response":
            sha1, size, kept = hashlib.sha1(), 0, []
            for chunk in _split_http(block)[1]:
                sha1.update(chunk)
                size += len(chunk)
                if payloads:
                    kept.append(chunk)
            if told is not None and told != digest_of(sha1):
                raise ValueError(f"payload of {fields.get('WARC-Record-ID')} is not the one its digest names")
            told, body = digest_of(sha1), b"".join(kept) if payloads else None
        page = fields.get(SOURCE_FIELD)
        return {
            "record_id": fields.get("WARC-Record-ID"), "record_type": row["record_type"], "page_id": None if page is None else _unplain(page), "target_uri": fields.get("WARC-Target-URI"),
            "refers_to": fields.get("WARC-Refers-To"), "payload_digest": told, "payload_bytes": size, "payload": body,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["archive"] != at:
                    if file is not None:
                        file.close()
                    system, path = _open(row["archive"])
                    at, file = row["archive"], system.open_input_file(path)
                out.append(member(file, row))
                held += len(out[-1]["payload"] or b"")
                if held >= 16 * CHUNK:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema)
        if file is not None:
            file.close()

    columns = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in schema)
    return near.mapInArrow(run, columns)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to`` as the page id of the response and the length of the full payload; one row per record."""
    records = materialize(records, "warc-read")
    again = records.filter("record_type = 'revisit'").drop("payload_bytes", "payload")
    counts = again.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    original = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"), "payload_bytes", "payload")
    met = join_unique(again, original.join(counts, "refers_to"), "refers_to", "warc-originals").drop("n")
    columns = [c for c in records.columns if c != "refers_to"]
    first = records.filter("record_type = 'response'").select(*columns, F.lit(None).cast("string").alias("refers_to"))
    return first.unionByName(met.select(*columns, F.col("first_page").alias("refers_to")))


def archive_pages(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at: str | None = None) -> str:
    """Write ``pages`` as normalised archives with sidecar indexes; the folder they are in (``at``, or a new one in shared storage).

    One record a row, repeated rows included.  A null payload is empty; a null address or
    id leaves its field out; an empty table gives an empty folder.  Of equal payloads of at
    least ``least_bytes`` bytes the one with the smallest id is the response (null ids
    last, then the order of records), the others revisit it.  Other columns are ignored.
    """
    spark = pages.sparkSession
    to, raw = at or folder(spark, "warc"), folder(spark, "warc-monolithic")
    records = write_monolithic(pages, raw, id_col, url_col, payload_col)
    changes = revisits(records, least_bytes).groupBy("archive").agg(F.collect_list(F.struct("nth", "refers_to")).alias("changes"))
    archives = materialize(records.select("archive").distinct().join(changes, "archive", "left"), "warc-archives")
    normalise(archives, to)
    return to


def page_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive ``pages`` and read them back: page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    if pages.isEmpty():
        text = F.lit(None).cast("string")
        return pages.select(F.col(id_col).alias("page_id"), text.alias("target_uri"), text.cast("long").alias("payload_bytes"), text.alias("payload_digest"), text.alias("record_type"), F.col(id_col).alias("refers_to"))
    read = resolve(read_records(spark, archive_pages(pages, least_bytes, id_col, url_col, payload_col)))
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "target_uri", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
