"""WARC archives: write pages as records, give every record of a gzipped archive a gzip member of its own, index and read them.

``write_archives`` writes one record a page. Of the records with equal payloads (by SHA-256) of at least ``least`` bytes the one
with the smallest page_id is a response, the others are revisits that name it and hold no payload. Digests that occur more than
once are marked in a bit table of fixed size; pages whose digest is not marked, and revisits, are written without moving any text.
Spark's text writer ends every row by the record separator and compresses each file as a whole, so an archive is one gzip stream
that can only be read from its start: the form that ``normalise`` mends.

``normalise`` reads each such file once, as a stream: Spark inflates it, lines come in order, and a parser that follows
Content-Length puts records together from them (a line end within a payload stays what it was). Each record is compressed as a
member of its own. Members are collected in volumes of about ``VOLUME`` bytes, with a sidecar index of (volume, offset, length) a
record; both leave the task in one write. Volumes are written by Spark's text writer, too, whose rows end by a separator: a member
ends by the high byte of its record's size, zero below 16 MiB, so the separator is that zero; a larger record is followed by an
empty member, which ends by zero. Volumes are plain concatenations of members that any gzip reader takes, written by Spark's
commit protocol to any file system, without file handles in the tasks. ``read_volumes`` inflates member by member; ``lookup`` reads the members of given
records by offset.

Nulls: a null html is an empty payload; a null page_id is the largest and an empty number in the record's id; a null url is left
out. Payloads may hold separators, headers, control characters and be of any length a text can have. Repeated rows with the
smallest page_id are responses all. An empty table gives archives without records. Other columns are ignored. A file that ends
within a record, or whose payload does not have its digest, raises an error that names the file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import spread_join
from palisade.llm.tables import marked
from palisade.session import cut_lineage, scratch_path

END = "\r\n\r\n"
LEAST = 100
VOLUME = 8 << 20
PIECE = 1 << 20  # inflated at a time
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_ID = re.compile(rb"<urn:page:(-?\d*)>")
INDEX = "record_id string, record_type string, offset bigint, length bigint"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))


def _url() -> Column:
    """A header value holds no line ends."""
    plain = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(F.col("url").isNull(), "").otherwise(_line("WARC-Target-URI", plain))


def _record(kind: str, date: str, block: Column, *more: Column) -> Column:
    """A record without the separator that ends it."""
    head = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), _line("WARC-Record-ID", _urn("page_id")), _line("WARC-Date", F.lit(date)), _url(),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), *more,
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n")]
    return F.concat(*head, block)


def archive_records(pages: DataFrame, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record): the text of a record per page, responses and revisits decided."""
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("bigint"))
    long = src.where(F.col("bytes") >= least)
    firsts = cut_lineage(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n"))
    known = marked(firsts.select(F.xxhash64("digest").alias("key")))
    candidate = (F.col("bytes") >= least) & known(F.xxhash64("digest"))
    told = src.where(candidate)
    # Revisits are found without their texts; texts with a marked digest are dealt by (digest, page_id), which no copies share.
    narrow = spread_join(told.select("page_id", "url", "digest", "bytes"), firsts, "digest")
    revisits = cut_lineage(narrow.where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))))
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    kept = told.join(gone, (F.col("digest") == F.col("gone_digest")) & F.col("page_id").eqNullSafe(F.col("gone_id")), "left_anti")
    responses = src.where(~candidate).unionByName(kept)
    http = F.lit(HTTP)
    return responses.select(_record("response", date, F.concat(http, F.col("html"))).alias("record")).unionByName(
        revisits.select(_record(
            "revisit", date, http, _line("WARC-Payload-Length", F.col("bytes").cast("string")), _line("WARC-Refers-To", _urn("first")),
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).alias("record")))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives at ``path``, each one gzip stream."""
    archive_records(pages, least, date).write.option("compression", "gzip").option("lineSep", END).text(path)


class RecordStream:
    """Records of one archive from pieces of its text."""

    def __init__(self, name: str) -> None:
        self.name, self.held, self.size = name, [], 0
        self.wanted = 0  # bytes without which looking again is useless

    def add(self, data: bytes) -> Iterator[bytes]:
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.wanted:
            yield from self._take()

    def _take(self) -> Iterator[bytes]:
        data, at = b"".join(self.held), 0
        while True:
            while data[at : at + 2] == b"\r\n":  # blank lines between records
                at += 2
            stop = data.find(b"\r\n\r\n", at)
            if stop < 0:
                self.wanted = 0
                break
            if not data.startswith(b"WARC/", at):
                raise ValueError(f"{self.name}: no record where one should begin")
            end = stop + 4 + int(header(data[at : stop + 2], b"content-length", self.name))
            if len(data) < end:
                self.wanted = end - at
                break
            yield data[at:end]
            at = end
        self.held, self.size = [data[at:]], len(data) - at

    def close(self) -> None:
        rest = b"".join(self.held)
        if rest.strip(b"\r\n"):
            raise ValueError(f"{self.name}: ends within a record")


def header(head: bytes, name: bytes, where: str, absent: bytes | None = None) -> bytes:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    if absent is None:
        raise ValueError(f"{where}: a record without {name.decode()}")
    return absent


def member_of(record: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    member = gzip.compress(record + END.encode(), 6, mtime=0)
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def normalised(spark: SparkSession, path: str, volume_bytes: int = VOLUME) -> DataFrame:
    """(kind, volume, offset, value): per record of the archives at ``path`` its gzip member and its line of the index.

    A member lacks its last byte, the zero that the text writer adds behind a row.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, base, volume, offset = None, "", 0, 0
        rows: list[tuple] = []
        held = 0

        def add(record: bytes) -> None:
            nonlocal volume, offset, held
            if offset >= volume_bytes:
                volume, offset = volume + 1, 0
            head = record[: record.index(b"\r\n\r\n") + 2]
            member = member_of(record)
            about = {"record_id": header(head, b"warc-record-id", stream.name).decode(), "record_type": header(head, b"warc-type", stream.name).decode(),
                     "offset": offset, "length": len(member)}
            rows.append((f"{base}-{volume:06d}", offset, member[:-1], json.dumps(about).encode()))
            offset, held = offset + len(member), held + len(member)

        def flush() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_pydict({
                "kind": pa.array(["members"] * len(rows) + ["index"] * len(rows)), "volume": pa.array([r[0] for r in rows] * 2, pa.string()),
                "offset": pa.array([r[1] for r in rows] * 2, pa.int64()), "value": pa.array([r[2] for r in rows] + [r[3] for r in rows], pa.binary())})
            rows.clear()
            held = 0
            return out

        for batch in batches:
            files, values = batch.column("file").to_pylist(), batch.column("value").to_pylist()
            starts = [i for i in range(len(files)) if not i or files[i] != files[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(files)], strict=True):
                file = files[a]
                if stream is None or stream.name != file:
                    if stream:
                        stream.close()
                    stream, volume, offset = RecordStream(file), 0, 0
                    base = re.sub(r"[^A-Za-z0-9-]", "-", file.rsplit("/", 1)[-1]) + "-" + hashlib.md5(file.encode()).hexdigest()[:8]
                for record in stream.add(b"\n".join(values[a:b]) + b"\n"):
                    add(record)
                    if held > PIECE:
                        yield flush()
        if rows:
            yield flush()
        if stream:
            stream.close()

    return lines.mapInArrow(task, "kind string, volume string, offset bigint, value binary")


def normalise(spark: SparkSession, path: str, to: str, volume_bytes: int = VOLUME) -> None:
    """Volumes at ``to``/kind=members and their sidecar index at ``to``/kind=index, from the archives at ``path``.

    One pass and one write without a shuffle: a volume comes from one task, whose rows are sorted into the writer's order.
    """
    made = normalised(spark, path, volume_bytes).sortWithinPartitions("kind", "volume", "offset")
    made.select("kind", "volume", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "volume").option(
        "lineSep", "\0").option("compression", "none").text(to)


def _volume_of(path: str) -> Column:
    return F.regexp_extract(path, r"volume=([^/]+)/", 1).alias("volume")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(volume, record_id, record_type, offset, length) per record."""
    lines = spark.read.option("lineSep", "\0").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    rows = lines.select("value", F.col("_metadata.file_path").alias("path")).where(F.contains("path", F.lit("/kind=index/")))
    return rows.select(_volume_of("path"), F.from_json("value", INDEX).alias("r")).select("volume", "r.*")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(volume, content) of the volumes, whose size is bounded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.where(F.contains("path", F.lit("/kind=members/"))).select(_volume_of("path"), "content")


def parsed(data: bytes, where: str) -> dict:
    """A record's fields; the payload's digest is computed anew and held against the header's."""
    stop = data.index(b"\r\n\r\n") + 2
    head, body = data[:stop], data[stop + 2 : len(data) - len(END)]
    page = lambda name: (m := RECORD_ID.fullmatch(header(head, name, where, b""))) and (int(m[1]) if m[1] else None)
    kind = header(head, b"warc-type", where).decode()
    digest = header(head, b"warc-payload-digest", where).decode().removeprefix("sha256:")
    out = {"page_id": page(b"warc-record-id"), "record_type": kind, "refers_to": page(b"warc-refers-to") if kind == "revisit" else None,
           "payload_digest": digest, "payload": None}
    if kind == "revisit":
        return out | {"payload_bytes": int(header(head, b"warc-payload-length", where))}
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{where}: a payload without its digest")
    return out | {"payload_bytes": len(payload), "payload": payload}


def inflated(content: bytes, at: int, where: str) -> tuple[bytes, int]:
    """The record of the member at an offset, and the offset after it; an empty member behind it belongs to it."""
    inflate, out = zlib.decompressobj(31), []
    while not inflate.eof:
        piece = content[at : at + PIECE]
        if not piece:
            raise ValueError(f"{where}: ends within a member")
        out.append(inflate.decompress(piece))
        at += len(piece) - len(inflate.unused_data)
    if content[at : at + len(EMPTY_MEMBER)] == EMPTY_MEMBER:
        at += len(EMPTY_MEMBER)
    return b"".join(out), at


RECORD = "volume string, offset bigint, length bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


def _batch(rows: list[dict], payload: bool) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    out = {c: pa.array([r[c] for r in rows], kinds[t]) for c, t in (f.split() for f in RECORD.split(", "))}
    if payload:
        out["payload"] = pa.array([r["payload"] for r in rows], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def read_volumes(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every record of the volumes, member by member; ``payload`` adds the response's bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for volume, content in zip(batch.column("volume").to_pylist(), batch.column("content"), strict=True):
                data, at, rows, held = content.as_py(), 0, [], 0
                while at < len(data):
                    record, after = inflated(data, at, volume)
                    rows.append(parsed(record, volume) | {"volume": volume, "offset": at, "length": after - at})
                    at, held = after, held + len(record)
                    if held > PIECE:
                        yield _batch(rows, payload)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payload)

    return _files(spark, path).mapInArrow(task, RECORD + (", payload binary" if payload else ""))


def lookup(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """The records of the given ids (column record_id) with their payloads, read at the index's offsets."""
    wanted = read_index(spark, path).join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    # A volume holds a bounded number of members, so a list a volume is bounded.
    spots = wanted.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("spots"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for volume, content, places in zip(batch.column("volume").to_pylist(), batch.column("content"), batch.column("spots").to_pylist(), strict=True):
                data = content.as_py()
                for p in places:
                    member = data[p["offset"] : p["offset"] + p["length"]]
                    yield _batch([parsed(inflated(member, 0, volume)[0], volume) | {"volume": volume, **p}], True)

    return _files(spark, path).join(spots, "volume").mapInArrow(task, RECORD + ", payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written, normalised and read back."""
    spark = pages.sparkSession
    written, to = scratch_path(spark, "warc"), scratch_path(spark, "warc-members")
    write_archives(pages, written, least)
    normalise(spark, written, to)
    return read_volumes(spark, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
