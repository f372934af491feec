"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.llm.common import stored
from seriesmith.session import scratch_path

#: Fixed values of the two formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
NO_ID = "none"

CHUNK = 1 << 16
MANIFEST = "path string, records long, bytes long"
RECORD = ("path string, position long, record_id string, record_type string, target string, refers_to string, "
          "declared_digest string, payload binary, error string")


class WarcError(ValueError):
    """A record or archive that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = field(default=b"")


def record_id(page_id) -> str:
    return f"<{ID_PREFIX}{NO_ID if page_id is None else page_id}>"


def digest_label(hex_digest: str) -> str:
    """Labelled digest: the algorithm and the digest in base 32, without padding."""
    return "sha256:" + base64.b32encode(bytes.fromhex(hex_digest)).decode().rstrip("=")


def digest_hex(label: str) -> str:
    name, _, text = label.partition(":")
    if name != "sha256":
        raise WarcError(f"unknown digest {name!r}")
    return base64.b32decode(text + "=" * (-len(text) % 8)).hex()


def _header_value(value: str) -> str:
    """A value on one line: control characters and spaces of a URL are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def encode_record(page_id, url, payload: bytes, hex_digest: str, refers_to, date: str) -> bytes:
    """A response record with its HTTP head and payload, or a revisit (``refers_to`` given) with the head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
               ("WARC-Date", date), ("WARC-Payload-Digest", digest_label(hex_digest)),
               ("WARC-Block-Digest", digest_label(hashlib.sha256(block).hexdigest())),
               ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _header_value(url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    headers.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """Split one record and check its version, required headers, lengths and digests."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("no end of headers")
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError(f"bad version line {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not re.fullmatch(r"[!#-'*+\-.0-9A-Z^-z|~]+", name):
            raise WarcError(f"bad header line {line[:40]!r}")
        headers[name.title()] = value.strip()
    get = lambda name: headers.get(name.title())
    for name in REQUIRED:
        if not get(name):
            raise WarcError(f"missing {name}")
    length = get("Content-Length")
    if not re.fullmatch(r"[0-9]+", length):
        raise WarcError(f"bad Content-Length {length!r}")
    if len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not match a record of {len(rest) - 4} bytes")
    block = rest[:-4]
    if (label := get("WARC-Block-Digest")) and digest_hex(label) != hashlib.sha256(block).hexdigest():
        raise WarcError("block digest differs")
    record = Record(headers, block)
    if (get("Content-Type") or "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise WarcError("HTTP block without end of headers")
        record.payload = payload
        size = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)\r?$", http)
        if get("WARC-Type") == "response":
            if size and int(size.group(1)) != len(payload):
                raise WarcError("HTTP Content-Length does not match the payload")
            if (label := get("WARC-Payload-Digest")) and digest_hex(label) != hashlib.sha256(payload).hexdigest():
                raise WarcError("payload digest differs")
    else:
        record.payload = block
    if get("WARC-Type") == "revisit" and not get("WARC-Refers-To"):
        raise WarcError("revisit without WARC-Refers-To")
    return record


def read_frames(stream) -> Iterator[bytes]:
    """Decompressed frames of an archive, one at a time; the stream is read in chunks.

    A leading skippable frame holds the dictionary, plain or itself compressed. Later skippable frames are skipped.
    """
    def take(n: int) -> bytes:
        nonlocal buffer
        while len(buffer) < n:
            more = stream.read(max(CHUNK, n - len(buffer)))
            if not more:
                break
            buffer += more
        part, buffer = buffer[:n], buffer[n:]
        return part

    buffer, first, decoder = b"", True, zstandard.ZstdDecompressor()
    while head := take(4):
        magic = int.from_bytes(head, "little")
        if len(head) < 4:
            raise WarcError("archive ends inside a frame")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(take(4), "little")
            content = take(size)
            if len(content) != size:
                raise WarcError("archive ends inside a skippable frame")
            if first and magic == DICTIONARY_MAGIC:
                try:
                    if content[:4] == FRAME_MAGIC.to_bytes(4, "little"):
                        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
                except zstandard.ZstdError as err:
                    raise WarcError(f"broken dictionary: {err}") from None
        elif magic == FRAME_MAGIC:
            frame, parts, data = decoder.decompressobj(), [], head + buffer
            buffer = b""
            while data:
                try:
                    parts.append(frame.decompress(data))
                except zstandard.ZstdError as err:
                    raise WarcError(f"broken frame: {err}") from None
                if frame.eof:
                    break
                data = stream.read(CHUNK)
            if not frame.eof:
                raise WarcError("archive ends inside a frame")
            buffer = frame.unused_data
            yield b"".join(parts)
        else:
            raise WarcError(f"unknown frame {magic:#x}")
        first = False


def archive_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on an archive's first records; their plain text where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class ArchiveWriter:
    """Writes archives of bounded size under a folder. Files of a failed attempt are never named in a manifest."""

    def __init__(self, folder: str, max_bytes: int, dictionary_bytes: int, sample_bytes: int, level: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.base = folder.rstrip("/")
        self.fs.create_dir(self.folder, recursive=True)
        self.max_bytes, self.dictionary_bytes, self.sample_bytes, self.level = (
            max_bytes, dictionary_bytes, sample_bytes, level)
        self.waiting, self.held, self.out, self.done = [], 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= self.sample_bytes:
                self._open()
            return
        self._write(record)

    def _open(self) -> None:
        content = archive_dictionary(self.waiting, self.dictionary_bytes)
        name = f"pages-{uuid.uuid4().hex}.warc.zst"  # each attempt has its own name
        self.out = self.fs.open_output_stream(f"{self.folder.rstrip('/')}/{name}", compression=None)
        packed = zstandard.ZstdCompressor(level=self.level).compress(content)
        self.out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.encoder = zstandard.ZstdCompressor(
            level=self.level, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
        self.path, self.records, self.bytes = f"{self.base}/{name}", 0, 8 + len(packed)
        waiting, self.waiting, self.held = self.waiting, [], 0
        for record in waiting:
            self._write(record)

    def _write(self, record: bytes) -> None:
        frame = self.encoder.compress(record)
        self.out.write(frame)
        self.records += 1
        self.bytes += len(frame)
        if self.bytes >= self.max_bytes:
            self._finish()

    def _finish(self) -> None:
        self.out.close()
        self.done.append((self.path, self.records, self.bytes))
        self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            self._finish()
        return self.done


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response; rows that repeat it with the
    same payload are responses too. A null page_id is the largest; if a group has no id, all its rows are responses.
    The smallest ids are pre-aggregated before the shuffle and only payloads that repeat are listed; the rows of a
    widely copied payload can be split by the skew join.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    repeated = (
        pages.filter(F.octet_length(payload) >= min_bytes).groupBy(digest.alias("__digest"))
        .agg(F.min("page_id").alias("__least"), F.count("*").alias("__n"))
        .filter("__n > 1").select("__digest", "__least")
    )
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("digest"))
    revisit = F.col("__least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__least"))
    return rows.join(repeated, F.col("digest") == F.col("__digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("__least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z",
                   max_bytes: int = 64 << 20, dictionary_bytes: int = 32 << 10, sample_bytes: int = 1 << 20,
                   level: int = 3) -> DataFrame:
    """Write (page_id, url, html) as archives and return their manifest (path, records, bytes).

    Tasks stream their records into files of about ``max_bytes``. The manifest is itself written down, so only files of
    committed attempts are named in it, whatever was repeated after a lost executor.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = ArchiveWriter(folder, max_bytes, dictionary_bytes, sample_bytes, level)
        for df in frames:
            for page, url, payload, digest, refers in df.itertuples(index=False, name=None):
                writer.add(encode_record(page, url, bytes(payload), digest, refers, date))
        yield pd.DataFrame(writer.close(), columns=["path", "records", "bytes"])

    # Ids travel as text: a missing one would turn the others into doubles.
    rows = with_revisits(pages, min_bytes).select(
        F.col("page_id").cast("string"), "url", "payload", "digest",
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit(f"<{ID_PREFIX}"), F.col("refers_to").cast("string"),
                                                       F.lit(">"))))
    return stored(rows.mapInPandas(run, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, strict: bool = True, keep_payload: bool = True) -> DataFrame:
    """Records of the archives named in ``manifest.path``, decoded one frame at a time.

    A record that breaks a check ends the read with its archive and position, or, with ``strict=False``, becomes a row
    with ``error``; a broken frame ends its archive. ``keep_payload=False`` leaves out payloads after their checks and
    adds nothing to the shuffles; digest and length columns are there in both cases.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for df in frames:
            for path in df["path"]:
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as stream:
                    rows, held = [], 0
                    for row in _records(path, stream, strict):
                        size = len(row["payload"])
                        row |= {"payload_bytes": size, "payload_digest": hashlib.sha256(row["payload"]).hexdigest()}
                        if not keep_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += size if keep_payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    schema = RECORD + ", payload_bytes long, payload_digest string"
    spark = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks, "path").mapInPandas(run, schema)


def _records(path: str, stream, strict: bool) -> Iterator[dict]:
    position = 0
    empty = {"record_id": None, "record_type": None, "target": None, "refers_to": None, "declared_digest": None}
    try:
        for data in read_frames(stream):
            row = {"path": path, "position": position, "payload": b"", "error": None, **empty}
            try:
                record = decode_record(data)
            except (WarcError, UnicodeDecodeError) as err:
                if strict:
                    raise WarcError(f"{path}, record {position}: {err}") from None
                yield row | {"error": str(err)}
            else:
                h = record.headers
                label = h.get("Warc-Payload-Digest")
                yield row | {
                    "record_id": h["Warc-Record-Id"], "record_type": h["Warc-Type"], "payload": record.payload,
                    "target": h.get("Warc-Target-Uri"), "refers_to": h.get("Warc-Refers-To"),
                    "declared_digest": digest_hex(label) if label else None}
            position += 1
    except WarcError as err:
        if strict:
            raise WarcError(f"{path}, after {position} records: {err}") from None
        yield {"path": path, "position": position, "payload": b"", "error": str(err), **empty}


def page_records(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, with revisits resolved.

    A revisit's payload is that of the response it refers to, found by a join on record ids; its declared digest must
    be that response's. Revisits of one widely copied page are narrow rows that the skew join can split.
    """
    number = lambda c: F.when(F.col(c) != f"<{ID_PREFIX}{NO_ID}>", F.regexp_extract(c, r"(-?\d+)>$", 1).cast("long"))
    responses = records.filter("record_type = 'response'")
    first = responses.groupBy(F.col("record_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(
        F.max("payload_bytes").alias("__bytes"))
    revisits = records.filter("record_type = 'revisit'").join(
        first, (F.col("refers_to") == F.col("__id")) & (F.col("declared_digest") == F.col("__digest")), "left")
    lost = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("record_id")))
    own = responses.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    other = revisits.select(
        number("record_id").alias("page_id"), F.when(F.col("__bytes").isNotNull(), F.col("__bytes")).otherwise(
            lost.cast("long")).alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type",
        number("refers_to").alias("refers_to"))
    return own.unionByName(other)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per page, read the archives back and return :func:`page_records` of them.

    Null html is an empty payload; null urls are left out of the headers; ids may be null or repeated; extra columns
    are ignored; an empty table gives no archive and an empty result.
    """
    manifest = write_archives(pages, folder or scratch_path(spark, "warc"))
    return page_records(stored(read_archives(manifest, keep_payload=False).drop("payload"), "records"))
