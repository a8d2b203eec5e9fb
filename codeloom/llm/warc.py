"""WARC archives in Zstandard frames, with the dictionary in a leading skippable frame.

Layout of an archive: one skippable frame (magic 0x184D2A5D) whose content is
the dictionary, itself a Zstandard frame; then one frame per record. A record
is a WARC/1.1 header block, the record block (an HTTP response) and two line
ends. The reader loads the dictionary, decodes one frame at a time and
validates the version line, the required headers, the block length, the HTTP
length and the block and payload digests; a fault raises ``WarcError`` that
names the archive and the byte offset. Archives are read as streams: a reader holds one record and a buffer.

Archives of others. ``read_records`` takes any WARC/1.0 or 1.1 archive of one Zstandard frame per record, with or
without a dictionary: all record types, any record ids, digests in MD5, SHA-1, SHA-256 or SHA-512, hexadecimal or
base 32; digests of another algorithm are returned unchecked. ``read_archives`` is for the pages written here.

Payloads of ``min_bytes`` or more that repeat are stored once: the smallest
record key holds the response, the others are revisits that keep the HTTP
headers (so the payload's length stays known) and refer to it.

Defined results
* null html: an empty payload. Null page_id: written and read back as null; never referred to.
* equal payloads among rows that share the smallest page_id: each is a response.
* null url: an empty target URI. Empty table: no archive, empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: A fixed value: every record has the same date, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record or frame that does not hold what its headers say."""


@dataclass(frozen=True)
class WarcParams:
    """archive_bytes: payload bytes after which a task starts the next archive, which bounds what a reader holds."""

    min_bytes: int = 100
    archive_bytes: int = 8_000_000
    dict_bytes: int = 32_768
    dict_samples: int = 400
    level: int = 3


# ---------------------------------------------------------------- records


def _block(payload_len: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_len + payload


def record_bytes(page_id, url: str, payload: bytes, digest: str, length: int, refers_to=None) -> bytes:
    """One WARC record. A revisit (refers_to given) carries the HTTP headers alone."""
    kind = "response" if refers_to is None else "revisit"
    block = _block(length, payload if refers_to is None else b"")
    name = "null" if page_id is None else str(page_id)
    target = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in (url or ""))
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What every record must say.
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _same_digest(told: str, data: bytes) -> bool | None:
    """Whether a header's digest is that of data; None for an algorithm that is not known here."""
    algorithm, _, value = told.partition(":")
    name = algorithm.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(name, data).digest()
    return value.strip().lower() in (found.hex(), base64.b32encode(found).decode().rstrip("=").lower(), base64.b32encode(found).decode().lower())


def parse_warc(raw: bytes, where: str = "") -> dict:
    """Any record: validated headers (names in lower case), block and payload. A revisit has no payload."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0:
        raise WarcError(f"{where}: no end of the headers")
    version, *lines = raw[:cut].split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{where}: not a WARC version line: {version[:40]!r}")
    head: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            head[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"{where}: not a header: {line[:40]!r}")
        last = name.strip().lower().decode("utf-8", "replace")
        head[last] = value.strip().decode("utf-8", "replace")
    for name in REQUIRED:
        if name not in head:
            raise WarcError(f"{where}: {name} is missing")
    if not head["content-length"].isdigit():
        raise WarcError(f"{where}: Content-Length is not a number")
    length = int(head["content-length"])
    block, tail = raw[cut + 4 : cut + 4 + length], raw[cut + 4 + length :]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError(f"{where}: the block does not end where Content-Length says")
    if "warc-block-digest" in head and _same_digest(head["warc-block-digest"], block) is False:
        raise WarcError(f"{where}: the block digest differs")
    kind, payload, http = head["warc-type"].lower(), block, None
    if head.get("content-type", "").lower().startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        if end < 0:
            raise WarcError(f"{where}: the HTTP headers do not end")
        http, payload = block[:end], block[end + 4 :]
    if kind == "revisit":
        payload = None
    elif "warc-payload-digest" in head and _same_digest(head["warc-payload-digest"], payload) is False:
        raise WarcError(f"{where}: the payload differs from its digest")
    return {"head": head, "type": kind, "http": http, "block": block, "payload": payload}


def parse_record(raw: bytes, where: str = "") -> dict:
    """Validate a record of a page written here and take it apart."""
    record = parse_warc(raw, where)
    head, http = record["head"], record["http"]
    if "warc-payload-digest" not in head:
        raise WarcError(f"{where}: warc-payload-digest is missing")
    if http is None:
        raise WarcError(f"{where}: the HTTP headers do not end")
    told = [x.split(b":", 1)[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(told) != 1 or not told[0].strip().isdigit():
        raise WarcError(f"{where}: the HTTP length is missing")
    body, payload_len = record["block"][len(http) + 4 :], int(told[0])
    algorithm, _, digest = head["warc-payload-digest"].partition(":")
    if algorithm != "sha256" or len(digest) != 64:
        raise WarcError(f"{where}: the payload digest is not SHA-256")
    refers = None
    if record["type"] == "response":
        if len(body) != payload_len:
            raise WarcError(f"{where}: the payload differs from its headers")
    elif record["type"] == "revisit":
        if body or not (refers := _page(head.get("warc-refers-to", ""), where)):
            raise WarcError(f"{where}: a revisit with a payload or without a reference")
        refers = int(refers)
    else:
        raise WarcError(f"{where}: unknown record type {record['type'][:40]}")
    name = _page(head["warc-record-id"], where)
    return {
        "page_id": None if name == "null" else int(name), "url": head.get("warc-target-uri"), "payload": record["payload"],
        "payload_bytes": payload_len, "payload_digest": digest, "record_type": record["type"], "refers_to": refers,
    }


def _page(urn: str, where: str) -> str:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise WarcError(f"{where}: not a page URN: {urn[:40]}")
    return urn[10:-1]


# ---------------------------------------------------------------- archives


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary, or raw content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


class ArchiveWriter:
    """Builds one archive in memory."""

    def __init__(self, dictionary: bytes, level: int):
        import zstandard

        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self.parts = [struct.pack("<II", SKIPPABLE, len(packed)), packed]
        found = zstandard.ZstdCompressionDict(dictionary)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=found, write_checksum=True, write_content_size=True)
        self.raw = 0

    def add(self, record: bytes) -> None:
        self.parts.append(self.packer.compress(record))
        self.raw += len(record)

    def bytes(self) -> bytes:
        return b"".join(self.parts)


class _Feed:
    """A stream that can be looked into before it is read."""

    def __init__(self, stream: BinaryIO, step: int = 1 << 18):
        self.stream, self.step, self.held, self.at = stream, step, b"", 0

    def look(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.stream.read(max(self.step, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out, self.held = self.look(n), self.held[n:]
        self.at += len(out)
        return out

    def some(self) -> bytes:
        return self.take(len(self.held) or len(self.look(self.step)))

    def give_back(self, data: bytes) -> None:
        self.held = data + self.held
        self.at -= len(data)


def _skippable(magic: bytes) -> bool:
    return len(magic) == 4 and struct.unpack("<I", magic)[0] & 0xFFFFFFF0 == 0x184D2A50


def read_frames(stream: BinaryIO, where: str = "", max_record: int = 1 << 31, dictionary: bool = True) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every Zstandard frame. dictionary: whether the stream has to begin with one."""
    import zstandard

    feed, found = _Feed(stream), None
    if struct.pack("<I", SKIPPABLE) == feed.look(4):
        size = struct.unpack("<II", feed.take(8).ljust(8, b"\xff"))[1]
        content = feed.take(size) if size < 1 << 28 else b""
        if len(content) < size:
            raise WarcError(f"{where}: the dictionary is cut off")
        if content[:4] == ZSTD_MAGIC:
            try:
                content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 26)
            except zstandard.ZstdError as e:
                raise WarcError(f"{where}: the dictionary: {e}") from e
        found = zstandard.ZstdCompressionDict(content)
    elif dictionary or not feed.look(4):
        raise WarcError(f"{where}: no leading dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()
    unknown = (zstandard.CONTENTSIZE_UNKNOWN, zstandard.CONTENTSIZE_ERROR)
    while magic := feed.look(4):
        here, at = f"{where} at {feed.at}", feed.at
        if _skippable(magic):
            size = struct.unpack("<II", feed.take(8).ljust(8, b"\xff"))[1]
            if len(feed.take(size)) < size:
                raise WarcError(f"{here}: a skippable frame is cut off")
            continue
        if magic != ZSTD_MAGIC:
            raise WarcError(f"{here}: no Zstandard frame")
        try:
            told = zstandard.get_frame_parameters(feed.look(18)).content_size
            if told > max_record and told not in unknown:
                raise WarcError(f"{here}: a record of {told} bytes")
            frame, parts, size = reader.decompressobj(), [], 0
            while not frame.eof and (data := feed.some()):
                parts.append(frame.decompress(data))
                size += len(parts[-1])
                if size > max_record:
                    raise WarcError(f"{here}: a record of more than {max_record} bytes")
        except zstandard.ZstdError as e:
            raise WarcError(f"{here}: {e}") from e
        if not frame.eof:
            raise WarcError(f"{here}: the frame is cut off")
        if told not in unknown and told != size:
            raise WarcError(f"{here}: the frame holds {size} bytes, its header says {told}")
        feed.give_back(frame.unused_data)
        yield at, b"".join(parts)


def read_archive(data: bytes | BinaryIO, where: str = "", max_record: int = 1 << 31) -> Iterator[dict]:
    """The page records of one archive written here, one frame at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    for at, raw in read_frames(stream, where, max_record):
        yield parse_record(raw, f"{where} at {at}")


# ---------------------------------------------------------------- Spark


def plan_records(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """page_id, url, payload, digest, length and refers_to (null: a response).

    Owners are found on digests alone, pre-aggregated before the shuffle. Only payloads that
    repeat stay in the owners' table, so most pages meet no partner.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")}
    )
    owners = (
        rows.where(F.col("length") >= params.min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("owner").isNotNull())
        .select("digest", "owner")
    )
    owners = common.written(owners, "warc-owners")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return rows.join(owners, "digest", "left").select("page_id", "url", "payload", "digest", "length", refers.alias("refers_to"))


def archive_dictionary(pages: DataFrame, params: WarcParams = WarcParams()) -> bytes:
    """Trained on a bounded sample: the first 8,192 code points of the dict_samples pages whose ids have the smallest hashes."""
    ids = pages.select(F.xxhash64("page_id").alias("h"), "page_id").orderBy("h", "page_id").limit(params.dict_samples)
    html = F.substring(F.coalesce(F.col("html"), F.lit("")), 1, 8192)
    # at most dict_samples ids: a bound by parameter; only their pages' text leaves the tasks
    some = pages.join(F.broadcast(ids.select("page_id").distinct()), "page_id").select("page_id", html.alias("t"))
    some = some.orderBy("page_id", "t").limit(params.dict_samples).collect()
    texts = [r["t"].encode() for r in some]
    return train_dictionary([record_bytes(0, "", t, hashlib.sha256(t).hexdigest(), len(t)) for t in texts], params.dict_bytes)


def _store(uri: str):
    from pyarrow import fs

    if (path := common.local_path(uri)) is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, folder: str, dictionary: bytes, params: WarcParams = WarcParams()) -> DataFrame:
    """Write ``plan_records`` rows to archives under ``folder``; one row (path, n_records, n_bytes) per archive.

    A retried task writes under another name; only the archives that the returned rows name count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        writer, n = ArchiveWriter(dictionary, params.level), 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = writer.bytes()
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [n], "n_bytes": [len(data)]})

        for batch in batches:
            for r in batch.to_pylist():
                writer.add(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["length"], r["refers_to"]))
                n += 1
                if writer.raw >= params.archive_bytes:
                    yield close()
                    writer, n = ArchiveWriter(dictionary, params.level), 0
        if n:
            yield close()

    return records.mapInArrow(run, "path string, n_records long, n_bytes long")


RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, n_records). A count that differs is an error.

    With payloads=False the payloads are decoded and validated but not returned.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        store, root = _store(folder)
        for batch in batches:
            for r in batch.to_pylist():
                count = 0

                def counted(f, path=r["path"]):
                    nonlocal count
                    for x in read_archive(f, path):
                        count += 1
                        yield x if payloads else {**x, "payload": None}

                with store.open_input_stream(f"{root}/{r['path']}", compression=None) as f:
                    yield from _in_batches(counted(f), schema)
                if count != r["n_records"]:
                    raise WarcError(f"{r['path']}: {count} records, the manifest has {r['n_records']}")

    return manifest.select("path", "n_records").mapInArrow(run, RECORD)


def _in_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of at most 5,000 rows and about 4 MB of payload."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row["payload"] or b"")
        if held > 4_000_000 or len(part) >= 5000:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def read_records(paths: DataFrame, max_record: int = 1 << 31) -> DataFrame:
    """Every record of any WARC archives (column path, a URI): path, offset, record_id, record_type, target_uri, date,
    content_type, payload (null for a revisit), payload_digest as told, refers_to. A fault is an error that names its place."""
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "content_type")],
         ("payload", pa.binary()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
    )

    def records(path: str) -> Iterator[dict]:
        store, place = _store(path)
        with store.open_input_stream(place, compression=None) as f:
            for at, raw in read_frames(f, path, max_record, dictionary=False):
                record = parse_warc(raw, f"{path} at {at}")
                told = record["head"].get
                yield {
                    "path": path, "offset": at, "record_id": told("warc-record-id"), "record_type": record["type"],
                    "target_uri": told("warc-target-uri"), "date": told("warc-date"), "content_type": told("content-type"),
                    "payload": record["payload"], "payload_digest": told("warc-payload-digest"), "refers_to": told("warc-refers-to"),
                }

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _in_batches(records(path), schema)

    fields = "path string, offset long, record_id string, record_type string, target_uri string, date string, content_type string"
    named = paths.where("path IS NOT NULL").select("path")
    return named.mapInArrow(run, fields + ", payload binary, payload_digest string, refers_to string")


def round_trip(spark: SparkSession, pages: DataFrame, params: WarcParams = WarcParams(), payloads: bool = False) -> DataFrame:
    """Write every page to archives in the shared folder and read the archives back."""
    folder = common.fresh_path(spark, "warc")
    dictionary = archive_dictionary(pages, params)
    manifest = common.written(write_archives(plan_records(pages, params), folder, dictionary, params), "warc-manifest")
    n = manifest.count()
    dealt = manifest.repartition(max(1, min(n, 4096))) if n else manifest
    return read_archives(dealt, folder, payloads)
