"""WARC archives of pages, and a normaliser for archives that were compressed as one gzip stream.

`write_archives` writes a record per page into one gzip stream per partition, as many crawlers do: such a file can only
be read from its start. `normalise` inflates each stream once, front to back, and rewrites every record as a gzip member
of its own, with a sidecar index of offsets beside it; from then on any record is one seek away. `read_records` reads
through the index.

Records with equal payloads (by SHA-1, of at least min_bytes) are written once: the one with the largest page id is the
response, the others are revisits that refer to it. A record's id is the page's as a URN; the length of the full payload
is in a field of its own, since a revisit does not hold the payload.

Defined results: a null payload is an empty one; a null URL gives a record without target; control characters in a URL
are percent-encoded; a null page id is empty in the record's id, never the response of a group that has another id;
repeated rows with the largest id are all responses; a very long payload is one record, which a task holds whole; an empty
table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side
from .files import readable, written

#: Bytes of a stream that are inflated at a time.
STEP = 1 << 18
LEVEL = 1
URN = "urn:millrace:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with an HTTP message, or with refers_to a revisit with its header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def inflated(read, size: int = STEP) -> Iterator[bytes]:
    """The content of a gzip stream of any number of members, piece by piece; raises EOFError if it is cut short."""
    state, begun = zlib.decompressobj(31), False
    while data := read(size):
        if not begun:
            data = data.lstrip(b"\0")  # padding between members
        while data:
            begun = True
            yield state.decompress(data, size)
            data = state.unconsumed_tail
            if state.eof:
                data = state.unused_data.lstrip(b"\0")
                state, begun = zlib.decompressobj(31), False
    if begun:
        yield state.flush()
        if not state.eof:
            raise EOFError("the gzip stream ends inside a member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of pieces of a WARC stream; holds one record."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise EOFError("the stream ends inside a record's header")
                return
            while held[:2] == b"\r\n":
                del held[:2]
        length = re.search(rb"\r\ncontent-length:\s*(\d+)", held[: end + 2], re.IGNORECASE)
        if not length:
            raise ValueError("a record without Content-Length")
        total = end + 4 + int(length[1])
        while len(held) < total:
            if not more():
                raise EOFError("the stream ends inside a record")
        yield bytes(held[:total]) + b"\r\n\r\n"
        del held[:total]


def member(data: bytes, level: int = LEVEL) -> bytes:
    state = zlib.compressobj(level, zlib.DEFLATED, 31)
    return state.compress(data) + state.flush()


def with_revisits(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """df with refers_to: the largest id of the rows with an equal payload, null for that row itself and single ones.

    Columns may have any names; one called refers_to is replaced.
    """
    names = df.columns
    own_id, own_payload = (F.col(f"c{names.index(c)}") for c in (id_col, payload_col))
    payload = F.coalesce(own_payload.cast("binary"), F.lit(b""))
    keyed = df.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("_key", F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload)))
    groups = cut(
        keyed.where("_key IS NOT NULL").groupBy(F.col("_key").alias("_of"))
        .agg(F.max(own_id).cast("bigint").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _last IS NOT NULL")
        .drop("_n")
    )
    joined = keyed.join(small_side(groups, groups.count()), F.col("_key") == F.col("_of"), "left")
    other = own_id.isNull() | (own_id != F.col("_last"))
    kept = [F.col(f"c{k}").alias(n) for k, n in enumerate(names) if n.lower() != "refers_to"]
    return joined.select(*kept, F.when(other, F.col("_last")).alias("refers_to"))


def write_archives(
    df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write df, which has refers_to, as one gzip stream per partition; returns (path, n_records) of each."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in it if b.num_rows), None)
        if batch is None:
            return
        path, total = f"{folder}/crawl-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with written(path) as out:
            state = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            while batch is not None:
                for k in range(batch.num_rows):
                    page, url, payload, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                    out.write(state.compress(record(page, url, payload or b"", refers_to, date)))
                total += batch.num_rows
                batch = next(it, None)
            out.write(state.flush())
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [total]})

    rows = df.select(F.col(id_col).cast("bigint"), url_col, F.col(payload_col).cast("binary"), F.col("refers_to").cast("bigint"))
    return cut(rows.mapInArrow(write, "path string, n_records long"))


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each archive (path) record by record, with `<name>.idx` beside it: (path, n_records) of the new files.

    An index line has offset and length of the member, type and id of the record, separated by tabs.
    """

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column(0).to_pylist():
                new, index, offset = path.removesuffix(".warc.gz") + "-members.warc.gz", [], 0
                with readable(path) as source, written(new) as out:
                    for data in records(inflated(source.read)):
                        fields, packed = parse(data)[0], member(data)
                        out.write(packed)
                        kind, name = fields.get("warc-type", ""), fields.get("warc-record-id", "")
                        index.append(f"{offset}\t{len(packed)}\t{kind}\t{name}\n")
                        offset += len(packed)
                with written(new + ".idx") as out:
                    out.write("".join(index).encode())
                yield pa.RecordBatch.from_pydict({"path": [new], "n_records": [len(index)]})

    spread = archives.select("path").repartition(max(1, archives.count()))
    return cut(spread.mapInArrow(rewrite, "path string, n_records long"))


def read_records(archives: DataFrame) -> DataFrame:
    """The records of normalised archives, each found by its index: page id, URL, type, digest and length of the full
    payload, page referred to, and the payload as held (null in a revisit).

    A response whose payload does not have the digest or length that its header states raises ValueError.
    """

    def number(urn: str) -> int | None:
        value = urn.strip("<>").removeprefix(URN)
        return int(value) if value else None

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column(0).to_pylist():
                with readable(path + ".idx") as f:
                    index = [line.split("\t") for line in f.read().decode().splitlines()]
                with readable(path) as f:
                    for first in range(0, len(index), 256):
                        rows = []
                        for offset, length, kind, name in index[first : first + 256]:
                            fields, block = parse(zlib.decompress(f.read_at(int(length), int(offset)), 31))
                            digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["warc-x-payload-length"])
                            payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
                            if payload is not None and (base32_sha1(payload), len(payload)) != (digest, size):
                                raise ValueError(f"{name} in {path} does not have the payload that its header states")
                            other = fields.get("warc-refers-to")
                            rows.append((number(name), fields.get("warc-target-uri"), kind, digest, size, other and number(other), payload))
                        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                        names = ["id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    spread = archives.select("path").repartition(max(1, archives.count()))
    return spread.mapInArrow(
        read,
        "id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary",
    )
