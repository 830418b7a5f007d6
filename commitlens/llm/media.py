"""Media columns: payloads stored once per digest in tar shards, rows that carry digest, offset and length.

Each task encodes its rows' payloads losslessly as PNG images (8-bit grey
samples, 64 to a row) and appends them to a tar shard of its own, each digest
once a shard, so nothing is shuffled and no group of copies meets in one task.
The index (a row per input row) is kept in the shared folder before anything is read back:
an attempt that is lost or run twice leaves an unreferenced shard, never a
row that points at the wrong bytes. ``canonical`` names one place per digest over
all shards: payloads are read back from there, each once, and rows get what was read by
their digest. ``metadata`` fills width, height and depth from range reads of the first 33
bytes of a payload; ``features`` reads and decodes all of it.

Edge cases: a null text is empty (64 zero bytes); equal texts give equal values
wherever they are stored; ids may be null; rows that repeat share a payload; of equal payloads in several shards
the least place counts; a very long text is one payload, and one shard if it is larger than that; an
empty table gives no rows and no shard. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from commitlens.llm.common import arrow_schema, cut, shared_dir, slices

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature and the IHDR chunk
#: A shard is closed at this size and another begun.
SHARD_BYTES = 256 << 20
INDEX = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes, and these with zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % ROW if data else ROW)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A grey PNG of 64 samples a row, unfiltered."""
    height = len(payload) // ROW
    rows = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, len(payload), ROW))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from a PNG's first 33 bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def decode(media: bytes) -> bytes:
    """The samples of an image that ``encode`` made; its checksums are verified."""
    width, height, _ = header(media)
    at, packed = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        packed += [data] if kind == b"IDAT" else []
        at += 12 + size
    rows = zlib.decompress(b"".join(packed))
    if len(rows) != (width + 1) * height or any(rows[:: width + 1]):
        raise ValueError("filtered or cut rows")
    return b"".join(rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1))


def filesystem(uri: str) -> tuple:
    """A filesystem of any kind that pyarrow knows (local, hdfs, object stores) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shard:
    """A tar file under construction; each digest is stored once."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        self.out = files.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}")
        self.places: dict[bytes, tuple[int, int]] = {}
        self.size = 0

    def add(self, digest: bytes, payload: bytes) -> tuple[int, int]:
        if digest not in self.places:
            media = encode(payload)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.places[digest] = (self.size + len(head), len(media))
            body = head + media + bytes(-len(media) % tarfile.BLOCKSIZE)
            self.out.write(body)
            self.size += len(body)
        return self.places[digest]

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def store(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the payloads to tar shards in ``folder``; the index: doc_id, n_bytes, digest, shard, offset, length."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    schema = arrow_schema(spark, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, payload = payload_of(text)
                digest = hashlib.sha256(payload).digest()
                if shard and shard.size > SHARD_BYTES:
                    shard.close()
                    shard = None
                shard = shard or Shard(folder)
                rows.append((doc_id, n, digest, shard.uri, *shard.add(digest, payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)
        if shard:
            shard.close()

    return cut(docs.select("doc_id", "text").mapInArrow(run, INDEX))


def canonical(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length: of all shards that hold a digest the least place."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")


def in_order(places: DataFrame, tasks: int) -> DataFrame:
    """``places`` dealt by where they are, so that a task reads on in few shards."""
    return places.repartitionByRange(max(1, tasks), "shard", "offset").sortWithinPartitions("shard", "offset")


def _from_shards(places: DataFrame, read: Callable, extra: str) -> DataFrame:
    """``places`` (shard, offset, length and others) with the columns that ``read(file, row)`` gives; each payload of a batch is read once."""
    target = T.StructType([*places.schema.fields, *_parse_datatype_string(extra).fields])
    schema = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in slices(batches):
            rows = batch.to_pylist()
            seen: dict[tuple, tuple] = {}
            for r in sorted(rows, key=lambda r: (r["shard"], r["offset"])):
                key = (r["shard"], r["offset"])
                if key in seen:
                    continue
                if uri != r["shard"]:
                    if file:
                        file.close()
                    files, path = filesystem(r["shard"])
                    uri, file = r["shard"], files.open_input_file(path)
                seen[key] = read(file, r)
            full = [(*r.values(), *seen[r["shard"], r["offset"]]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t.type) for i, t in enumerate(schema)], schema=schema)
        if file:
            file.close()

    return places.mapInArrow(run, target)


def metadata(places: DataFrame) -> DataFrame:
    """``places`` with width, height and bits a sample, from range reads of the headers alone."""
    return _from_shards(places, lambda file, r: header(file.read_at(min(HEADER, r["length"]), r["offset"])), "width int, height int, bits int")


def features(places: DataFrame) -> DataFrame:
    """``places`` with what the stored bytes tell: sizes, digests and a feature text of the samples."""

    def read(file, r: dict) -> tuple:  # noqa: ANN001
        import numpy as np

        media = file.read_at(r["length"], r["offset"])
        samples = decode(media)
        counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
        shares = counts[counts > 0] / len(samples)
        feature = f"mean={counts @ np.arange(256) / len(samples):.6f}:entropy={-(shares * np.log2(shares)).sum():.6f}"
        return len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-ROW:]), len(media), hashlib.sha256(media).digest(), feature

    return _from_shards(places, read, "payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, samples string")


def described(index: DataFrame) -> DataFrame:
    """Each row of ``index`` (doc_id, n_bytes, digest) with its payload's one place, header fields and features; digests as hex."""
    tasks = index.select("shard").distinct().count()
    read = features(metadata(in_order(canonical(index), tasks)))
    size = F.concat_ws("x", *(F.col(c).cast("string") for c in ("width", "height", "bits")))
    found = index.select("doc_id", "n_bytes", "digest").join(read, "digest").withColumn("feature", F.concat_ws(":", size, "samples"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")})


def members(shard: str) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of a shard's members, by the standard tar reader."""
    files, path = filesystem(shard)
    with files.open_input_file(path) as file, tarfile.open(fileobj=io.BytesIO(file.read())) as tar:
        for info in tar:
            yield info.name, tar.extractfile(info).read()
