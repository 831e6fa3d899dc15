"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its bytes says so, so equal passages give equal chunks wherever they
stand. Chunks are known by their SHA-256; the store keeps each once. A manifest, the ordered list of a payload's
chunks, rebuilds it from the store, and the SHA-256 of what is read back is held against the one taken before.

Every text is chunked and hashed once. What comes out, manifests and chunks, is written as packs, a payload that the same
task has met before without its chunks. All payloads are read back from there, by references:

1. Digests are counted over the distinct payloads. A chunk that no other payload has stays in its payload's pack, which is
   its place in the store; a payload of such chunks alone is rebuilt where it lies. A fixed bitmap of shared digests tells
   which payloads those are; where it errs, a payload takes the longer way to the same result.
2. The references of all others are joined by digest to the chunk's owner (the least payload and place that have it), so
   that repeated chunks drop out; then to the owner's bytes; then they are brought together in the order of their
   manifests. So bytes are moved only where something is shared, and moved chunks are compressed first.

Joins by digest and by owner have no aggregation behind them, so the adaptive planner splits a very common chunk's
references. Packs are deleted once the results, which are short, are written.

The stored form of a payload is its manifest followed by its chunks: header ``CDC1``, number of chunks, unpadded length
(big-endian, 4 and 8 bytes), then a digest (32 bytes) and a length (4 bytes) for each chunk, then the chunks' bytes.

Text is stored as UTF-8 with bytes 255 up to a positive multiple of 576. Null text: empty. Equal texts give equal
values. Repeated rows and ids each give a row. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import KeyBitmap, discard, in_batches, materialize, tasks_for, text_or_empty

UNIT = 576
LEAST, MASK, MOST = 256, np.uint32(0x3FF << 20), 4096
GEAR = np.random.default_rng(0x9EA4).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes, and how many of them are the text's."""
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT), len(data)


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Places behind which a chunk may end: the gear hash of the last 32 bytes has ten zero bits.

    The sum over 32 shifted bytes is built by doubling, so it takes five passes over the array.
    """
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return np.flatnonzero((h & MASK) == 0) + 1


def chunk_ends(data: bytes) -> list[int]:
    """The ends of the chunks: cuts at least LEAST and at most MOST bytes apart; what is left is the last chunk."""
    cuts = gear_cuts(np.frombuffer(data, np.uint8)).tolist()
    ends, start, n, i = [], 0, len(data), 0
    while n - start > LEAST:
        while i < len(cuts) and cuts[i] < start + LEAST:
            i += 1
        start = min(cuts[i] if i < len(cuts) else n, start + MOST, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = chunk_ends(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def manifest(n_bytes: int, digests: list[bytes], lengths: list[int]) -> bytes:
    return b"".join([b"CDC1", struct.pack(">IQ", len(digests), n_bytes), *(d + struct.pack(">I", n) for d, n in zip(digests, lengths, strict=True))])


def read_manifest(data: bytes) -> tuple[int, list[bytes], list[int]]:
    n, n_bytes = struct.unpack(">IQ", data[4:16])
    rows = [data[at : at + 36] for at in range(16, 16 + 36 * n, 36)]
    return n_bytes, [r[:32] for r in rows], [struct.unpack(">I", r[32:])[0] for r in rows]


_RESULT_NAMES = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stored: bytes, chunks: dict[bytes, bytes], expected: bytes) -> tuple:
    """Rebuild a payload from its manifest and chunks, verify it and take its features: what follows the payload's digest in READ."""
    n_bytes, digests, lengths = read_manifest(stored)
    parts = [chunks[d] for d in digests]
    for d, n, part in zip(digests, lengths, parts, strict=True):
        if len(part) != n or hashlib.sha256(part).digest() != d:
            raise ValueError("a stored chunk is not what its digest says")
    payload = b"".join(parts)
    whole = hashlib.sha256(payload)
    if whole.digest() != expected:
        raise ValueError("a payload read back differs from what was stored")
    media = hashlib.sha256(stored)
    media.update(payload)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = int((counts * np.arange(256)).sum()) * 1000 // len(payload)
    feature = f"chunks={len(parts)};mean={mean / 1000:.3f};entropy={-(share * np.log2(share)).sum():.4f}"
    return n_bytes, len(payload), zlib.crc32(payload[-32:]), len(stored) + len(payload), media.digest(), feature


def _rows(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PACKED = pa.schema([("doc_id", pa.int64()), ("sha256", pa.binary()), ("manifest", pa.binary()), ("heads", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary()))])
PACKED = "doc_id long, sha256 binary, manifest binary, heads array<long>, chunks array<binary>"
_CHUNK = pa.schema([("owner", pa.binary()), ("place", pa.int32()), ("chunk", pa.binary())])
_REF = pa.schema([("sha256", pa.binary()), ("seq", pa.int32()), ("digest", pa.binary()), ("manifest", pa.binary())])
_READ = pa.schema([("sha256", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media", pa.binary()), ("feature", pa.string())])
READ = "sha256 binary, n_bytes long, payload_bytes long, tail_crc32 long, media_bytes long, media binary, feature string"


def store(texts: DataFrame) -> DataFrame:
    """PACKED, a row per text (doc_id, text): its payload's SHA-256 and, where the task meets it for the first time, its
    manifest, the first 64 bits of its chunks' digests, and its chunks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in _rows(batches):
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data, n_bytes = payload_of(text)
                sha = hashlib.sha256(data).digest()
                if sha in seen:
                    rows.append((doc_id, sha, None, None, None))
                    continue
                seen = seen if len(seen) < 50_000 else set()
                seen.add(sha)
                chunks = chunks_of(data)
                digests = [hashlib.sha256(c).digest() for c in chunks]
                heads = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
                rows.append((doc_id, sha, manifest(n_bytes, digests, list(map(len, chunks))), heads, chunks))
            yield _batch(rows, _PACKED)

    return materialize(in_batches(texts, pack, PACKED), "packs")


def media_features(docs: DataFrame, digest_bits: int = 24) -> DataFrame:
    """Store every text as a payload, read it back from the store, and return RESULT, a row per document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    packs = store(texts)
    ids = materialize(packs.select("doc_id", "sha256"), "ids")
    held = packs.where("manifest IS NOT NULL")
    each = held.select("sha256", "heads").dropDuplicates(["sha256"]).select(F.explode(F.array_distinct("heads")).alias("head"))
    shared = each.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sent = docs.sparkSession.sparkContext.broadcast(KeyBitmap.of(shared, "head", digest_bits))

    def shares(heads: pa.Array) -> list[bool]:
        """Which payloads share a chunk."""
        hit = np.concatenate([[0], np.cumsum(sent.value.has(heads.flatten().to_numpy()))])
        ends = heads.offsets.to_numpy() - heads.offsets[0].as_py()
        return (hit[ends[1:]] > hit[ends[:-1]]).tolist()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            rows = zip(shares(b["heads"]), *(b[k].to_pylist() for k in ("sha256", "manifest", "chunks")), strict=True)
            yield _batch([(sha, *read_back(stored, dict(zip(read_manifest(stored)[1], chunks, strict=True)), sha)) for on, sha, stored, chunks in rows if not on], _READ)

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            rows = zip(shares(b["heads"]), b["sha256"].to_pylist(), b["manifest"].to_pylist(), strict=True)
            yield _batch([(sha, seq, d, None if seq else stored) for on, sha, stored in rows if on for seq, d in enumerate(read_manifest(stored)[1])], _REF)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in _rows(batches):
            rows = zip(shares(b["heads"]), b["sha256"].to_pylist(), b["chunks"].to_pylist(), strict=True)
            yield _batch([(sha, seq, squeeze(c)) for on, sha, chunks in rows if on for seq, c in enumerate(chunks)], _CHUNK)

    refs = in_batches(held.select("sha256", "manifest", "heads"), refer, "sha256 binary, seq int, digest binary, manifest binary")
    refs = materialize(refs.dropDuplicates(["sha256", "seq"]), "refs", tasks_for(packs, 0.2))
    owners = refs.groupBy("digest").agg(F.min(F.struct("sha256", "seq")).alias("own")).select("digest", F.col("own.sha256").alias("owner"), F.col("own.seq").alias("place"))
    given = in_batches(held.select("sha256", "heads", "chunks"), give, "owner binary, place int, chunk binary").dropDuplicates(["owner", "place"])
    found = refs.join(owners, "digest").join(given, ["owner", "place"])
    whole = in_batches(held.select("sha256", "manifest", "heads", "chunks"), alone, READ).unionByName(_rebuilt(found))
    read = materialize(whole.dropDuplicates(["sha256"]), "read", tasks_for(packs))
    discard(packs, refs)
    hexed = {"payload_sha256": "sha256", "media_sha256": "media"}
    return ids.join(read, "sha256").select(*(F.lower(F.hex(hexed[c])).alias(c) if c in hexed else c for c in _RESULT_NAMES))


def _rebuilt(found: DataFrame) -> DataFrame:
    """READ of each payload, from its references and their bytes (sha256, seq, digest, manifest at seq 0, chunk)."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, stored, parts = None, None, {}
        for b in _rows(batches, 5000):
            rows = []
            for sha, seq, digest, given, chunk in zip(*(b[k].to_pylist() for k in ("sha256", "seq", "digest", "manifest", "chunk")), strict=True):
                if sha != now:
                    if now is not None:
                        rows.append((now, *read_back(stored, parts, now)))
                    now, parts = sha, {}
                stored = stored if seq else given
                parts[digest] = unpack(chunk)
            yield _batch(rows, _READ)
        if now is not None:
            yield _batch([(now, *read_back(stored, parts, now))], _READ)

    ordered = found.select("sha256", "seq", "digest", "manifest", "chunk").repartition("sha256").sortWithinPartitions("sha256", "seq")
    return in_batches(ordered, rebuild, READ)
