"""Media columns with content-defined chunks.

A payload of 8-bit samples becomes a media file (a WAV header and the samples,
one channel of unsigned bytes). The file is cut where a rolling gear hash of
the last 32 bytes has its leading bits clear, within a least and a greatest
chunk length, so that equal passages of different files give equal chunks.

Storing: digests first, bytes as late as possible. A pass over the payloads
writes each file's ordered list of chunk digests (the manifest). The digests
are counted by a Spark aggregate; those that occur more than once go into a
Bloom filter of at most FILTER_BITS. In the second pass, of each distinct file
only one row is kept where the filter allows; chunks the filter rules out are
unique and stay in their file's row, all others become rows of the chunk
store, one per digest after a Spark aggregate. So unique bytes are written
once and never shuffled, however large the corpus, and the filter may fill up:
it then sends more chunks through the aggregate, with the same result.

Reading back joins each file's list with the chunk store by digest, puts the
chunks in order, and verifies length and SHA-256 of every file; a mismatch
raises. Files of equal bytes are stored and read once and joined to their rows
by digest. Null texts count as empty. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged

RATE, HEADER = 8000, 44
UNIT = 192
LEAST, GREATEST, CUT_BITS = 512, 8192, 11
FILTER_BITS, FILTER_HASHES = 1 << 25, 3
_GEAR = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 32, 256, np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with blanks to a positive multiple of UNIT, their number before)."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b)), len(b)


def as_wav(samples: bytes) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    tag, _, kind, *_, bits, data, size = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (tag, kind, bits, data) != (b"RIFF", b"WAVE", 8, b"data") or size != len(media) - HEADER:
        raise ValueError("not a file of this store")
    return media[HEADER:]


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks of a file."""
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # after these, position i holds the gear hash of the 32 bytes up to i
        h[s:] = h[s:] + (h[:-s] << np.uint32(s)) if len(h) > s else h[s:]
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, last, k, n = [], 0, 0, len(media)
    while n - last > LEAST:
        k = int(np.searchsorted(at, last + LEAST))
        end = min(int(at[k]) if k < len(at) else n, last + GREATEST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunked(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    a, out = 0, []
    for z in cuts(media):
        out.append((hashlib.blake2b(media[a:z], digest_size=16).digest(), media[a:z]))
        a = z
    return out


def features(samples: bytes) -> str:
    """Figures of the samples: mean, root mean square about silence, crossings, loudest and entropy of the levels."""
    x = np.frombuffer(samples, np.uint8)
    d = x.astype(np.int64) - 128
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    crossings = int(((d[1:] >= 0) != (d[:-1] >= 0)).sum())
    return f"mean={d.mean():.4f};rms={np.sqrt((d * d).mean()):.4f};crossings={crossings};peak={int(np.abs(d).max())};entropy={-(p * np.log2(p)).sum():.4f}"


def _bits(digests: np.ndarray) -> np.ndarray:
    """Filter positions of 16-byte digests (rows of two 64-bit numbers)."""
    return (digests[:, :1] + np.arange(FILTER_HASHES, dtype=np.uint64) * (digests[:, 1:] | np.uint64(1))) % np.uint64(FILTER_BITS)


def manifests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha256 (binary) and the ordered digests of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, lists = [], [], []
            for t in b.column(1).to_pylist():
                samples, size = payload(t)
                media = as_wav(samples)
                n.append(size)
                sha.append(hashlib.sha256(media).digest())
                lists.append([d for d, _ in chunked(media)])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary, digests array<binary>")


def _filter(shared: DataFrame) -> np.ndarray:
    """The Bloom filter over shared(digest): FILTER_BITS at most, whatever the number of digests."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        for b in batches:
            if b.num_rows:
                p = _bits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, 2)).ravel()
                np.bitwise_or.at(words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at].view(np.int64))], ["w", "bits"])

    merged = shared.mapInArrow(parts, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[merged["w"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return words


PART = "struct<digest:binary,bytes:binary>"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifests; files: media and parts, a part's bytes null where they are in the store; the store: digest and bytes)."""
    prepare(docs.sparkSession)
    rows = staged(manifests(docs), "manifests")
    # a file that occurs twice is shared as a whole
    counted = rows.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    shared = staged(counted.where("n > 1").select("digest"), "shared")
    words = docs.sparkSession.sparkContext.broadcast(_filter(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # what this task has sent already; emptied when it grows
        for b in batches:
            files, lists, digests, data = [], [], [], []
            for t in b.column(0).to_pylist():
                media = as_wav(payload(t)[0])
                parts = chunked(media)
                p = _bits(np.frombuffer(b"".join(d for d, _ in parts), np.uint64).reshape(-1, 2))
                maybe = ((words.value[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)
                files.append(hashlib.sha256(media).digest())
                lists.append([{"digest": d, "bytes": None if m else c} for (d, c), m in zip(parts, maybe)])
                for (d, c), m in zip(parts, maybe):
                    if m and d not in sent:
                        sent.add(d)
                        digests.append(d), data.append(c)
                if len(sent) > 200_000:
                    sent.clear()
            n, k = len(files), len(digests)
            part = pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])
            yield pa.record_batch([pa.array(files + [None] * k, pa.binary()), pa.array(lists + [None] * k, pa.list_(part)), pa.array([None] * n + digests, pa.binary()), pa.array([None] * n + data, pa.binary())], ["media", "parts", "digest", "bytes"])

    laid = staged(docs.select("text").mapInArrow(run, f"media binary, parts array<{PART}>, digest binary, bytes binary"), "laid")
    chunks = staged(laid.where("digest IS NOT NULL").groupBy("digest").agg(F.first("bytes").alias("bytes")), "chunks")
    return rows, laid.where("media IS NOT NULL").select("media", "parts"), chunks


def read_back(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every distinct stored file, verified."""
    inline = F.forall("parts", lambda p: p["bytes"].isNotNull())
    copied = F.forall("parts", lambda p: p["bytes"].isNull())
    whole = files.where(inline).select("media", F.transform("parts", lambda p: p["bytes"]).alias("data"))
    # files that are in the store as a whole may be copies: each is read once
    stored = files.where(copied).select("media", F.transform("parts", lambda p: p["digest"]).alias("d")).groupBy("media").agg(F.first("d").alias("d"))
    stored = stored.select("media", F.posexplode("d").alias("seq", "digest")).withColumn("own", F.lit(None).cast("binary"))
    mixed = files.where(~inline & ~copied).select("media", F.posexplode("parts").alias("seq", "p")).select("media", "seq", "p.digest", F.col("p.bytes").alias("own"))
    # only references are joined; a digest that very many files share only repeats on the side that can be split
    refs = stored.union(mixed)
    found = refs.where("own IS NULL").join(chunks, "digest", "left").select("media", "seq", "bytes")
    found = found.union(refs.where("own IS NOT NULL").select("media", "seq", F.col("own").alias("bytes")))
    joined = found.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("x")).select("media", F.col("x.bytes").alias("data"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                media = b"".join(x or b"" for x in data)
                if hashlib.sha256(media).digest() != key:
                    raise ValueError(f"stored file {key.hex()} does not read back")
                samples = from_wav(media)
                out.append((key, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), key.hex(), features(samples)))
            columns = list(zip(*out)) or [[]] * 7
            types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return whole.union(joined).mapInArrow(verify, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_of(docs: DataFrame) -> DataFrame:
    """Stores every row's media and reads it back: doc_id, n_bytes and the columns of read_back."""
    rows, files, chunks = store(docs)
    read = staged(read_back(files, chunks), "read")
    return rows.select("doc_id", "n_bytes", "media").join(read, "media", "left").drop("media")
