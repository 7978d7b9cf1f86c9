"""Media columns in a store of content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its upper bits
clear, so that equal stretches give equal chunks wherever they lie. Chunks meet by
digest in Spark: of all that are equal, one owner stores its bytes, and every payload keeps an
ordered list of digests and lengths, its manifest. Only digests move for that. A payload
that owns all its chunks is read back from its own row; one that borrows some gets
those bytes by joins. Every chunk and payload is verified when read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import _text
from weir.llm._scratch import Scratch, arrow_map

UNIT = 64
LEAST, MOST = 128, 4096
_BITS = 9
#: Estimated bytes up to which the table of what documents needn't store is broadcast; a larger one is joined by shuffle.
BROADCAST = 32 << 20

_GEAR = np.random.default_rng(711).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def cuts(data: bytes) -> list[int]:
    """Lengths of the chunks of ``data``."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero(h >> np.uint32(32 - _BITS) == 0) + 1
    out, at = [], 0
    for m in marks.tolist():
        while m - at > MOST:
            out.append(MOST)
            at += MOST
        if m - at >= LEAST:
            out.append(m - at)
            at = m
    while n - at > MOST:
        out.append(MOST)
        at += MOST
    return out + [n - at] * (n > at)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def manifest(n_bytes: int, digests: list[bytes], lengths: list[int]) -> bytes:
    """The stored form of a payload: size before padding, then each chunk's digest and length."""
    return b"".join([b"CDC1", struct.pack("<qI", n_bytes, len(lengths)), *(d + struct.pack("<I", n) for d, n in zip(digests, lengths))])


def read_manifest(m: bytes) -> tuple[int, list[bytes], list[int]]:
    n_bytes, n = struct.unpack_from("<qI", m, 4)
    return n_bytes, [m[16 + 20 * k : 32 + 20 * k] for k in range(n)], [struct.unpack_from("<I", m, 32 + 20 * k)[0] for k in range(n)]


def feature(data: bytes) -> str:
    """Sum, sum of squares and 16-bin histogram of the samples, and the sum of their absolute steps."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{x.sum()}:{(x * x).sum()}:{np.abs(np.diff(x)).sum()}:{'-'.join(map(str, bins))}"


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    data, off, _ = _text.column(b, "text")
    for k in range(b.num_rows):
        yield k, data[off[k] : off[k + 1]].tobytes()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rid, text) to (id, rid, pid, manifest)."""
    for b in batches:
        pids, manifests = [], []
        for _, t in _texts(b):
            p, at, digests = payload(t), 0, []
            lengths = cuts(p)
            for n in lengths:
                digests.append(_digest(p[at : at + n]))
                at += n
            m = manifest(len(t), digests, lengths)
            pids.append(_digest(m))
            manifests.append(m)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _text.binary(pids), _text.binary(manifests)], ["id", "rid", "pid", "manifest"])


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, manifest) to (pid, seq, chunk), each payload's first use of a chunk."""
    for b in batches:
        pids, seqs, chunks = [], [], []
        for pid, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = set()
            for k, d in enumerate(read_manifest(m)[1]):
                if d not in seen:
                    seen.add(d)
                    pids.append(pid)
                    seqs.append(k)
                    chunks.append(d)
        yield pa.RecordBatch.from_arrays([_text.binary(pids), pa.array(seqs, pa.int32()), _text.binary(chunks)], ["pid", "seq", "chunk"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, skip) to (pid, manifest, whole, body): the bytes of a payload's own chunks, compressed. Each chunk once."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        rows = []
        skips = b.column(1).to_pylist()
        for k, t in _texts(b):
            p, at, digests, own = payload(t), 0, [], []
            lengths = cuts(p)
            skip, seen = set(skips[k] or ()), set()
            for s, n in enumerate(lengths):
                d = _digest(p[at : at + n])
                digests.append(d)
                if s not in skip and d not in seen:
                    own.append(p[at : at + n])
                seen.add(d)
                at += n
            m = manifest(len(t), digests, lengths)
            rows.append((_digest(m), m, not skip, press.compress(b"".join(own))))
        yield pa.RecordBatch.from_arrays([_text.binary([r[0] for r in rows]), _text.binary([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.bool_()), _text.binary([r[3] for r in rows])], ["pid", "manifest", "whole", "body"])


def _own(m: bytes, body: bytes, skip: set[int]) -> dict[bytes, bytes]:
    """Verified chunks of a store row by digest."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    _, digests, lengths = read_manifest(m)
    out, at = {}, 0
    lent = {digests[s] for s in skip}
    for d, n in zip(digests, lengths):
        if d in out or d in lent:
            continue
        out[d] = raw[at : at + n]
        at += n
        if _digest(out[d]) != d:
            raise ValueError("a stored chunk differs from its digest")
    return out


def _lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(manifest, body, skip, wanted digests) to (chunk, bytes)."""
    for b in batches:
        chunks, data = [], []
        for m, body, skip, wanted in zip(*(c.to_pylist() for c in b.columns)):
            own = _own(m, body, set(skip or ()))
            for d in wanted:
                chunks.append(d)
                data.append(own[d])
        yield pa.RecordBatch.from_arrays([_text.binary(chunks), _text.binary(data)], ["chunk", "bytes"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, manifest, body, skip, lent) to a payload's facts, from the stored bytes."""
    for b in batches:
        rows = []
        for pid, m, body, skip, lent in zip(*(c.to_pylist() for c in b.columns)):
            n_bytes, digests, _ = read_manifest(m)
            chunks = _own(m, body, set(skip or ()))
            for x in lent or ():
                if _digest(x["bytes"]) != x["chunk"]:
                    raise ValueError("a stored chunk differs from its digest")
                chunks[x["chunk"]] = x["bytes"]
            p = b"".join([chunks[d] for d in digests])
            rows.append((pid, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), len(digests)))
        names = ["pid", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _joined(big: DataFrame, small: DataFrame, on: str, size: int) -> DataFrame:
    """A left join that leaves ``big`` where it is if ``small`` is within BROADCAST bytes, and else shuffles both."""
    return big.join(F.broadcast(small) if size <= BROADCAST else small, on, "left")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunk store, documents, facts).

    chunk store: pid, manifest, whole, body, a row for each distinct payload; documents: (id, pid) for every row of ``docs``;
    facts: what was read back and verified, by pid. A null text is an empty one, whose payload is 64 bytes 0. Ids may be
    null or repeat. Other columns are ignored; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))), 16, "0")
    # 128 bits tell rows apart, so that none takes another for the one that stores its payload
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.concat(half(1), half(2))).alias("rid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    lists = scratch.write(arrow_map(source, _split, f"id {kind}, rid binary, pid binary, manifest binary"), "manifests")
    # one row of documents stores a payload: the least rid
    first = lists.groupBy("pid").agg(F.min("rid").alias("rid"), F.max("manifest").alias("manifest"))
    first = scratch.write(first, "payloads")
    refs = scratch.write(arrow_map(first.select("pid", "manifest"), _refs, "pid binary, seq int, chunk binary"), "refs")
    owner = refs.groupBy("chunk").agg(F.min(F.struct("pid", "seq")).alias("owner"), F.count("*").alias("uses")).filter("uses > 1").select("chunk", "owner")
    borrowed = scratch.write(refs.join(owner, "chunk").filter(F.struct("pid", "seq") != F.col("owner")).select("pid", "seq", "chunk", F.col("owner.pid").alias("from")), "borrowed")
    skip = scratch.write(borrowed.groupBy("pid").agg(F.collect_list("seq").alias("skip")), "skip")
    n_skip = borrowed.count()
    # rows of documents that store nothing, or not all
    idle = lists.select("rid", "pid").join(first.select("pid", F.col("rid").alias("keeper")), "pid").filter("rid <> keeper").select("rid", F.lit(None).cast("array<int>").alias("skip"), F.lit(True).alias("idle"))
    part = first.select("pid", "rid").join(skip, "pid").select("rid", "skip", F.lit(False).alias("idle"))
    less = scratch.write(idle.distinct().union(part), "less")
    n_less = less.count()
    rows = _joined(source.select("rid", "text"), less, "rid", 48 * n_less + 8 * n_skip).filter("not coalesce(idle, false)").select("text", "skip")
    kept = scratch.write(arrow_map(rows, _store, "pid binary, manifest binary, whole boolean, body binary"), "store")
    wanted = borrowed.groupBy(F.col("from").alias("pid")).agg(F.collect_set("chunk").alias("wanted"))
    wanted = scratch.write(wanted.join(skip, "pid", "left").select("pid", "skip", "wanted"), "wanted")
    lenders = kept.join(F.broadcast(wanted) if 32 * n_skip <= BROADCAST else wanted, "pid").select("manifest", "body", "skip", "wanted")
    lent = scratch.write(arrow_map(lenders, _lend, "chunk binary, bytes binary").groupBy("chunk").agg(F.max("bytes").alias("bytes")), "lent")
    got = borrowed.select("pid", "chunk").join(lent, "chunk").groupBy("pid").agg(F.collect_list(F.struct("chunk", "bytes")).alias("lent"))
    parts = kept.filter("not whole").join(skip, "pid").join(got, "pid").select("pid", "manifest", "body", "skip", "lent")
    wholes = kept.filter("whole").select("pid", "manifest", "body", F.lit(None).cast("array<int>").alias("skip"), F.lit(None).cast("array<struct<chunk:binary,bytes:binary>>").alias("lent"))
    schema = "pid binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    facts = arrow_map(wholes, _read, schema).union(arrow_map(parts, _read, schema))
    # rows equal in id and text store the same twice
    return kept, lists.select("id", "pid"), scratch.write(facts.dropDuplicates(["pid"]), "facts")


def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as payloads of 8-bit samples, through the chunk store and back."""
    _, docs, facts = store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.join(facts, "pid").drop("pid").withColumnRenamed("id", "doc_id")
