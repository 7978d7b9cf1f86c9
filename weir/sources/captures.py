"""Packet captures: TCP headers of Ethernet frames, by an Arrow-batched decoder.

Spark has no reader for captures. A file is one binary cell, or mapped by the task where it is long and in a file system
that tasks see as well; its frames are walked in order and leave the worker in batches.
"""

from __future__ import annotations

import ipaddress
import mmap
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.sources.tables import CELL

_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
SCHEMA = "path string, ordinal long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, proto string, pkt_len int, flags int"


def address(raw: bytes) -> str:
    """Text of a 4- or 16-byte address, else blank."""
    return str(ipaddress.ip_address(raw)) if len(raw) in (4, 16) else ""


def frames(data: bytes | mmap.mmap) -> Iterator[tuple[float, bytes]]:
    """(seconds, frame) of a capture in either format; a cut file ends early."""
    if data[:4] in _MAGIC:
        order, unit = _MAGIC[data[:4]]
        at = 24
        while at + 16 <= len(data):
            sec, part, size, _ = struct.unpack_from(order + "IIII", data, at)
            at += 16
            yield sec + part * unit, data[at : at + size]
            at += size
    elif data[:4] == b"\x0a\x0d\x0d\x0a":
        order, at, unit = "<", 0, 1e-6
        while at + 12 <= len(data):
            if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
                order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            kind, size = struct.unpack_from(order + "II", data, at)
            if size < 12:
                return
            if kind == 6 and at + 28 <= len(data):
                high, low, kept = struct.unpack_from(order + "III", data, at + 12)
                yield ((high << 32) | low) * unit, data[at + 28 : at + 28 + kept]
            at += size


def tcp(frame: bytes) -> tuple[str, str, int, int, int] | None:
    """(source, destination, ports, flags) of an Ethernet frame that carries TCP over IPv4 or IPv6."""
    if len(frame) < 34:
        return None
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    if kind == 0x8100:
        kind, at = struct.unpack_from(">H", frame, 16)[0], 18
    if kind == 0x0800:
        if frame[at] >> 4 != 4 or frame[at + 9] != 6:
            return None
        src, dst, at = frame[at + 12 : at + 16], frame[at + 16 : at + 20], at + (frame[at] & 15) * 4
    elif kind == 0x86DD and len(frame) >= at + 40:
        if frame[at + 6] != 6:
            return None
        src, dst, at = frame[at + 8 : at + 24], frame[at + 24 : at + 40], at + 40
    else:
        return None
    if len(frame) < at + 14:
        return None
    a, b = struct.unpack_from(">HH", frame, at)
    return address(src), address(dst), a, b, frame[at + 13]


def read_captures(spark: SparkSession, root: str, pattern: str = "*.pcap*") -> DataFrame:
    """One row per TCP packet of the captures below ``root``; ``pkt_len`` is the whole frame. Other and broken frames are left out.

    Captures of over ``CELL`` bytes under ``file:`` are mapped by path, at any length; in other stores a capture is one cell, of 2 GB at most.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    long = [r["path"] for r in files.filter(F.col("length") > CELL).select("path").collect()]
    mapped = [p for p in long if p.startswith("file:")]
    # a filter of the length alone keeps contents unread
    parts = [files.filter(F.col("length") <= CELL).select("path", "content")]
    if len(mapped) < len(long):
        parts.append(files.filter(F.col("length") > CELL).filter(~F.col("path").startswith("file:")).select("path", "content"))
    if mapped:
        # a task per capture
        parts.append(spark.createDataFrame([(p, None) for p in mapped], "path string, content binary").repartition(len(mapped)))
    files = reduce(DataFrame.unionByName, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ordinal", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "pkt_len", "flags"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                data = content.as_py()
                if data is None:
                    with open(path.removeprefix("file:"), "rb") as f:
                        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                for k, (ts, frame) in enumerate(frames(data)):
                    if found := tcp(frame):
                        rows.append((path, k, ts, *found[:4], "tcp", len(frame), found[4]))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    return files.mapInArrow(run, SCHEMA)
