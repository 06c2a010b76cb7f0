"""Packet captures as event streams: source addresses of IPv4 and IPv6 packets, read from (gzipped) pcap files.

A file is one record stream, so a file is one task; its bytes are unpacked piece by
piece, and rows leave in batches.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import write_counts_jsonl

PACKET = "file string, pos long, micros long, src string"
BATCH = 100_000
#: A capture's first bytes, the byte order and the fractions of a second that they stand for.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
#: Link types and the bytes before the network layer's type or packet.
ETHERNET, RAW, RAW_OLD, COOKED, IP4, IP6 = 1, 101, 12, 113, 228, 229
TYPE4, TYPE6, VLAN = 0x0800, 0x86DD, (0x8100, 0x88A8)


def find_captures(spark: SparkSession, path: str, direction: str = "both") -> list[str]:
    """Capture files of a folder, else of its folders 20*, else of a pattern, in order of their paths; direction A or B keeps names with dirA or dirB."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    names: list[str] = []
    for pattern in (f"{path}/*.pcap*", f"{path}/20*/*.pcap*", path):
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern))
        names = [str(x.getPath().toString()) for x in found or [] if not x.isDirectory()]
        if names:
            break
    if direction != "both":
        names = [x for x in names if f"dir{direction}" in x.rsplit("/", 1)[-1]]
    return sorted(names)


def source(link: int, packet: bytes) -> str | None:
    """The source address of a captured packet, None where it has none that can be read."""
    at = 0
    if link == ETHERNET or link == COOKED:
        at = 14 if link == ETHERNET else 16
        if len(packet) < at:
            return None
        kind = int.from_bytes(packet[at - 2 : at], "big")
        while kind in VLAN and len(packet) >= at + 4:
            kind, at = int.from_bytes(packet[at + 2 : at + 4], "big"), at + 4
        if kind not in (TYPE4, TYPE6):
            return None
    elif link not in (RAW, RAW_OLD, IP4, IP6):
        return None
    version = packet[at] >> 4 if len(packet) > at else 0
    if version == 4 and len(packet) >= at + 20:
        return ".".join(map(str, packet[at + 12 : at + 16]))
    if version == 6 and len(packet) >= at + 40:
        import ipaddress

        return str(ipaddress.IPv6Address(packet[at + 8 : at + 24]))
    return None


def packets(stream: io.BufferedIOBase) -> Iterator[tuple[int, str | None]]:
    """(time in microseconds, source address) of each packet; a file cut off ends with its last whole packet."""
    head = stream.read(24)
    if len(head) < 24 or head[:4] not in MAGIC:
        raise ValueError("not a packet capture")
    order, fraction = MAGIC[head[:4]]
    link = struct.unpack(order + "I", head[20:])[0] & 0x0FFFFFFF
    record = struct.Struct(order + "IIII")
    while len(head := stream.read(16)) == 16:
        seconds, part, size, _ = record.unpack(head)
        body = stream.read(size)
        if len(body) < size:
            return
        yield seconds * 1_000_000 + part * 1_000_000 // fraction, source(link, body)


def read_packets(spark: SparkSession, path: str, direction: str = "both") -> DataFrame:
    """PACKET rows of all captures: file, number in the file, time, source address. Packets without one that can be read go."""
    files = find_captures(spark, path, direction)
    if not files:
        raise FileNotFoundError(f"no captures in {path}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                raw = io.BytesIO(content)
                rows = []
                for pos, (micros, src) in enumerate(packets(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)):
                    if src is not None:
                        rows.append((name, pos, micros, src))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["file", "pos", "micros", "src"])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "pos", "micros", "src"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(run, PACKET)


def packet_counts(found: DataFrame, seconds: float = 60.0, origin: float = 0.0) -> DataFrame:
    """(window, key, cnt): packets by window from the origin and source address. Earlier packets go."""
    at = F.floor((F.col("micros") / 1_000_000 - F.lit(origin)) / F.lit(seconds)).cast("long")
    return found.groupBy(at.alias("window"), F.col("src").alias("key")).agg(F.count("*").alias("cnt")).filter("window >= 0")


def write_packet_counts(found: DataFrame, path: str, seconds: float = 60.0, direction: str = "both") -> dict:
    """Lines of counts in path/counts, from the second of the first packet on; the files' statistics, a row a file, in path/metadata.json and returned."""
    first = found.agg(F.floor(F.min("micros") / 1_000_000).alias("first")).first().first
    write_counts_jsonl(packet_counts(found, seconds, float(first or 0)), f"{path}/counts")
    each = found.groupBy("file").agg(F.count("*").alias("packets"), F.min("micros").alias("first"), F.max("micros").alias("last")).orderBy("file").collect()
    told = {
        "dataset_start_time": first, "window_seconds": seconds, "direction": direction, "total_files_processed": len(each), "total_packets": sum(r.packets for r in each),
        "files": [{"file": r.file.rsplit("/", 1)[-1], "packets": r.packets, "first_timestamp": r.first / 1e6, "last_timestamp": r.last / 1e6} for r in each],
    }
    found.sparkSession.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata.json")
    return told
