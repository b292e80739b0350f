"""Capture files -> packets table (S5), decoded where Spark reads the file.

Classic libpcap files (microsecond or nanosecond, either byte order) and pcapng
files (enhanced, simple and obsolete packet blocks, time resolution per
interface) with Ethernet (optionally 802.1Q) or raw-IP link types; IPv4 only, as
the reference. Ports for TCP/UDP; TCP flags and window; TTL. The decoding is a
small per-packet helper run inside `mapInPandas` on the scan itself: no bytes
are shuffled, and packets leave in batches of bounded size. A capture is not
splittable inside a file.

A file that is no capture, or ends inside a packet, gives a row with `error`
set (and the packets before the damage).
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKET_SCHEMA = ("source_file string, packet_no long, ts_us long, src_ip string, src_port long, dst_ip string, "
                 "dst_port long, protocol long, pkt_len long, flags long, ttl long, win long, mss long, opts long, "
                 "payload binary")
CAPTURE_SCHEMA = PACKET_SCHEMA + ", source_path string, error string"
COLUMNS = [c.split()[0] for c in CAPTURE_SCHEMA.split(", ")]
BATCH = 10_000

# fixed values: file and block identifiers of the two capture formats
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
          b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_SECTION = b"\x0a\x0d\x0d\x0a"
_INTERFACE, _OBSOLETE, _SIMPLE, _ENHANCED = 1, 2, 3, 6
_TIME_RESOLUTION = 9


class CaptureError(ValueError):
    """The file is no capture, or is cut off."""


def _tcp_options(opt: bytes) -> tuple[int | None, int]:
    mss, n, i = None, 0, 0
    while i < len(opt):
        kind = opt[i]
        if kind == 0:
            break
        if kind == 1:
            i += 1
            continue
        if i + 1 >= len(opt):
            break
        length = opt[i + 1]
        if length < 2:
            break
        n += 1
        if kind == 2 and length == 4 and i + 4 <= len(opt):
            mss = struct.unpack_from(">H", opt, i + 2)[0]
        i += length
    return mss, n


def _classic_frames(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(link type, ts_us, original length, bytes) of each frame."""
    endian, div = _MAGIC[data[:4]]
    if len(data) < 24:
        raise CaptureError("file header cut off")
    link = struct.unpack_from(endian + "I", data, 20)[0]
    off = 24
    while off < len(data):
        if off + 16 > len(data):
            raise CaptureError("packet header cut off")
        sec, frac, incl, orig = struct.unpack_from(endian + "IIII", data, off)
        off += 16
        if off + incl > len(data):
            raise CaptureError("packet cut off")
        yield link, sec * 1_000_000 + frac // div, orig, data[off:off + incl]
        off += incl


def _units_per_second(options: bytes, endian: str) -> int:
    off = 0
    while off + 4 <= len(options):
        code, length = struct.unpack_from(endian + "HH", options, off)
        if code == 0:
            break
        if code == _TIME_RESOLUTION and length == 1:
            v = options[off + 4]
            return 2 ** (v & 0x7F) if v & 0x80 else 10 ** v
        off += 4 + length + -length % 4
    return 1_000_000


def _section_frames(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """The same of a pcapng file; frames without a time have time 0."""
    off, endian, interfaces = 0, "<", []
    while off < len(data):
        if off + 12 > len(data):
            raise CaptureError("block header cut off")
        if data[off:off + 4] == _SECTION:
            order = data[off + 8:off + 12]
            if order not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise CaptureError("no byte order")
            endian, interfaces = ("<" if order[0] == 0x4D else ">"), []
        kind, total = struct.unpack_from(endian + "II", data, off)
        if total < 12 or off + total > len(data):
            raise CaptureError("block cut off")
        body = data[off + 8:off + total - 4]
        if kind == _INTERFACE:
            interfaces.append((struct.unpack_from(endian + "H", body)[0], _units_per_second(body[8:], endian)))
        elif kind in (_ENHANCED, _OBSOLETE):
            if kind == _ENHANCED:
                number, high, low, incl, orig = struct.unpack_from(endian + "IIIII", body)
            else:
                number, _, high, low, incl, orig = struct.unpack_from(endian + "HHIIII", body)
            if number >= len(interfaces):
                raise CaptureError("unknown interface")
            link, units = interfaces[number]
            yield link, ((high << 32) | low) * 1_000_000 // units, orig, body[20:20 + incl]
        elif kind == _SIMPLE:
            if not interfaces:
                raise CaptureError("unknown interface")
            orig = struct.unpack_from(endian + "I", body)[0]
            yield interfaces[0][0], 0, orig, body[4:4 + orig]
        off += total


def decode_capture(name: str, data: bytes) -> Iterator[tuple]:
    """All IPv4 packets of one capture as packet rows."""
    if data[:4] in _MAGIC:
        frames = _classic_frames(data)
    elif data[:4] == _SECTION:
        frames = _section_frames(data)
    else:
        raise CaptureError("no capture file")
    for no, (link, ts_us, orig, pkt) in enumerate(frames, 1):
        ip_off = 0
        if link == 1:  # Ethernet
            if len(pkt) < 14:
                continue
            etype = struct.unpack_from(">H", pkt, 12)[0]
            ip_off = 14
            if etype == 0x8100 and len(pkt) >= 18:
                etype = struct.unpack_from(">H", pkt, 16)[0]
                ip_off = 18
            if etype != 0x0800:
                continue
        elif link not in (101, 228):  # raw IPv4
            continue
        ip = pkt[ip_off:]
        if len(ip) < 20 or ip[0] >> 4 != 4:
            continue
        ihl = (ip[0] & 0x0F) * 4
        ttl, proto = ip[8], ip[9]
        src, dst = socket.inet_ntoa(ip[12:16]), socket.inet_ntoa(ip[16:20])
        l4 = ip[ihl:]
        sport = dport = flags = win = mss = None
        opts = 0
        payload = b""
        if proto == 6 and len(l4) >= 20:
            sport, dport = struct.unpack_from(">HH", l4, 0)
            doff = (l4[12] >> 4) * 4
            flags, win = l4[13], struct.unpack_from(">H", l4, 14)[0]
            mss, opts = _tcp_options(l4[20:doff])
            payload = l4[doff:]
        elif proto == 17 and len(l4) >= 8:
            sport, dport = struct.unpack_from(">HH", l4, 0)
            payload = l4[8:]
        yield name, no, ts_us, src, sport, dst, dport, proto, orig, flags, ttl, win, mss, opts, payload


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    name = path.rsplit("/", 1)[-1]
    try:
        for row in decode_capture(name, data):
            yield *row, path, None
    except (CaptureError, struct.error) as e:
        yield name, *[None] * 14, path, str(e)


def read_capture_rows(spark: SparkSession, paths, glob: str = "*.{pcap,pcapng,cap}") -> DataFrame:
    """Packets of all captures, and one row with `error` per damaged file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(paths).select("path", "content")

    def run(batches):
        rows = []
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for row in _rows(path, bytes(content)):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
        yield pd.DataFrame(rows, columns=COLUMNS)

    return files.mapInPandas(run, CAPTURE_SCHEMA)


def read_captures(spark: SparkSession, paths, glob: str = "*.{pcap,pcapng,cap}") -> DataFrame:
    """Packets of all readable captures."""
    return read_capture_rows(spark, paths, glob).where("error is null").drop("error", "source_path")


def capture_summary(spark: SparkSession, paths, glob: str = "*.{pcap,pcapng,cap}") -> DataFrame:
    """Per capture file, by its whole path: packets and SUCCESS, EMPTY or ERROR
    with the reason (S14)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(paths).select(F.col("path").alias("source_path"), "length")
    seen = read_capture_rows(spark, paths, glob).groupBy("source_path") \
        .agg(F.count("packet_no").alias("packets"), F.max("error").alias("error"))
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("packets") > 0, "SUCCESS").otherwise("EMPTY")
    return files.join(seen, "source_path", "left").select(
        "source_path", "length", F.coalesce("packets", F.lit(0)).alias("packets"), status.alias("status"), "error")


def frame_bytes(src: str, sport: int, dst: str, dport: int, proto: int, flags: int, payload: bytes) -> bytes:
    """An Ethernet frame with an IPv4 packet (tests and derived captures)."""
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 1024, 0, 0) + payload
    else:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0,
                     socket.inet_aton(src), socket.inet_aton(dst)) + l4
    return b"\x00" * 12 + b"\x08\x00" + ip


def capture_bytes(packets: list[tuple], ng: bool = False) -> bytes:
    """A small capture of (ts_us, src, sport, dst, dport, proto, flags, payload)."""
    if not ng:
        out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
        for ts_us, *packet in packets:
            frame = frame_bytes(*packet)
            out.append(struct.pack("<IIII", ts_us // 1_000_000, ts_us % 1_000_000, len(frame), len(frame)) + frame)
        return b"".join(out)

    def block(kind: int, body: bytes) -> bytes:
        body += b"\x00" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = [block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)),
           block(_INTERFACE, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3xHH", _TIME_RESOLUTION, 1, 9, 0, 0))]
    for ts_us, *packet in packets:
        frame, ts = frame_bytes(*packet), ts_us * 1000
        out.append(block(_ENHANCED, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame)) + frame))
    return b"".join(out)


def write_capture(path: str, packets: list[tuple], ng: bool = False) -> None:
    """Write a small Ethernet/IPv4 capture (tests)."""
    with open(path, "wb") as f:
        f.write(capture_bytes(packets, ng))
