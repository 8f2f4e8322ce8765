"""OpenEXR scan-line files, by the public format: half or float channels, plain or ZIP compressed. Tiles and other codecs are not read."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = 20000630
#: Bytes of the channel types, and lines of a chunk by compression (none, ZIP of one line, ZIP of sixteen).
KINDS = {0: "<u4", 1: "<f2", 2: "<f4"}
LINES = {0: 1, 2: 1, 3: 16}


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def _unpredict(raw: bytes) -> bytes:
    """Undo the byte differences and the split into even and odd bytes."""
    d = np.frombuffer(raw, np.uint8).astype(np.int64)
    d[1:] -= 128
    d = (np.cumsum(d) & 255).astype(np.uint8)
    half = (len(d) + 1) // 2
    out = np.empty(len(d), np.uint8)
    out[0::2], out[1::2] = d[:half], d[half:]
    return out.tobytes()


def _predict(raw: bytes) -> bytes:
    d = np.frombuffer(raw, np.uint8)
    d = np.concatenate([d[0::2], d[1::2]]).astype(np.int64)
    out = d.copy()
    out[1:] = d[1:] - d[:-1] + 128
    return (out & 255).astype(np.uint8).tobytes()


def write_exr(pixels: np.ndarray, half: bool = True, compress: bool = True) -> bytes:
    """(h, w, 3 or 4) floats."""
    h, w, n = pixels.shape
    names = sorted("RGBA"[:n])
    kind = 1 if half else 2
    channels = b"".join(c.encode() + b"\0" + struct.pack("<iBxxxii", kind, 0, 1, 1) for c in names) + b"\0"
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    compression = 3 if compress else 0
    head = struct.pack("<iI", MAGIC, 2)
    for name, type_name, value in (
        ("channels", "chlist", channels), ("compression", "compression", bytes([compression])), ("dataWindow", "box2i", box), ("displayWindow", "box2i", box),
        ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1)),
    ):
        head += _attribute(name, type_name, value)
    head += b"\0"
    order = ["RGBA".index(c) for c in names]
    chunks = []
    for y in range(0, h, LINES[compression]):
        part = pixels[y : y + LINES[compression], :, order].astype(KINDS[kind]).transpose(0, 2, 1).tobytes()
        packed = zlib.compress(_predict(part)) if compress else part
        packed = packed if len(packed) < len(part) else part
        chunks.append(struct.pack("<ii", y, len(packed)) + packed)
    at = len(head) + 8 * len(chunks)
    table = b""
    for c in chunks:
        table += struct.pack("<Q", at)
        at += len(c)
    return head + table + b"".join(chunks)


def read_exr(raw: bytes) -> np.ndarray:
    """(h, w, 4) floats; missing color channels are 0, missing alpha is 1."""
    magic, version = struct.unpack_from("<iI", raw)
    if magic != MAGIC or version & 0x1E00:
        raise ValueError("not a plain scan-line EXR file")
    at, fields = 8, {}
    while raw[at]:
        name, kind, end = (lambda a, b: (raw[at:a], raw[a + 1 : b], b + 1))(raw.index(b"\0", at), raw.index(b"\0", raw.index(b"\0", at) + 1))
        size = struct.unpack_from("<i", raw, end)[0]
        fields[name.decode()] = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
    at += 1
    channels, p = [], 0
    while fields["channels"][p]:
        end = fields["channels"].index(b"\0", p)
        channels.append((fields["channels"][p:end].decode(), struct.unpack_from("<i", fields["channels"], end + 1)[0]))
        p = end + 17
    compression = fields["compression"][0]
    if compression not in LINES:
        raise ValueError(f"EXR compression {compression} is not read")
    x0, y0, x1, y1 = struct.unpack("<4i", fields["dataWindow"])
    w, h = x1 - x0 + 1, y1 - y0 + 1
    out = np.zeros((h, w, 4), np.float32)
    out[..., 3] = 1
    line = sum(np.dtype(KINDS[k]).itemsize for _, k in channels) * w
    for i in range(-(-h // LINES[compression])):
        place = struct.unpack_from("<Q", raw, at + 8 * i)[0]
        y, size = struct.unpack_from("<ii", raw, place)
        rows = min(LINES[compression], h - (y - y0))
        data = raw[place + 8 : place + 8 + size]
        if compression and size < line * rows:
            data = _unpredict(zlib.decompress(data))
        p = 0
        for row in range(y - y0, y - y0 + rows):
            for name, kind in channels:
                n = np.dtype(KINDS[kind]).itemsize * w
                if name in "RGBA":
                    out[row, :, "RGBA".index(name)] = np.frombuffer(data, KINDS[kind], w, p)
                p += n
    return out
