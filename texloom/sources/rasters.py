"""Picture files in memory: TGA, PNG, QOI, Radiance. Readers give (h, w, 4) arrays, writers take them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np


def read_tga(raw: bytes) -> np.ndarray:
    """True color or gray, 8 to 32 bits, plain or run-length coded, either row order."""
    id_size, mapped, kind = raw[0], raw[1], raw[2]
    w, h, bits, flags = struct.unpack_from("<HHBB", raw, 12)
    if mapped or kind not in (2, 3, 10, 11) or bits not in (8, 24, 32):
        raise ValueError("this kind of TGA file is not read")
    n, at = bits // 8, 18 + id_size
    if kind >= 10:
        out = bytearray()
        while len(out) < w * h * n:
            head = raw[at]
            count = (head & 127) + 1
            at += 1
            if head & 128:
                out += raw[at : at + n] * count
                at += n
            else:
                out += raw[at : at + count * n]
                at += count * n
        data = bytes(out[: w * h * n])
    else:
        data = raw[at : at + w * h * n]
    texels = np.frombuffer(data, np.uint8).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = texels[..., [0, 0, 0]] if n == 1 else texels[..., 2::-1]
    if n == 4:
        out[..., 3] = texels[..., 3]
    if not flags & 0x20:
        out = out[::-1]
    return out[:, ::-1].copy() if flags & 0x10 else out.copy()


def write_tga(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    return struct.pack("<BBB5sHHHHBB", 0, 0, 2, b"\0" * 5, 0, 0, w, h, 32, 0x28) + pixels[..., [2, 1, 0, 3]].astype(np.uint8).tobytes()


def _png_rows(data: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Undo the five line filters."""
    out = np.zeros((h, stride), np.uint8)
    before, at = np.zeros(stride, np.int64), 0
    for y in range(h):
        kind = data[at]
        line = np.frombuffer(data, np.uint8, stride, at + 1).astype(np.int64)
        at += stride + 1
        if kind == 1:
            for i in range(step):
                line[i::step] = np.cumsum(line[i::step]) & 255
        elif kind == 2:
            line = (line + before) & 255
        elif kind in (3, 4):
            for i in range(stride):
                a, c = (line[i - step], before[i - step]) if i >= step else (0, 0)
                b = before[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda x, p=a + b - c: abs(p - x))
                line[i] = (line[i] + guess) & 255
        elif kind:
            raise ValueError("unknown PNG line filter")
        out[y], before = line, line
    return out


def read_png(raw: bytes) -> np.ndarray:
    """8- and 16-bit gray and color, with or without alpha, and palettes of any depth; not interlaced. 16 bits keep the high byte."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, palette, clear = 8, b"", None, b""
    w = h = depth = kind = 0
    while at < len(raw):
        size, tag = struct.unpack_from(">I4s", raw, at)
        part = raw[at + 8 : at + 8 + size]
        if zlib.crc32(tag + part) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError("a PNG chunk's checksum is wrong")
        at += 12 + size
        if tag == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if interlaced:
                raise ValueError("interlaced PNG files are not read")
        elif tag == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif tag == b"tRNS":
            clear = part
        elif tag == b"IDAT":
            body += part
        elif tag == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    stride = (w * channels * depth + 7) // 8
    rows = _png_rows(zlib.decompress(body), h, stride, max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        v = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, : w * channels].reshape(h, w, channels)
        if kind == 0:
            v = v * 255 // ((1 << depth) - 1)
    else:
        v = rows.reshape(h, w, channels, depth // 8)[..., 0]
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        out[..., :3] = palette[v[..., 0]]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[v[..., 0]]
    else:
        out[..., :3] = v[..., :3] if channels > 2 else v[..., [0, 0, 0]]
        if channels in (2, 4):
            out[..., 3] = v[..., -1]
    return out


def write_png(pixels: np.ndarray) -> bytes:
    """8-bit color, with alpha where some texel is not opaque; each row is filtered by the one above."""
    h, w = pixels.shape[:2]
    alpha = bool((pixels[..., 3] < 255).any())
    body = pixels.astype(np.uint8) if alpha else pixels[..., :3].astype(np.uint8)
    rows = body.reshape(h, -1)
    up = rows.copy()
    up[1:] -= rows[:-1]
    data = b"".join(b"\2" + r.tobytes() for r in up)

    def chunk(tag: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + tag + part + struct.pack(">I", zlib.crc32(tag + part))

    head = struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(data, 6)) + chunk(b"IEND", b"")


def read_qoi(raw: bytes) -> np.ndarray:
    """The "quite OK" format: index, small differences, luma differences, runs, plain texels."""
    magic, w, h, _, _ = struct.unpack_from(">4sIIBB", raw)
    if magic != b"qoif":
        raise ValueError("not a QOI file")
    seen, p = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255)
    out, at, n = bytearray(), 14, w * h
    done = 0
    while done < n:
        b = raw[at]
        at += 1
        run = 1
        if b == 254:
            p = (*raw[at : at + 3], p[3])
            at += 3
        elif b == 255:
            p = tuple(raw[at : at + 4])
            at += 4
        elif b >> 6 == 0:
            p = seen[b]
        elif b >> 6 == 1:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        elif b >> 6 == 2:
            c, g = raw[at], (b & 63) - 32
            at += 1
            p = ((p[0] + g + (c >> 4) - 8) & 255, (p[1] + g) & 255, (p[2] + g + (c & 15) - 8) & 255, p[3])
        else:
            run = (b & 63) + 1
        seen[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out += bytes(p) * run
        done += run
    return np.frombuffer(bytes(out[: 4 * n]), np.uint8).reshape(h, w, 4).copy()


def write_qoi(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    out = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, 4, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for p in map(tuple, pixels.reshape(-1, 4).tolist()):
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        if seen[slot] == p:
            out.append(slot)
        elif p[3] != last[3]:
            out += bytes((255, *p))
        else:
            dr, dg, db = ((p[i] - last[i] + 128 & 255) - 128 for i in range(3))
            if all(-2 <= d <= 1 for d in (dr, dg, db)):
                out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((254, *p[:3]))
        seen[slot], last = p, p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + b"\0" * 7 + b"\1"


def read_radiance(raw: bytes) -> np.ndarray:
    """Radiance RGBE, plain or with run-length coded lines: (h, w, 3) floats."""
    if not raw.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise ValueError("not a Radiance file")
    at = raw.index(b"\n\n") + 2
    end = raw.index(b"\n", at)
    words = raw[at:end].split()
    if words[0] != b"-Y" or words[2] != b"+X":
        raise ValueError("only the usual row order is read")
    h, w, at = int(words[1]), int(words[3]), end + 1
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and raw[at : at + 2] == b"\2\2" and raw[at + 2] << 8 | raw[at + 3] == w:
            at += 4
            for c in range(4):
                x = 0
                while x < w:
                    n = raw[at]
                    at += 1
                    if n > 128:
                        out[y, x : x + n - 128, c] = raw[at]
                        x, at = x + n - 128, at + 1
                    else:
                        out[y, x : x + n, c] = np.frombuffer(raw, np.uint8, n, at)
                        x, at = x + n, at + n
        else:
            out[y] = np.frombuffer(raw, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
    scale = np.where(out[..., 3] > 0, np.exp2(out[..., 3].astype(float) - 136), 0)
    return (out[..., :3] * scale[..., None]).astype(np.float32)


def write_radiance(pixels: np.ndarray) -> bytes:
    """(h, w, 3) floats as plain RGBE lines."""
    h, w = pixels.shape[:2]
    largest = pixels.max(axis=-1)
    fraction, exponent = np.frexp(largest)
    scale = np.where(largest > 1e-32, fraction * 256 / np.maximum(largest, 1e-38), 0)
    out = np.zeros((h, w, 4), np.uint8)
    out[..., :3] = np.clip(pixels * scale[..., None], 0, 255)
    out[..., 3] = np.where(largest > 1e-32, exponent + 128, 0)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {h} +X {w}\n".encode() + out.tobytes()


READERS: dict[str, Callable[[bytes], np.ndarray]] = {"tga": read_tga, "png": read_png, "qoi": read_qoi}
WRITERS: dict[str, Callable[[np.ndarray], bytes]] = {"tga": write_tga, "png": write_png, "qoi": write_qoi}
