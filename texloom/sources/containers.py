"""Texture containers in memory: DDS, ASTC, KTX, KTX2 and slice files (header tables).

Readers give one entry a (level, layer, face) with its bytes; the reader of slice files gives the header and slice tables only, since the
slice bodies' format is not described by any source at hand.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa

from texloom.operators.entropy import crc16_of


@dataclass
class Image:
    """One image of a container: its place, size and bytes."""

    level: int
    layer: int
    face: int
    width: int
    height: int
    data: bytes


@dataclass
class Texture:
    fmt: str
    width: int
    height: int
    images: list[Image] = field(default_factory=list)
    key_values: dict[str, bytes] = field(default_factory=dict)


#: Fixed values: (four-character code or DXGI number, block bytes) of the formats in DDS files.
DDS_CODES = {"BC1": (b"DXT1", 71, 8), "BC3": (b"DXT5", 77, 16), "BC4": (b"ATI1", 80, 8), "BC5": (b"ATI2", 83, 16), "BC7": (b"", 98, 16), "BC6H": (b"", 95, 16)}
#: Vulkan format numbers and block bytes of the formats in KTX2 files.
VK_FORMATS = {"RGBA32": (37, 0), "BC1": (131, 8), "BC3": (137, 16), "BC4": (139, 8), "BC5": (141, 16), "BC6H": (143, 16), "BC7": (145, 16), "ETC2_RGBA": (151, 16), "ASTC_LDR_4x4": (157, 16)}
#: OpenGL internal formats of the formats in KTX files.
GL_FORMATS = {"RGBA32": 0x8058, "BC1": 0x83F1, "BC3": 0x83F3, "BC4": 0x8DBB, "BC5": 0x8DBD, "ETC1": 0x8D64, "ETC2_RGBA": 0x9278, "ASTC_LDR_4x4": 0x93B0}
KTX2_MARK, KTX_MARK = b"\xabKTX 20\xbb\r\n\x1a\n", b"\xabKTX 11\xbb\r\n\x1a\n"


def level_size(fmt: str, w: int, h: int) -> int:
    """Bytes of one image: four a texel, or blocks of 4 x 4."""
    block = {"ETC1": 8} | {k: v[1] for k, v in VK_FORMATS.items()}
    return w * h * 4 if not block[fmt] else -(-w // 4) * -(-h // 4) * block[fmt]


def _levels(t: Texture) -> list[list[Image]]:
    count = max(i.level for i in t.images) + 1
    return [sorted((i for i in t.images if i.level == n), key=lambda i: (i.layer, i.face)) for n in range(count)]


def write_dds(t: Texture) -> bytes:
    """One layer a face: RGBA texels with masks, or blocks; newer formats and arrays by the extended header."""
    levels = len(_levels(t))
    layers, faces = max(i.layer for i in t.images) + 1, max(i.face for i in t.images) + 1
    plain = t.fmt == "RGBA32"
    code, dxgi, _ = (b"", 28, 0) if plain else DDS_CODES[t.fmt]
    extended = layers > 1 or not plain and not code
    flags = 0x1007 | (0x8 if plain else 0x80000) | (0x20000 if levels > 1 else 0)
    pitch = t.width * 4 if plain else level_size(t.fmt, t.width, t.height)
    head = struct.pack("<4s7I44x", b"DDS ", 124, flags, t.height, t.width, pitch, 0, levels)
    if plain and not extended:
        head += struct.pack("<2I4s5I", 32, 0x41, b"\0" * 4, 32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000)
    else:
        head += struct.pack("<2I4s20x", 32, 4, b"DX10" if extended else code)
    head += struct.pack("<5I", 0x1000 | (0x400008 if levels > 1 else 0) | (8 if faces > 1 else 0), 0xFE00 if faces == 6 else 0, 0, 0, 0)
    if extended:
        head += struct.pack("<5I", dxgi, 3, 4 if faces == 6 else 0, layers, 0)
    return head + b"".join(i.data for i in sorted(t.images, key=lambda i: (i.layer, i.face, i.level)))


def read_dds(raw: bytes) -> Texture:
    if raw[:4] != b"DDS " or struct.unpack_from("<I", raw, 4)[0] != 124:
        raise ValueError("not a DDS file")
    h, w = struct.unpack_from("<II", raw, 12)
    levels = max(1, struct.unpack_from("<I", raw, 28)[0])
    kind, code, bits, r, g, b, _ = struct.unpack_from("<I4s5I", raw, 80)
    caps = struct.unpack_from("<I", raw, 112)[0]
    at, layers, faces, swap = 128, 1, 6 if caps & 0x200 else 1, False
    if kind & 4 and code == b"DX10":
        dxgi, _, misc, layers, _ = struct.unpack_from("<5I", raw, 128)
        at, faces = 148, 6 if misc & 4 else 1
        fmt = {v[1]: k for k, v in DDS_CODES.items()} | {28: "RGBA32"}
        if dxgi not in fmt:
            raise ValueError(f"DXGI format {dxgi} is not read")
        fmt = fmt[dxgi]
    elif kind & 4:
        found = [k for k, v in DDS_CODES.items() if v[0] == code]
        if not found:
            raise ValueError(f"DDS code {code!r} is not read")
        fmt = found[0]
    elif bits == 32 and g == 0xFF00 and {r, b} == {0xFF, 0xFF0000}:
        fmt, swap = "RGBA32", b == 0xFF
    else:
        raise ValueError("these DDS masks are not read")
    out = Texture(fmt, w, h)
    for layer in range(layers):
        for face in range(faces):
            for level in range(levels):
                lw, lh = max(1, w >> level), max(1, h >> level)
                n = level_size(fmt, lw, lh)
                data = raw[at : at + n]
                if len(data) < n:
                    raise ValueError("the DDS file ends early")
                if swap:
                    data = bytes(data[i ^ 2 if i % 2 == 0 else i] for i in range(n))
                out.images.append(Image(level, layer, face, lw, lh, data))
                at += n
    return out


def write_astc(w: int, h: int, block_w: int, block_h: int, blocks: bytes) -> bytes:
    return b"\x13\xab\xa1\x5c" + bytes((block_w, block_h, 1)) + b"".join(x.to_bytes(3, "little") for x in (w, h, 1)) + blocks


def read_astc(raw: bytes) -> tuple[int, int, int, int, list[bytes]]:
    """Size, block size and the blocks in raster order."""
    if raw[:4] != b"\x13\xab\xa1\x5c":
        raise ValueError("not an ASTC file")
    bw, bh = raw[4], raw[5]
    w, h = (int.from_bytes(raw[7 + 3 * i : 10 + 3 * i], "little") for i in range(2))
    n = -(-w // bw) * -(-h // bh)
    if len(raw) < 16 + 16 * n:
        raise ValueError("the ASTC file ends early")
    return w, h, bw, bh, [raw[16 + 16 * i : 32 + 16 * i] for i in range(n)]


def constant_block(block: bytes) -> tuple[int, int, int, int] | None:
    """The 8-bit color of a void-extent block of low range, else null."""
    head = int.from_bytes(block[:8], "little")
    if head & 0x1FF != 0x1FC or head & 0x200:
        return None
    return tuple(block[9 + 2 * i] for i in range(4))


def make_constant_block(color: tuple[int, int, int, int]) -> bytes:
    """A void-extent block without an extent."""
    return (0xFFFFFFFFFFFFFDFC).to_bytes(8, "little") + b"".join(bytes((c, c)) for c in color)


def write_ktx(t: Texture) -> bytes:
    """The first version of the container."""
    layers, faces = max(i.layer for i in t.images) + 1, max(i.face for i in t.images) + 1
    plain = t.fmt == "RGBA32"
    pairs = b""
    for k, v in sorted(t.key_values.items()):
        part = k.encode() + b"\0" + v
        pairs += struct.pack("<I", len(part)) + part + b"\0" * (-len(part) % 4)
    levels = _levels(t)
    gl = (0x1401, 1, 0x1908) if plain else (0, 1, 0)
    head = struct.pack("<12s13I", KTX_MARK, 0x04030201, *gl, GL_FORMATS[t.fmt], 0x1908, t.width, t.height, 0, layers if layers > 1 else 0, faces, len(levels), len(pairs))
    body = b""
    for images in levels:
        data = b"".join(i.data for i in images)
        size = len(images[0].data) if faces == 6 and layers == 1 else len(data)
        body += struct.pack("<I", size) + data + b"\0" * (-len(data) % 4)
    return head + pairs + body


def read_ktx(raw: bytes) -> Texture:
    """The first version of the container, in little-endian order."""
    if raw[:12] != KTX_MARK:
        raise ValueError("not a KTX file")
    if len(raw) < 64 or struct.unpack_from("<I", raw, 12)[0] != 0x04030201:
        raise ValueError("only little-endian KTX files are read")
    _, _, _, internal, _, w, h, depth, layers, faces, levels, pairs = struct.unpack_from("<12I", raw, 16)
    fmt = next((k for k, v in GL_FORMATS.items() if v == internal), None)
    if fmt is None or depth > 1 or faces not in (1, 6):
        raise ValueError("a format or kind of texture that is not read")
    out, at = Texture(fmt, w, h), 64
    end = at + pairs
    while at + 4 <= min(end, len(raw)):
        size = struct.unpack_from("<I", raw, at)[0]
        key, _, value = raw[at + 4 : at + 4 + size].partition(b"\0")
        out.key_values[key.decode("utf-8", "replace")] = value
        at += 4 + size + -size % 4
    at = end
    for level in range(max(levels, 1)):
        lw, lh = max(w >> level, 1), max(h >> level, 1)
        size, begin = level_size(fmt, lw, lh), at + 4
        if begin + size * max(layers, 1) * faces > len(raw):
            raise ValueError("the file ends inside a level")
        at = begin
        for layer in range(max(layers, 1)):
            for face in range(faces):
                out.images.append(Image(level, layer, face, lw, lh, raw[at : at + size]))
                at += size + (-size % 4 if faces == 6 and layers == 0 else 0)
        at += -(at - begin) % 4
    return out


def _descriptor(fmt: str) -> bytes:
    """Data format descriptor: one basic block with a sample for the color (and one for alpha where a format stores it apart)."""
    model = {"RGBA32": 1, "BC1": 128, "BC3": 130, "BC4": 131, "BC5": 132, "BC6H": 133, "BC7": 134, "ETC2_RGBA": 161, "ASTC_LDR_4x4": 162}[fmt]
    bits = VK_FORMATS[fmt][1] * 8
    if fmt == "RGBA32":
        samples = [(8 * i, 7, c) for i, c in enumerate((0, 1, 2, 15))]
    elif fmt in ("BC3", "ETC2_RGBA"):
        samples = [(0, 63, 15), (64, 63, 0)]
    elif fmt == "BC5":
        samples = [(0, 63, 0), (64, 63, 1)]
    else:
        samples = [(0, bits - 1, 0)]
    side, plane = (0, 4) if fmt == "RGBA32" else (3, bits // 8)
    size = 24 + 16 * len(samples)
    out = struct.pack("<IIHH4B4B8B", size + 4, 0, 2, size, model, 1, 1, 0, side, side, 0, 0, plane, *[0] * 7)
    return out + b"".join(struct.pack("<HBBIII", offset, length, channel, 0, 0, 0xFFFFFFFF) for offset, length, channel in samples)


def write_ktx2(t: Texture, zstd: bool = False) -> bytes:
    """Levels from the smallest to the largest, each one compressed where asked for."""
    layers, faces = max(i.layer for i in t.images) + 1, max(i.face for i in t.images) + 1
    levels = _levels(t)
    number, block = VK_FORMATS[t.fmt]
    dfd = _descriptor(t.fmt)
    pairs = b""
    for k, v in sorted(t.key_values.items()):
        part = k.encode() + b"\0" + v
        pairs += struct.pack("<I", len(part)) + part + b"\0" * (-len(part) % 4)
    dfd_at = 80 + 24 * len(levels)
    pairs_at = dfd_at + len(dfd)
    at, index, body = pairs_at + len(pairs), {}, b""
    for n in range(len(levels) - 1, -1, -1):
        data = b"".join(i.data for i in levels[n])
        stored = pa.Codec("zstd").compress(data, asbytes=True) if zstd else data
        gap = b"" if zstd else b"\0" * (-at % max(4, block))
        index[n] = struct.pack("<3Q", at + len(gap), len(stored), len(data))
        body += gap + stored
        at += len(gap) + len(stored)
    head = struct.pack("<12s13I2Q", KTX2_MARK, number, 1, t.width, t.height, 0, layers if layers > 1 else 0, faces, len(levels), 2 if zstd else 0, dfd_at, len(dfd), pairs_at if pairs else 0, len(pairs), 0, 0)
    return head + b"".join(index[n] for n in range(len(levels))) + dfd + pairs + body


def ktx2_header(raw: bytes) -> dict:
    """The header's fields and the level index."""
    if raw[:12] != KTX2_MARK:
        raise ValueError("not a KTX2 file")
    names = ("vk_format", "type_size", "width", "height", "depth", "layers", "faces", "levels", "scheme", "dfd_at", "dfd_size", "pairs_at", "pairs_size", "global_at", "global_size")
    out = dict(zip(names, struct.unpack_from("<13I2Q", raw, 12), strict=True))
    if not 1 <= out["levels"] <= 16 or out["faces"] not in (1, 6) or out["layers"] > 65535:
        raise ValueError("the KTX2 header is out of range")
    out["index"] = [struct.unpack_from("<3Q", raw, 80 + 24 * i) for i in range(out["levels"])]
    return out


def read_ktx2(raw: bytes) -> Texture:
    head = ktx2_header(raw)
    names = {v[0]: k for k, v in VK_FORMATS.items()}
    if head["vk_format"] not in names or head["scheme"] not in (0, 2):
        raise ValueError(f"KTX2 format {head['vk_format']} with scheme {head['scheme']} is not read")
    out = Texture(names[head["vk_format"]], head["width"], head["height"])
    at, end = head["pairs_at"], head["pairs_at"] + head["pairs_size"]
    while at < end:
        n = struct.unpack_from("<I", raw, at)[0]
        key, _, value = raw[at + 4 : at + 4 + n].partition(b"\0")
        out.key_values[key.decode()] = value
        at += 4 + n + -n % 4
    for level, (place, stored, size) in enumerate(head["index"]):
        data = raw[place : place + stored]
        if len(data) < stored:
            raise ValueError("the KTX2 file ends early")
        data = pa.Codec("zstd").decompress(data, size, asbytes=True) if head["scheme"] == 2 else data
        w, h = max(1, head["width"] >> level), max(1, head["height"] >> level)
        n, faces = level_size(out.fmt, w, h), head["faces"]
        out.images += [Image(level, i // faces, i % faces, w, h, data[i * n : i * n + n]) for i in range(max(1, head["layers"]) * faces)]
    return out


#: Fields of the slice file header and of its slice descriptors, with their bytes (little endian).
SLICE_FILE_HEADER = (
    ("sig", 2), ("version", 2), ("header_size", 2), ("header_crc", 2), ("data_size", 4), ("data_crc", 2), ("slices", 3), ("images", 3), ("tex_format", 1), ("flags", 2), ("tex_type", 1), ("us_per_frame", 3),
    ("reserved", 4), ("userdata0", 4), ("userdata1", 4), ("endpoints", 2), ("endpoints_at", 4), ("endpoints_size", 3), ("selectors", 2), ("selectors_at", 4), ("selectors_size", 3),
    ("tables_at", 4), ("tables_size", 4), ("slices_at", 4), ("extended_at", 4), ("extended_size", 4),
)
SLICE_ENTRY = (("image", 3), ("level", 1), ("flags", 1), ("orig_width", 2), ("orig_height", 2), ("blocks_x", 2), ("blocks_y", 2), ("at", 4), ("size", 4), ("crc", 2))


def _fields(raw: bytes, at: int, layout: tuple) -> dict[str, int]:
    out = {}
    for name, size in layout:
        out[name] = int.from_bytes(raw[at : at + size], "little")
        at += size
    return out


def _pack(values: dict[str, int], layout: tuple) -> bytes:
    return b"".join(values.get(name, 0).to_bytes(size, "little") for name, size in layout)


def read_slice_file(raw: bytes) -> tuple[dict[str, int], list[dict[str, int]]]:
    """The header and the slice table; checksums are verified."""
    head = _fields(raw, 0, SLICE_FILE_HEADER)
    size = sum(n for _, n in SLICE_FILE_HEADER)
    if head["sig"] != 0x4273 or head["header_size"] != size:
        raise ValueError("not a slice file")
    if crc16_of(raw[8:size]) != head["header_crc"] or crc16_of(raw[size : size + head["data_size"]]) != head["data_crc"]:
        raise ValueError("a slice file checksum is wrong")
    step = sum(n for _, n in SLICE_ENTRY)
    slices = [_fields(raw, head["slices_at"] + step * i, SLICE_ENTRY) for i in range(head["slices"])]
    for s in slices:
        if crc16_of(raw[s["at"] : s["at"] + s["size"]]) != s["crc"]:
            raise ValueError("a slice's checksum is wrong")
    return head, slices


def write_slice_file(head: dict[str, int], slices: list[tuple[dict[str, int], bytes]], endpoints: bytes = b"", selectors: bytes = b"", tables: bytes = b"") -> bytes:
    """Assemble header, slice table, codebooks, tables and slice bodies, with running offsets and checksums."""
    size, step = sum(n for _, n in SLICE_FILE_HEADER), sum(n for _, n in SLICE_ENTRY)
    at = size + step * len(slices)
    values = dict(head) | {"sig": 0x4273, "version": head.get("version", 0x13), "header_size": size, "slices": len(slices), "slices_at": size}
    body = b""
    for name, part in (("endpoints", endpoints), ("selectors", selectors), ("tables", tables)):
        if part:
            values[f"{name}_at"], values[f"{name}_size"] = at + len(body), len(part)
            body += part
    table = b""
    for s, data in slices:
        table += _pack(s | {"at": at + len(body), "size": len(data), "crc": crc16_of(data)}, SLICE_ENTRY)
        body += data
    data = table + body
    values |= {"data_size": len(data), "data_crc": crc16_of(data)}
    values["header_crc"] = crc16_of(_pack(values, SLICE_FILE_HEADER)[8:])
    return _pack(values, SLICE_FILE_HEADER) + data
