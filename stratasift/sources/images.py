"""Image headers, block-compressed textures, console textures, and a PNG writer, in numpy."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def read_header(blob: bytes, extension: str = "") -> dict | None:
    """{"format", "width", "height"} of an image by its first bytes; TGA only by its extension. None for anything else."""
    made = lambda form, w, h, **more: {"format": form, "width": int(w), "height": int(h), **more}
    at = lambda form, place: struct.unpack_from(form, blob, place)
    try:
        if blob.startswith(b"\x89PNG\r\n\x1a\n"):
            return made("PNG", *at(">II", 16))
        if blob[:6] in (b"GIF87a", b"GIF89a"):
            return made("GIF", *at("<HH", 6))
        if blob[:2] == b"BM":
            w, h = at("<ii", 18)
            return made("BMP", w, abs(h))
        if blob[:4] == b"DDS ":
            h, w = at("<II", 12)
            return made("DDS", w, h, code=blob[84:88].decode("ascii", "replace").strip("\0 "))
        if blob.startswith(b"\xabKTX 11\xbb"):
            return made("KTX", *at("<II", 36))
        if blob.startswith(b"\xabKTX 20\xbb"):
            return made("KTX2", *at("<II", 20))
        if blob[:2] == b"\xff\xd8":
            place = 2
            while place + 9 <= len(blob):
                if blob[place] != 0xFF:
                    place += 1
                    continue
                mark = blob[place + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = at(">HH", place + 5)
                    return made("JPEG", w, h)
                place += 2 if mark in (0xFF, 1) or 0xD0 <= mark <= 0xD8 else 2 + at(">H", place + 2)[0]
            return made("JPEG", 0, 0)
        if extension.lower() == "tga" and len(blob) >= 18 and blob[1] in (0, 1) and blob[2] in (1, 2, 3, 9, 10, 11) and blob[16] in (8, 15, 16, 24, 32):
            w, h = at("<HH", 12)
            return made("TGA", w, h) if w and h else None
    except struct.error:
        return None
    return None


def write_png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (h, w, 3 or 4) values."""
    h, w, c = pixels.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, w * c)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _colours_565(v: np.ndarray) -> np.ndarray:
    """Colours of 5, 6 and 5 bits, spread over 0 to 255 and rounded."""
    parts = [(v >> 11 & 31, 31), (v >> 5 & 63, 63), (v & 31, 31)]
    return np.stack([(x.astype(np.int64) * 255 + most // 2) // most for x, most in parts], axis=-1)


def packed_565(data: bytes, width: int, height: int) -> np.ndarray:
    """RGBA pixels of 16-bit colours, shifted up."""
    v = np.frombuffer(data, "<u2", width * height).reshape(height, width)
    return np.stack([(v >> 11 & 31) << 3, (v >> 5 & 63) << 2, (v & 31) << 3, np.full_like(v, 255)], axis=-1).astype(np.uint8)


def _bc_colours(blocks: np.ndarray, punch_through: bool) -> np.ndarray:
    """(n, 16, 4) values of colour blocks (n, 8 bytes): two end colours and two bits a pixel."""
    words = np.ascontiguousarray(blocks).view("<u2").astype(np.int64)
    c0, c1 = words[:, 0], words[:, 1]
    a, b = _colours_565(c0), _colours_565(c1)
    four = np.stack([a, b, (2 * a + b) // 3, (a + 2 * b) // 3], axis=1)
    alpha = np.full((len(blocks), 4), 255)
    if punch_through:
        three = np.stack([a, b, (a + b) // 2, np.zeros_like(a)], axis=1)
        dark = c0 <= c1
        four = np.where(dark[:, None, None], three, four)
        alpha[dark, 3] = 0
    bits = words[:, 2] | words[:, 3] << 16
    pick = (bits[:, None] >> (2 * np.arange(16))) & 3
    rows = np.arange(len(blocks))[:, None]
    return np.concatenate([four[rows, pick], alpha[rows, pick][..., None]], axis=-1)


def _bc_ramp(blocks: np.ndarray) -> np.ndarray:
    """(n, 16) values of single-channel blocks (n, 8 bytes): two ends and three bits a pixel."""
    b = blocks.astype(np.int64)
    a0, a1 = b[:, 0], b[:, 1]
    k = np.arange(1, 7)
    eight = (a0[:, None] * (7 - k) + a1[:, None] * k) // 7
    k = np.arange(1, 5)
    six = np.concatenate([(a0[:, None] * (5 - k) + a1[:, None] * k) // 5, np.zeros((len(b), 1), np.int64), np.full((len(b), 1), 255)], axis=1)
    table = np.concatenate([a0[:, None], a1[:, None], np.where((a0 > a1)[:, None], eight, six)], axis=1)
    bits = sum(b[:, 2 + i] << (8 * i) for i in range(6))
    return table[np.arange(len(b))[:, None], (bits[:, None] >> (3 * np.arange(16))) & 7]


def decode_blocks(data: bytes, width: int, height: int, kind: str) -> np.ndarray:
    """RGBA pixels of a BC1 to BC5 texture (also by their DXT names)."""
    kind = {"DXT1": "BC1", "DXT3": "BC2", "DXT5": "BC3", "ATI1": "BC4", "ATI2": "BC5"}.get(kind, kind)
    across, down = max(1, -(-width // 4)), max(1, -(-height // 4))
    size = 8 if kind in ("BC1", "BC4") else 16
    if len(data) < across * down * size:
        raise ValueError("block data is short")
    blocks = np.frombuffer(data, np.uint8, across * down * size).reshape(-1, size)
    if kind == "BC1":
        out = _bc_colours(blocks, True)
    elif kind == "BC2":
        out = _bc_colours(blocks[:, 8:], False)
        out[..., 3] = 17 * np.stack([blocks[:, :8] & 15, blocks[:, :8] >> 4], axis=-1).reshape(-1, 16).astype(np.int64)
    elif kind == "BC3":
        out = _bc_colours(blocks[:, 8:], False)
        out[..., 3] = _bc_ramp(blocks[:, :8])
    elif kind == "BC4":
        out = np.repeat(_bc_ramp(blocks)[..., None], 4, axis=-1)
        out[..., 3] = 255
    elif kind == "BC5":
        x, y = _bc_ramp(blocks[:, :8]), _bc_ramp(blocks[:, 8:])
        fx, fy = x / 127.5 - 1, y / 127.5 - 1
        z = np.sqrt(np.clip(1 - fx * fx - fy * fy, 0, 1))
        out = np.stack([x, y, np.rint((z + 1) * 127.5).astype(np.int64), np.full_like(x, 255)], axis=-1)
    else:
        raise ValueError(f"unsupported texture format {kind}")
    tiles = out.reshape(down, across, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(down * 4, across * 4, 4)
    return tiles[:height, :width].astype(np.uint8)


def unswizzle_normal(pixels: np.ndarray) -> tuple[np.ndarray, bool]:
    """Normals stored as (1, y, y, x) become (x, y, z), if the content says so: a flat full red with varying alpha and green or blue."""
    p = pixels.astype(float)
    flat = p[..., 0].min() >= 250
    varies = p[..., 3].std() > 1 and max(p[..., 1].std(), p[..., 2].std()) > 1
    if not (flat and varies):
        return pixels, False
    x, y = p[..., 3] / 127.5 - 1, p[..., 1] / 127.5 - 1
    z = np.sqrt(np.clip(1 - x * x - y * y, 0, 1))
    return np.stack([p[..., 3], p[..., 1], np.rint((z + 1) * 127.5), np.full(x.shape, 255)], axis=-1).astype(np.uint8), True


def _from_1555(v: np.ndarray) -> np.ndarray:
    """Console colours: five bits each of red, green and blue from the low end; black without the top bit is clear."""
    rgb = np.stack([v & 31, v >> 5 & 31, v >> 10 & 31], axis=-1)
    rgb = (rgb << 3 | rgb >> 2).astype(np.uint8)
    alpha = np.where((v & 0x7FFF == 0) & (v & 0x8000 == 0), 0, 255).astype(np.uint8)
    return np.concatenate([rgb, alpha[..., None]], axis=-1)


def decode_tim(blob: bytes) -> np.ndarray:
    """RGBA pixels of a TIM texture of 4, 8, 16 or 24 bits a pixel; indexed ones take the first palette."""
    magic, flags = struct.unpack_from("<II", blob)
    if magic != 0x10 or flags & 7 > 3:
        raise ValueError("not a TIM texture")
    at, palette = 8, None
    if flags & 8:
        size, _, _, w, h = struct.unpack_from("<IHHHH", blob, at)
        palette = _from_1555(np.frombuffer(blob, "<u2", w * h, at + 12))
        at += size
    _, _, _, w, h = struct.unpack_from("<IHHHH", blob, at)
    raw = np.frombuffer(blob, np.uint8, 2 * w * h, at + 12).reshape(h, 2 * w)
    mode = flags & 7
    if mode == 2:
        return _from_1555(np.ascontiguousarray(raw).view("<u2"))
    if mode == 3:
        rgb = raw[:, : 2 * w // 3 * 3].reshape(h, -1, 3)
        return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, np.uint8)], axis=-1)
    index = raw if mode == 1 else np.stack([raw & 15, raw >> 4], axis=-1).reshape(h, 4 * w)
    if palette is None:
        grey = (index * (17 if mode == 0 else 1)).astype(np.uint8)
        return np.stack([grey, grey, grey, np.full_like(grey, 255)], axis=-1)
    return palette[np.minimum(index, len(palette) - 1)]


def image_headers(files: DataFrame) -> DataFrame:
    """virtual_path, format, width, height of the files (virtual_path, content) that are images; only their heads are looked at."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["virtual_path"], frame["content"]):
                found = read_header(bytes(content), path.rsplit(".", 1)[-1]) if content is not None else None
                if found:
                    rows.append((path, found["format"], found["width"], found["height"]))
            yield pd.DataFrame(rows, columns=["virtual_path", "format", "width", "height"])

    return files.select("virtual_path", "content").mapInPandas(run, "virtual_path string, format string, width long, height long")


def find_embedded(blob: bytes, magics: dict[str, bytes]) -> list[tuple[int, str]]:
    """Places, behind the first byte, where magic numbers stand inside a blob, in order."""
    hits = []
    for name, magic in magics.items():
        at = blob.find(magic, 1)
        while at >= 0:
            hits.append((at, name))
            at = blob.find(magic, at + 1)
    return sorted(hits)


def unpack_bits(data: bytes, count: int, bits: int, start: float = 0.0, span: float = 0.0) -> np.ndarray:
    """`count` little-endian integers of `bits` bits each; with a span, scaled to start .. start + span."""
    if not bits or not count:
        return np.full(count, start) if span else np.zeros(count, np.int64)
    stream = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits).astype(np.int64)
    values = (stream << np.arange(bits)).sum(axis=1)
    return values / ((1 << bits) - 1) * span + start if span else values
