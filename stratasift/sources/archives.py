"""Archive members as rows: ZIP, TAR, single streams, AFS, offset tables, template containers, PAK; all within a budget.

Every reader is a generator of (member path, content) over one blob; `members_of` wraps it with
path safety and the budget and turns errors into rows, so that a broken archive is data, not
a failed task.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

Member = tuple[str, bytes]
_DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))}


class Unsafe(ValueError):
    """A member's path that leaves its root, or names nothing."""


class OverBudget(ValueError):
    """More bytes or entries than the budget allows."""


@dataclass
class Budget:
    """Running totals of one container; `take` raises at the first limit that is passed."""

    max_bytes: int = 8 << 30
    max_entries: int = 200_000
    max_ratio: float = 200.0
    packed: int = 0
    entries: int = 0
    bytes: int = 0

    def take(self, size: int) -> None:
        self.entries += 1
        self.bytes += size
        if self.entries > self.max_entries:
            raise OverBudget(f"entry limit of {self.max_entries} exceeded")
        if self.bytes > self.max_bytes:
            raise OverBudget(f"size limit of {self.max_bytes} bytes exceeded")
        if self.packed and self.bytes > 64 << 20 and self.bytes > self.packed * self.max_ratio:
            raise OverBudget(f"expansion ratio above {self.max_ratio}")

    def left(self) -> int:
        return max(0, self.max_bytes - self.bytes)


def safe_path(name: str) -> str:
    """A relative path without drive, root and dots; raises Unsafe where `..` leaves the root."""
    raw = re.sub(r"^[A-Za-z]:", "", name.replace("\\", "/").lstrip("/")).lstrip("/")
    out: list[str] = []
    for part in raw.split("/"):
        if part == "..":
            if not out:
                raise Unsafe(f"path leaves its root: {name!r}")
            out.pop()
        elif part not in ("", "."):
            part = re.sub(r'[\x00-\x1f<>:"|?*]', "_", part).strip().rstrip(".") or "_"
            out.append(("_" + part if part.split(".")[0].upper() in _DEVICES else part)[:200])
    if not out:
        raise Unsafe(f"empty path: {name!r}")
    return "/".join(out)


def read_zip(blob: bytes, budget: Budget) -> Iterator[Member]:
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        for info in z.infolist():
            if not info.is_dir():
                with z.open(info) as f:  # stored sizes can lie: read one byte past what is left
                    yield info.filename, f.read(budget.left() + 1)


def read_tar(blob: bytes, budget: Budget) -> Iterator[Member]:
    with tarfile.open(fileobj=io.BytesIO(blob), mode="r:*") as t:
        for info in t:
            if info.isfile():  # links and devices are skipped
                yield info.name, t.extractfile(info).read(budget.left() + 1)


def _stream(opener: Callable) -> Callable[[bytes, Budget], Iterator[Member]]:
    def read(blob: bytes, budget: Budget) -> Iterator[Member]:
        with opener(io.BytesIO(blob)) as f:
            yield "", f.read(budget.left() + 1)

    return read


def read_afs(blob: bytes, budget: Budget) -> Iterator[Member]:
    """`AFS\\0`, a count, (offset, size) pairs, then the place of 48-byte name records."""
    if blob[:4] not in (b"AFS\0", b"AFS ") or len(blob) < 8:
        raise ValueError("not an AFS archive")
    (count,) = struct.unpack_from("<I", blob, 4)
    if not 0 < count <= 65_536 or 8 + 8 * count > len(blob):
        raise ValueError("implausible AFS header")
    pairs = [struct.unpack_from("<II", blob, 8 + 8 * i) for i in range(count)]
    names: list[str] = []
    if 16 + 8 * count <= len(blob):
        at, size = struct.unpack_from("<II", blob, 8 + 8 * count)
        if size >= 48 * count and 0 < at <= len(blob) - 48 * count:
            names = [blob[at + 48 * i : at + 48 * i + 32].split(b"\0")[0].decode("ascii", "replace") for i in range(count)]
    for i, (at, size) in enumerate(pairs):
        if size and at + size <= len(blob):
            yield (names[i] if names and names[i] else f"file_{i:05d}.bin"), blob[at : at + size]


#: The fewest and most members of a magic-less table, its smallest file, its largest padding, overlap and the least share that members fill.
TABLE_ENTRIES, TABLE_BYTES, TABLE_PADDING, TABLE_OVERLAP, TABLE_SHARE = (4, 65_536), 4096, 4096, 2048, 0.8


def offset_table(blob: bytes) -> list[tuple[int, int]] | None:
    """(offset, length) of the members of a magic-less table, or None if no layout is proven.

    Two layouts: a count and growing offsets, or a count and (offset, size) pairs, of which
    empty ones are no members. Offsets are multiples of 4 behind the table, members stay
    inside and fill most of the file; of two proven layouts the one that fills more counts.
    """
    least, most = TABLE_ENTRIES
    if len(blob) < TABLE_BYTES or sum(32 <= b < 127 or b in (9, 10, 13) for b in blob[:256]) > 0.9 * 256:
        return None
    (n,) = struct.unpack_from("<I", blob)
    if not least <= n <= most:
        return None
    proven = []
    if 4 + 4 * n <= len(blob):
        at = np.frombuffer(blob, "<u4", n, 4).astype(np.int64)
        if at[0] >= 4 + 4 * n and at[-1] < len(blob) and not (at % 4).any() and (np.diff(at) > 0).all():
            proven.append(np.column_stack([at, np.diff(at, append=len(blob))]))
    if 4 + 8 * n <= len(blob):
        pairs = np.frombuffer(blob, "<u4", 2 * n, 4).astype(np.int64).reshape(n, 2)
        pairs = pairs[pairs[:, 1] > 0]
        at, ends = pairs[:, 0], pairs.sum(axis=1)
        before = np.concatenate([[4 + 8 * n], ends[:-1]])
        if len(pairs) >= least and (at >= 4 + 8 * n).all() and not (at % 4).any() and (ends <= len(blob)).all() and (at >= before - TABLE_OVERLAP).all():
            proven.append(pairs)
    whole = [p for p in proven if len(blob) - p.sum(axis=1).max() <= TABLE_PADDING and p[:, 1].sum() >= TABLE_SHARE * len(blob)]
    best = max(whole, key=lambda p: min(1.0, p[:, 1].sum() / len(blob)), default=None)
    return None if best is None else [(int(x), int(s)) for x, s in best]


def read_offset_table(blob: bytes, budget: Budget) -> Iterator[Member]:
    pieces = offset_table(blob)
    if pieces is None:
        raise ValueError("no offset table is proven")
    for i, (at, size) in enumerate(pieces):
        yield f"{i:05d}.dat", blob[at : at + size]


def read_template(blob: bytes, budget: Budget) -> Iterator[Member]:
    """The documented sample container: `MYG0`, a count, (offset, size) pairs."""
    if blob[:4] != b"MYG0":
        raise ValueError("not a template container")
    (n,) = struct.unpack_from("<I", blob, 4)
    for i in range(n):
        at, size = struct.unpack_from("<II", blob, 8 + 8 * i)
        if at + size > len(blob):
            raise ValueError("entry outside the file")
        yield f"entry_{i:04d}.mym", blob[at : at + size]


PAK_MAGIC = 0x5A6F12E1


def pak_info(blob: bytes) -> dict | None:
    """The footer of a package archive: version, index offset and size, method names; None without one."""
    tail_at = max(0, len(blob) - 512)
    at = blob.rfind(struct.pack("<I", PAK_MAGIC), tail_at)
    if at < 0 or at + 44 > len(blob):
        return None
    version, index_at, index_size = struct.unpack_from("<IQQ", blob, at + 4)
    if not 1 <= version <= 11 or index_at + index_size > len(blob):
        return None
    names_at = at + 24 + 20 + (1 if version == 9 else 0)
    methods = [blob[i : i + 32].split(b"\0")[0].decode("ascii", "replace") for i in range(names_at, len(blob) - 31, 32)] if version >= 8 else ["Zlib", "Gzip"]
    return {"version": version, "index_at": index_at, "index_size": index_size, "methods": methods, "encrypted": bool(at and version >= 4 and blob[at - 1])}


def _pak_string(blob: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<i", blob, at)
    at += 4
    if n < 0:
        return blob[at : at - 2 * n - 2].decode("utf-16-le", "replace"), at - 2 * n
    return blob[at : at + max(0, n - 1)].decode("utf-8", "replace"), at + n


def _pak_record(blob: bytes, at: int, version: int) -> tuple[dict, int]:
    """A payload record: offset, sizes, method, hash, blocks of compressed data, encryption flag."""
    offset, size, unpacked = struct.unpack_from("<QQQ", blob, at)
    at += 24
    (method,) = struct.unpack_from("<I", blob, at)
    at += 4 + (8 if version <= 1 else 0) + 20
    blocks: list[tuple[int, int]] = []
    if version >= 3:
        if method:
            (n,) = struct.unpack_from("<I", blob, at)
            blocks = [struct.unpack_from("<QQ", blob, at + 4 + 16 * i) for i in range(n)]
            at += 4 + 16 * n
        encrypted, block_size = struct.unpack_from("<BI", blob, at)
        at += 5
    else:
        encrypted, block_size = 0, 0
    return {"offset": offset, "size": size, "unpacked": unpacked, "method": method, "blocks": blocks, "encrypted": bool(encrypted), "block_size": block_size}, at


def pak_encoded_entry(blob: bytes, at: int) -> dict:
    """An entry of the compact index: a bit field, then the fields at the widths that it names."""
    (bits,) = struct.unpack_from("<I", blob, at)
    at += 4
    block_size = (bits & 0x3F) << 11
    if bits & 0x3F == 0x3F:
        (block_size,) = struct.unpack_from("<I", blob, at)
        at += 4

    def number(narrow: int) -> int:
        nonlocal at
        form = "<I" if bits >> narrow & 1 else "<Q"
        (v,) = struct.unpack_from(form, blob, at)
        at += struct.calcsize(form)
        return v

    offset, unpacked = number(31), number(30)
    method = bits >> 23 & 0x3F
    size = number(29) if method else unpacked
    return {"offset": offset, "size": size, "unpacked": unpacked, "method": method, "n_blocks": bits >> 6 & 0xFFFF, "encrypted": bool(bits >> 22 & 1), "block_size": block_size}


def _pak_listing(blob: bytes, info: dict) -> Iterator[tuple[str, int]]:
    """(name, place of the payload record) of the members, by the record index or, from version 10, the directory index."""
    _, at = _pak_string(blob, info["index_at"])
    (count,) = struct.unpack_from("<I", blob, at)
    at += 4
    if info["version"] < 10:
        for _ in range(count):
            name, at = _pak_string(blob, at)
            entry, at = _pak_record(blob, at, info["version"])
            if not entry["encrypted"]:
                yield name, entry["offset"]
        return
    at += 8  # seed of the path hashes
    tables = []
    for _ in range(2):  # by path hash, by directory: a flag, then place, size and digest
        (there,) = struct.unpack_from("<I", blob, at)
        at += 4
        tables.append(struct.unpack_from("<QQ", blob, at) if there else None)
        at += 36 if there else 0
    if tables[1] is None:
        raise ValueError("no directory index")
    encoded = at + 4
    at = tables[1][0]
    (folders,) = struct.unpack_from("<I", blob, at)
    at += 4
    for _ in range(folders):
        folder, at = _pak_string(blob, at)
        (files,) = struct.unpack_from("<I", blob, at)
        at += 4
        for _ in range(files):
            name, at = _pak_string(blob, at)
            (place,) = struct.unpack_from("<i", blob, at)
            at += 4
            if place >= 0:
                entry = pak_encoded_entry(blob, encoded + place)
                if not entry["encrypted"]:
                    yield folder.strip("/") + "/" + name if folder.strip("/") else name, entry["offset"]


def read_pak(blob: bytes, budget: Budget) -> Iterator[Member]:
    """Members of versions 1 to 11; encrypted ones are skipped, unknown methods raise."""
    info = pak_info(blob)
    if not info:
        raise ValueError("no package footer")
    for name, place in _pak_listing(blob, info):
        entry, start = _pak_record(blob, place, info["version"])
        if not entry["method"]:
            yield name, blob[start : start + entry["unpacked"]]
            continue
        method = (info["methods"][entry["method"] - 1] if entry["method"] <= len(info["methods"]) else "?").lower()
        base = place if info["version"] >= 5 else 0
        pieces = [blob[base + a : base + b] for a, b in entry["blocks"]] or [blob[start : start + entry["size"]]]
        yield name, b"".join(unpack(method, p, entry["unpacked"]) for p in pieces)


def unpack(method: str, data: bytes, size: int) -> bytes:
    """One block by the name of its method; a proprietary or unknown one is unsupported."""
    if method == "zlib":
        return zlib.decompress(data)
    if method == "gzip":
        return gzip.decompress(data)
    if method == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    if method == "lz4":
        return lz4_block(data, size)
    raise ValueError(f"unsupported compression method {method!r}")


def lz4_block(data: bytes, size: int | None = None) -> bytes:
    """Decode a raw LZ4 block."""
    out, at, end = bytearray(), 0, len(data)

    def more(n: int) -> int:
        nonlocal at
        if n == 15:
            while True:
                b = data[at]
                at += 1
                n += b
                if b != 255:
                    break
        return n

    while at < end:
        token = data[at]
        at += 1
        n = more(token >> 4)
        out += data[at : at + n]
        at += n
        if at >= end:
            break
        back = data[at] | data[at + 1] << 8
        at += 2
        if not 0 < back <= len(out):
            raise ValueError("bad LZ4 offset")
        n = more(token & 15) + 4
        if back >= n:
            out += out[len(out) - back : len(out) - back + n]
        else:  # the match overlaps what it writes
            piece = bytes(out[-back:])
            out += (piece * (n // back + 1))[:n]
        if size is not None and len(out) > size:
            raise ValueError("LZ4 block is larger than declared")
    return bytes(out)


def read_unity_bundle(blob: bytes, budget: Budget) -> Iterator[Member]:
    """`UnityFS`: header, block table (plain, LZMA or LZ4), then the nodes cut from the joined blocks."""
    if not blob.startswith(b"UnityFS\0"):
        raise ValueError("not a UnityFS bundle")
    at = 8
    (version,) = struct.unpack_from(">I", blob, at)
    at += 4
    for _ in range(2):
        at = blob.index(b"\0", at) + 1
    _, packed, plain, flags = struct.unpack_from(">qIII", blob, at)
    at += 20
    if version >= 7:
        at = (at + 15) & ~15
    table_at = len(blob) - packed if flags & 0x80 else at
    table = _unity_block(blob[table_at : table_at + packed], plain, flags & 0x3F)
    data_at = at if flags & 0x80 else at + packed
    if flags & 0x200:
        data_at = (data_at + 15) & ~15
    (n,) = struct.unpack_from(">I", table, 16)
    pos, data = 20, bytearray()
    for _ in range(n):
        size, stored, kind = struct.unpack_from(">IIH", table, pos)
        pos += 10
        if len(data) + size > budget.left():
            raise OverBudget(f"size limit of {budget.max_bytes} bytes exceeded")
        data += _unity_block(blob[data_at : data_at + stored], size, kind & 0x3F)
        data_at += stored
    (n,) = struct.unpack_from(">I", table, pos)
    pos += 4
    for _ in range(n):
        start, size, _ = struct.unpack_from(">qqI", table, pos)
        end = table.index(b"\0", pos + 20)
        yield table[pos + 20 : end].decode("utf-8", "replace"), bytes(data[start : start + size])
        pos = end + 1


def _unity_block(data: bytes, size: int, kind: int) -> bytes:
    if kind == 0:
        return data
    if kind == 1:
        props = data[0]
        filters = [{"id": lzma.FILTER_LZMA1, "lc": props % 9, "lp": props // 9 % 5, "pb": props // 45, "dict_size": struct.unpack_from("<I", data, 1)[0]}]
        return lzma.decompress(data[5:], lzma.FORMAT_RAW, filters=filters)[:size]
    if kind in (2, 3):
        return lz4_block(data, size)
    raise ValueError(f"unsupported block compression {kind}")


class Iso:
    """An ISO 9660 image; sector layout probed, Joliet names preferred, directory loops cut."""

    #: Sector size and offset of its data.
    LAYOUTS = ((2048, 0), (2352, 16), (2352, 24), (2336, 8))

    def __init__(self, blob: bytes):
        self.blob = blob
        for self.sector, self.lead in self.LAYOUTS:
            if self.read(16, 6)[1:6] == b"CD001":
                break
        else:
            raise ValueError("no volume descriptor")
        self.root, self.joliet = b"", False
        for n in range(16, 48):
            d = self.read(n, 2048)
            if d[1:6] != b"CD001" or d[0] == 255:
                break
            if d[0] == 1 and not self.root:
                self.root = d[156:190]
            elif d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
                self.root, self.joliet = d[156:190], True

    def read(self, lba: int, size: int) -> bytes:
        if self.sector == 2048:
            return self.blob[lba * 2048 : lba * 2048 + size]
        out = b"".join(self.blob[(lba + i) * self.sector + self.lead : (lba + i) * self.sector + self.lead + 2048] for i in range(-(-size // 2048)))
        return out[:size]

    def walk(self) -> Iterator[tuple[str, int, int, bool]]:
        """(path, lba, size, is directory) of all entries."""
        seen: set[int] = set()
        stack = [("", *struct.unpack_from("<I4xI", self.root, 2))]
        while stack:
            folder, lba, size = stack.pop()
            if lba in seen:
                continue
            seen.add(lba)
            data, at = self.read(lba, size), 0
            while at < len(data):
                n = data[at]
                if n == 0:
                    at = (at // 2048 + 1) * 2048
                    continue
                start, length, flags, named = struct.unpack_from("<I4xI", data, at + 2)[0], struct.unpack_from("<I", data, at + 10)[0], data[at + 25], data[at + 32]
                raw = data[at + 33 : at + 33 + named]
                at += n
                if raw in (b"\0", b"\1"):
                    continue
                name = (raw.decode("utf-16-be", "replace") if self.joliet else raw.decode("latin-1")).split(";")[0]
                path, is_dir = f"{folder}/{name}".lstrip("/"), bool(flags & 2)
                yield path, start, length, is_dir
                if is_dir:
                    stack.append((path, start, length))

    def platform(self) -> str | None:
        """A hint by the names in the root: PS1/PS2, PS1 or PSP."""
        top = {p.upper() for p, *_ in self.walk() if "/" not in p}
        if "SYSTEM.CNF" in top:
            return "PS1/PS2"
        if "PSX.EXE" in top or any(t.startswith(("SLUS", "SCUS", "SLES", "SCES", "SLPS", "SCPS")) for t in top):
            return "PS1"
        return "PSP" if "UMD_DATA.BIN" in top else None


def read_iso(blob: bytes, budget: Budget) -> Iterator[Member]:
    iso = Iso(blob)
    for path, lba, size, is_dir in iso.walk():
        if not is_dir:
            if size > budget.left():
                raise OverBudget(f"size limit of {budget.max_bytes} bytes exceeded")
            yield path, iso.read(lba, size)


READERS: dict[str, Callable[[bytes, Budget], Iterator[Member]]] = {
    "ZIP": read_zip, "TAR": read_tar, "GZIP": _stream(lambda f: gzip.GzipFile(fileobj=f)), "BZIP2": _stream(bz2.BZ2File), "XZ": _stream(lzma.LZMAFile),
    "AFS": read_afs, "Offset table": read_offset_table, "Template": read_template, "PAK": read_pak, "Unity AssetBundle (FS)": read_unity_bundle, "ISO 9660": read_iso,
}
#: Formats that are named but never opened, and why.
UNSUPPORTED = {"Microsoft Cabinet": "no CAB reader", "7-Zip": "py7zr is not installed", "RAR4": "rarfile is not installed", "RAR5": "rarfile is not installed"}


def sniff_container(name: str, blob: bytes) -> str | None:
    """The container format of a blob, by its bytes, then by proof; None for anything else."""
    head = blob[:8]
    if head[:4] == b"PK\3\4" or head[:4] == b"PK\5\6":
        return "ZIP"
    for magic, kind in ((b"UnityFS", "Unity AssetBundle (FS)"), (b"AFS\0", "AFS"), (b"MYG0", "Template"), (b"MSCF", "Microsoft Cabinet"), (b"7z\xbc\xaf", "7-Zip"), (b"Rar!\x1a\x07\x00", "RAR4"), (b"Rar!\x1a\x07\x01", "RAR5")):
        if blob.startswith(magic):
            return kind
    if blob[257:262] == b"ustar" or re.search(r"\.(tar|tgz|tbz2?|txz|tar\.(gz|bz2|xz))$", name.lower()):
        return "TAR"
    for magic, kind in ((b"\x1f\x8b\x08", "GZIP"), (b"BZh", "BZIP2"), (b"\xfd7zXZ\0", "XZ")):
        if blob.startswith(magic):
            return kind
    if any(blob[16 * s + o + 1 : 16 * s + o + 6] == b"CD001" for s, o in Iso.LAYOUTS):
        return "ISO 9660"
    if pak_info(blob):
        return "PAK"
    if name.lower().endswith(".cue"):
        return "CUE"
    return "Offset table" if offset_table(blob) else None


def members_of(name: str, blob: bytes, max_bytes: int = 8 << 30, max_entries: int = 200_000, max_ratio: float = 200.0) -> list[dict]:
    """Rows of a container: member, content, error. Members before a broken limit stay, the breaking one goes."""
    kind = sniff_container(name, blob)
    if kind is None or kind == "CUE":  # a cue sheet names files that stand beside it: scan.cue_tracks
        return []
    if kind in UNSUPPORTED:
        return [{"format": kind, "member": None, "content": None, "error": f"unsupported: {UNSUPPORTED[kind]}"}]
    budget, rows = Budget(max_bytes, max_entries, max_ratio, len(blob)), []
    row = lambda member, content, error: rows.append({"format": kind, "member": member, "content": content, "error": error})
    try:
        for member, content in READERS[kind](blob, budget):
            if kind == "Offset table":
                member = f"{name.rsplit('/', 1)[-1].rsplit('.', 1)[0]}_{member}"
            try:
                path = safe_path(member or re.sub(r"\.(gz|bz2|xz|tgz|Z)$", "", name.rsplit("/", 1)[-1], flags=re.I) or "payload")
            except Unsafe as e:
                row(None, None, str(e))
                continue
            budget.take(len(content))
            row(path, content, None)
    except Exception as e:  # a broken container is a row, whatever broke it
        row(None, None, f"{type(e).__name__}: {e}")
    return rows
