"""Cooked packages: their tables, the tagged properties and textures of their exports, as rows.

Packages rarely say which header layout they have, so tables are found by their arithmetic:
each is a run of records of one size, and a reading of the header counts if its tables fill
the space between them. What an export holds stands in the package or in a sidecar file of
the same stem, which is joined to it before anything is parsed.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.sources.images import decode_blocks, packed_565, write_png
from stratasift.sources.serialized import Cursor

#: Fixed values of the format: magic number, legacy versions that are read, bounds of counts and record sizes.
MAGIC, LEGACY = 0x9E2A83C1, range(-9, -5)
MOST_RECORDS, MOST_ITEMS, IMPORT_SIZES, EXPORT_SIZES = 1_000_000, 5_000_000, range(28, 65), range(56, 201)
#: Sizes of import and export records that are known.
KNOWN_IMPORTS, KNOWN_EXPORTS = {28, 29, 32, 36, 37}, {72, 76, 84, 96, 100, 104, 108}
#: Struct codes of number properties and of plain structs.
NUMBERS = {"IntProperty": "i", "Int8Property": "b", "Int16Property": "h", "Int64Property": "q", "UInt16Property": "H", "UInt32Property": "I", "UInt64Property": "Q", "FloatProperty": "f", "DoubleProperty": "d"}
STRUCTS = {"Vector": "3f", "Vector2D": "2f", "Vector4": "4f", "Rotator": "3f", "Quat": "4f", "Color": "4B", "LinearColor": "4f", "IntPoint": "2i"}
PATHS = {"SoftObjectProperty", "AssetObjectProperty", "WeakObjectProperty", "LazyObjectProperty"}
#: Payload flags, bytes of a 4 x 4 block, bytes of a pixel, and the channel order of packed pixels.
AT_END, INLINE, SEPARATE, OPTIONAL, WIDE = 0x0001, 0x0040, 0x0100, 0x0800, 0x2000
BLOCKS = {"PF_DXT1": 8, "PF_BC4": 8, "PF_DXT3": 16, "PF_DXT5": 16, "PF_BC5": 16, "PF_BC6H": 16, "PF_BC7": 16}
PIXELS = {"PF_B8G8R8A8": 4, "PF_R8G8B8A8": 4, "PF_A8R8G8B8": 4, "PF_G8": 1, "PF_A8": 1, "PF_FloatRGBA": 8}
CHANNELS = {"PF_B8G8R8A8": (2, 1, 0, 3), "PF_R8G8B8A8": (0, 1, 2, 3), "PF_A8R8G8B8": (1, 2, 3, 0)}
WIDEST = 32768


class Unsupported(ValueError):
    """No package, or one of a layout that is not known."""


def read_string(c: Cursor) -> str:
    """A counted string: UTF-8 of a positive count of bytes, UTF-16 of a negative one of units."""
    n = c.take("i")
    if abs(n) > 1_000_000:
        raise ValueError("implausible string length")
    return c.raw(n).decode("utf-8", "replace").rstrip("\0") if n >= 0 else c.raw(-2 * n).decode("utf-16-le", "replace").rstrip("\0")


def records(data: bytes, at: int, count: int, span: int, fields: list[tuple[str, str]]) -> np.ndarray:
    """The first fields of `count` records of one size that fill a span."""
    size, packed = span // count, np.dtype([(n, f"<{t}") for n, t in fields])
    if packed.itemsize > size:
        raise ValueError("records are shorter than their fields")
    places = [packed.fields[n][1] for n in packed.names]
    return np.frombuffer(data, np.dtype({"names": packed.names, "formats": [packed[n] for n in packed.names], "offsets": places, "itemsize": size}), count, at)


def plain(text: str, most: int) -> bool:
    return all(32 <= ord(x) < 127 for x in text[:most])


def table_places(data: bytes, at: int, names_at: int, header_size: int) -> tuple[int, ...]:
    """(exports, their place, imports, their place, end of exports) behind optional fields: the likeliest reading, the first among equals."""

    def read(has_id: bool, pairs: int) -> tuple[int, tuple[int, ...]]:
        c = Cursor(data, at)
        try:
            if has_id:
                read_string(c)
            c.raw(8 * pairs)
            found = struct.unpack("<5i", c.raw(20))
        except (ValueError, struct.error):
            return 0, ()
        exports, exports_at, imports, imports_at, end = found
        if not (0 < exports <= MOST_RECORDS and 0 < imports <= MOST_RECORDS and names_at < imports_at < exports_at < end <= (header_size or len(data)) + 4 and exports_at <= len(data)):
            return 0, ()
        (import_size, odd), (export_size, left) = divmod(exports_at - imports_at, imports), divmod(end - exports_at, exports)
        if odd or left or import_size not in IMPORT_SIZES or export_size not in EXPORT_SIZES:
            return 0, ()
        return 2 + 3 * (export_size in KNOWN_EXPORTS) + (import_size in KNOWN_IMPORTS), found

    score, best = max(itertools.starmap(read, itertools.product((False, True), range(4))), key=lambda x: x[0])
    if not score:
        raise ValueError("export and import tables not found")
    return best


def name_table(data: bytes, at: int, count: int, end: int) -> list[str]:
    """The names, with or without a hash of 4 bytes behind each: whichever reads as text up to the next table."""
    for behind in (4, 0):
        c, names = Cursor(data, at), []
        try:
            for _ in range(count):
                names.append(read_string(c))
                c.raw(behind)
        except (ValueError, struct.error):
            continue
        if c.at <= end + 8 and sum(plain(n, 80) for n in names) >= max(1, int(0.95 * count)):
            return names
    raise ValueError("name table not readable")


class Package:
    """names, imports and exports (dicts) of a package; payload is its sidecar with what the exports hold, if any."""

    def __init__(self, data: bytes, payload: bytes | None = None):
        c = Cursor(data)
        if len(data) < 64 or c.take("I") != MAGIC:
            raise Unsupported("not a package")
        legacy = c.take("i")
        if legacy not in LEGACY:
            raise Unsupported(f"legacy version {legacy}")
        c.raw(4)
        self.version = (c.take("i"), c.take("i") if legacy <= -8 else 0)
        c.raw(4)
        customs = c.take("i")
        if not 0 <= customs <= 10_000:
            raise Unsupported("implausible number of custom versions")
        c.raw(20 * customs)
        self.header_size, self.folder, self.flags = c.take("i"), read_string(c), c.take("I")
        count, names_at = c.take("i"), c.take("i")
        if not (0 <= count <= MOST_ITEMS and 0 < names_at < len(data)):
            raise ValueError("implausible name table")
        self.data, self.payload = data, payload
        exports, exports_at, imports, imports_at, end = table_places(data, c.at, names_at, self.header_size)
        self.names = name_table(data, names_at, count, min(imports_at, len(data))) if count else []
        rows = records(data, imports_at, imports, exports_at - imports_at, [("package", "i4"), ("package_no", "i4"), ("class", "i4"), ("class_no", "i4"), ("outer", "i4"), ("name", "i4"), ("name_no", "i4")])
        self.imports = [{"package": self.name(r["package"], r["package_no"]), "class": self.name(r["class"], r["class_no"]), "outer": int(r["outer"]), "name": self.name(r["name"], r["name_no"])} for r in rows]
        self.exports = self._exports(exports, exports_at, end - exports_at)

    def name(self, index: int, number: int) -> str:
        text = self.names[index] if 0 <= index < len(self.names) else "None"
        return f"{text}_{number - 1}" if number > 0 else text

    def resolve(self, index: int) -> str:
        """What a signed index names: n is the n-th export, -n the n-th import, all else nothing."""
        table = self.exports if index > 0 else self.imports
        return table[abs(index) - 1]["name"] if 0 < abs(index) <= len(table) else "None"

    def _exports(self, count: int, at: int, span: int) -> list[dict]:
        room, shift = (len(self.data), 0) if self.payload is None else (len(self.payload), self.header_size)
        best, most = None, 0
        for template, wide in itertools.product((True, False), (True, False)):
            size = "i8" if wide else "i4"
            fields = [("class", "i4"), ("super", "i4"), *([("template", "i4")] if template else []), ("outer", "i4"), ("name", "i4"), ("name_no", "i4"), ("flags", "u4"), ("size", size), ("offset", size)]
            try:
                rows = records(self.data, at, count, span, fields)
            except ValueError:
                continue
            sizes, starts = rows["size"].astype(np.int64), rows["offset"].astype(np.int64) - shift
            if (sizes <= 0).any() or (starts < 0).any() or (sizes > room + 4 - starts).any():
                continue
            names = [self.name(r["name"], r["name_no"]) for r in rows]
            if not all(n and n != "None" and plain(n, 64) for n in names):
                continue
            score = 3 if 0.5 <= sizes.sum() / max(1, room) <= 1.05 else 1
            if score > most:
                most = score
                best = [{"name": n, "class": int(r["class"]), "outer": int(r["outer"]), "flags": int(r["flags"]), "size": int(z), "start": int(s)} for n, r, z, s in zip(names, rows, sizes, starts)]
        if best is None:
            raise ValueError("export table layout not known")
        self.exports = best
        for e in best:
            e["class_name"] = self.resolve(e["class"])
        return best

    def content(self, export: dict) -> bytes | None:
        """What an export holds; null where it ends outside of its file."""
        held = self.data if self.payload is None else self.payload
        return held[export["start"] : export["start"] + export["size"]] if export["start"] + export["size"] <= len(held) else None

    def properties(self, export: dict) -> tuple[dict | None, int]:
        """The tagged properties of an export and where they end; null where they are not readable."""
        held = self.content(export)
        c = Cursor(held or b"")
        try:
            return Properties(self, c).tagged(), c.at
        except (ValueError, struct.error):
            return None, 0


class Properties:
    """Tagged values at a cursor. A value that is not readable is null; its tag says where the next one starts."""

    DEEPEST = 8

    def __init__(self, package: Package, c: Cursor):
        self.package, self.c = package, c
        text: dict[str, Callable] = {"StrProperty": lambda: read_string(c), "NameProperty": self.name}
        number = {kind: (lambda code=code: c.take(code)) for kind, code in NUMBERS.items()}
        self.values = {**number, **text, **{kind: text["StrProperty"] for kind in PATHS}, "EnumProperty": self.name, "ObjectProperty": self.object}
        self.items = {**text, "IntProperty": number["IntProperty"], "FloatProperty": number["FloatProperty"], "BoolProperty": lambda: c.take("B") != 0, "ByteProperty": lambda: c.take("B"), "ObjectProperty": lambda: package.resolve(c.take("i"))}

    def name(self) -> str:
        return self.package.name(self.c.take("i"), self.c.take("i"))

    def object(self) -> dict:
        index = self.c.take("i")
        return {"__object": self.package.resolve(index), "index": index}

    def tagged(self, depth: int = 0) -> dict:
        out, c = {}, self.c
        while depth <= self.DEEPEST and (key := self.name()).lower() != "none":
            kind, size = self.name(), c.take("i")
            c.raw(4)
            about = self.about(kind)
            end = c.at + size
            try:
                out[key] = self.value(kind, about, size, depth)
            except (ValueError, struct.error):
                out[key] = None
            c.at = min(max(end, c.at), len(c.data))
            if c.at == len(c.data):
                break
        return out

    def about(self, kind: str):
        """What a tag says of its value beyond type and size."""
        if kind == "BoolProperty":
            value = self.c.take("B") != 0
        elif kind in ("StructProperty", "ByteProperty", "EnumProperty", "ArrayProperty", "SetProperty"):
            value = self.name()
            self.c.raw(16 if kind == "StructProperty" else 0)
        else:
            value = (self.name(), self.name()) if kind == "MapProperty" else None
        self.c.raw(1)
        return value

    def value(self, kind: str, about, size: int, depth: int):
        if kind == "BoolProperty":
            return about
        if kind == "ByteProperty":
            return self.name() if size == 8 else self.c.take("B")
        if kind == "StructProperty":
            return self.struct(about, depth)
        if kind == "ArrayProperty":
            return self.array(about, depth)
        return self.values[kind]() if kind in self.values else None

    def array(self, kind: str, depth: int) -> list:
        n = self.c.take("i")
        if not 0 <= n <= min(MOST_ITEMS, len(self.c.data)):
            raise ValueError("implausible array size")
        if kind != "StructProperty":
            if kind not in self.items:
                raise ValueError(f"array of {kind}")
            return [self.items[kind]() for _ in range(n)]
        self.c.raw(24)  # the tag that all items share: name, type, size, place
        kind = self.name()
        self.c.raw(17)
        return [self.struct(kind, depth + 1) for _ in range(n)]

    def struct(self, kind: str, depth: int):
        floats = lambda code: list(struct.unpack(f"<{code}", self.c.raw(struct.calcsize(code))))
        if kind in STRUCTS:
            return floats(STRUCTS[kind])
        if kind == "Guid":
            return self.c.raw(16).hex()
        if kind == "Box":
            return {"min": floats("3f"), "max": floats("3f"), "valid": self.c.take("B")}
        return self.tagged(depth + 1)


# Textures


def payload_size(form: str, width: int, height: int) -> int:
    """Bytes of an image in a pixel format; 0 for formats of unknown size."""
    if form in BLOCKS:
        return -(-max(1, width) // 4) * -(-max(1, height) // 4) * BLOCKS[form]
    return width * height * PIXELS.get(form, 0)


def platform_data(package: Package, held: bytes, after: int) -> tuple[str, int, int, Cursor] | None:
    """Format, width, height and a cursor at the mips: a pixel format's name, a skip, sizes, and the same name as a string."""
    formats = {i: n for i, n in enumerate(package.names) if n.startswith("PF_")}
    first, end = max(0, after - 4), min(len(held), after + 8192 if after else 1 << 20) - 24
    for at in range(first, max(first, end)):
        index, number = struct.unpack_from("<ii", held, at)
        if number or index not in formats:
            continue
        for gap in range(0, 28, 4):
            c = Cursor(held, at + 8)
            try:
                skip = c.take("q")
                c.raw(gap)
                width, height = c.take("i"), c.take("i")
                c.raw(4)
                same = read_string(c) == formats[index]
            except (ValueError, struct.error):
                continue
            if same and skip >= 0 and 0 < width <= WIDEST and 0 < height <= WIDEST:
                return formats[index], width, height, c
    return None


def mip_records(c: Cursor, form: str, width: int, height: int) -> list[dict]:
    """The mips behind a cursor, in the record shape whose sizes agree best with the pixel format."""
    c.raw(4)
    count = c.take("i")
    if not 0 <= count <= 32:
        raise ValueError("implausible number of mips")
    best, most, start = [], 0, c.at
    for lead, tail in itertools.product((4, 0, 2), (0, 4, 8)):
        at, mips = Cursor(c.data, start), []
        try:
            for _ in range(count):
                at.raw(lead)
                flags = at.take("i")
                code = "q" if flags & WIDE else "i"
                at.take(code)
                mip = {"flags": flags, "size": at.take(code), "offset": at.take("q")}
                mip["inline"] = at.raw(max(0, mip["size"])) if flags & INLINE else None
                mip["width"], mip["height"] = at.take("i"), at.take("i")
                at.raw(4 + tail)
                mips.append(mip)
        except (ValueError, struct.error):
            continue
        if not all(0 < m["width"] <= WIDEST and 0 < m["height"] <= WIDEST and 0 <= m["size"] <= 256 << 20 for m in mips):
            continue
        score = sum(2 for m in mips if m["size"] == payload_size(form, m["width"], m["height"]) > 0) + (3 if mips and (mips[0]["width"], mips[0]["height"]) == (width, height) else 0)
        if score > most:
            best, most = mips, score
    if not best:
        raise ValueError("mip records of no known layout")
    return best


def mip_bytes(package: Package, mip: dict, bulk: bytes | None, optional: bytes | None) -> bytes | None:
    """A mip's pixels: inside its record, in a sidecar, or behind the exports; null where they are not at hand."""
    if mip["inline"] is not None:
        return mip["inline"]
    if mip["flags"] & SEPARATE:
        held, at = (optional if mip["flags"] & OPTIONAL else bulk), mip["offset"]
    else:
        held, at = (package.payload if mip["flags"] & AT_END else None), mip["offset"] - package.header_size
    return held[at : at + mip["size"]] if held is not None and mip["size"] > 0 and 0 <= at <= len(held) - mip["size"] else None


def pixels_of(form: str, data: bytes, width: int, height: int) -> np.ndarray:
    """RGBA pixels; ValueError for formats that are not decoded."""
    if form in BLOCKS:
        return decode_blocks(data, width, height, form.removeprefix("PF_"))
    if form == "PF_R5G6B5_UNORM":
        return packed_565(data, width, height)
    if form in CHANNELS:
        return np.frombuffer(data, np.uint8, width * height * 4).reshape(height, width, 4)[..., list(CHANNELS[form])]
    if form in ("PF_G8", "PF_A8"):
        one = np.frombuffer(data, np.uint8, width * height).reshape(height, width, 1)
        full = np.full_like(one, 255)
        return np.concatenate([one, one, one, full] if form == "PF_G8" else [full, full, full, one], axis=-1)
    raise ValueError(f"unsupported texture format {form}")


def texture(package: Package, export: dict, bulk: bytes | None = None, optional: bytes | None = None) -> dict:
    """{"form", "width", "height", "png", "reason"} of a texture export: its largest mip that is at hand."""
    out = {"form": None, "width": None, "height": None, "png": None, "reason": None}
    held = package.content(export)
    if held is None:
        return {**out, "reason": "payload is missing"}
    _, after = package.properties(export)
    found = platform_data(package, held, after if after < 0.9 * export["size"] else 0)
    if found is None:
        return {**out, "reason": "no cooked texture data"}
    form, width, height, c = found
    out |= {"form": form, "width": width, "height": height}
    try:
        for mip in mip_records(c, form, width, height):
            if (data := mip_bytes(package, mip, bulk, optional)) is not None:
                image = pixels_of(form, data, mip["width"], mip["height"])
                return {**out, "width": mip["width"], "height": mip["height"], "png": write_png(image if image[..., 3].min() < 255 else image[..., :3])}
    except (ValueError, struct.error) as e:
        return {**out, "reason": str(e)}
    return {**out, "reason": "pixels stand outside of the package and are not at hand"}


def describe_mesh(name: str, class_name: str, properties: dict | None) -> str:
    """A line on a mesh export: class, material slots, level-of-detail group, skeleton."""
    p = properties or {}
    slots, skeleton = p.get("StaticMaterials") or p.get("Materials"), p.get("Skeleton")
    facts = [f"{class_name} '{name}'"]
    if isinstance(slots, list) and slots:
        facts.append(f"{len(slots)} material slot(s)")
    if "LODGroup" in p:
        facts.append(f"LOD group {p['LODGroup']}")
    if class_name == "SkeletalMesh" and isinstance(skeleton, dict):
        facts.append(f"skeleton {skeleton['__object']}")
    return ", ".join(facts)


EXPORT_SCHEMA = "virtual_path string, number int, object_name string, class_name string, outer_name string, byte_size long, properties string, form string, width int, height int, png binary, note string, error string"
#: The extension of packages, and of sidecars by what they hold.
HEADERS, SIDECARS = ("uasset", "umap"), {"uexp": "exports", "ubulk": "bulk", "uptnl": "optional"}


def with_sidecars(files: DataFrame) -> DataFrame:
    """virtual_path, content, exports, bulk, optional: packages with the sidecars of their stem, by one shuffle on it."""
    stem, ext = F.regexp_extract("virtual_path", r"^(.*)\.[^./]*$", 1), F.lower(F.regexp_extract("virtual_path", r"\.([^./]*)$", 1))
    named = files.select("virtual_path", "content", stem.alias("stem"), ext.alias("ext"))
    sides = named.where(F.col("ext").isin(*SIDECARS)).groupBy("stem").agg(*[F.max(F.when(F.col("ext") == e, F.struct("virtual_path", "content"))).getField("content").alias(held) for e, held in SIDECARS.items()])
    return named.where(F.col("ext").isin(*HEADERS)).join(sides, "stem", "left").select("virtual_path", "content", *SIDECARS.values())


def package_exports(files: DataFrame) -> DataFrame:
    """The exports of the packages among files (virtual_path, content), numbered from 1: EXPORT_SCHEMA.

    Properties are JSON. Textures come as PNG where their pixels are decoded; other classes
    have a note. A package that is not readable, or null, is one row with its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in EXPORT_SCHEMA.split(", ")]
        whole = lambda x: None if x is None else bytes(x)
        for frame in frames:
            for path, content, exports, bulk, optional in zip(*(frame[n] for n in ("virtual_path", "content", *SIDECARS.values()))):
                rows = []
                try:
                    p = Package(whole(content) or b"", whole(exports))
                    for n, e in enumerate(p.exports, 1):
                        values, _ = p.properties(e)
                        t = texture(p, e, whole(bulk), whole(optional)) if e["class_name"].startswith("Texture2D") else {}
                        note = t.get("reason") if t else describe_mesh(e["name"], e["class_name"], values) if "Mesh" in e["class_name"] else f"{e['class_name']} is not decoded"
                        rows.append((path, n, e["name"], e["class_name"], p.resolve(e["outer"]), e["size"], None if values is None else json.dumps(values), t.get("form"), t.get("width"), t.get("height"), t.get("png"), note, None))
                except Exception as e:  # a broken file is a row, whatever broke it
                    rows = [(path, *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("number", "byte_size", "width", "height")})

    return with_sidecars(files).mapInPandas(run, EXPORT_SCHEMA)
