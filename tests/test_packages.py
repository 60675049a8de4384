import json
import struct
import zlib

import numpy as np
import pytest

from stratasift.sources import images, packages

NAMES = ["None", "/Script/Engine", "Class", "Texture2D", "StaticMesh", "Wall", "Floor", "IntProperty", "Size", "BoolProperty", "SRGB", "StructProperty", "Place", "Vector", "ArrayProperty", "Materials", "ObjectProperty", "Odd", "MapProperty", "PF_B8G8R8A8", "PF_DXT1"]


def text(s: str) -> bytes:
    raw = s.encode() + b"\0" if s else b""
    return struct.pack("<i", len(raw)) + raw


def name(s: str, number: int = 0) -> bytes:
    return struct.pack("<ii", NAMES.index(s), number)


def tag(key: str, kind: str, value: bytes, about: bytes = b"") -> bytes:
    return name(key) + name(kind) + struct.pack("<ii", len(value), 0) + about + b"\0" + value


def package(held: list[tuple[int, str, bytes]], hashed: bool = True, template: bool = True, wide: bool = True, behind: int = 36) -> tuple[bytes, bytes]:
    """A package with one import, and the sidecar that holds its exports."""
    names = b"".join(text(n) + b"\0" * (4 if hashed else 0) for n in NAMES)
    imports = b"".join(name("/Script/Engine") + name("Class") + struct.pack("<i", 0) + name(n) for n in ("Texture2D", "StaticMesh"))
    lead = struct.pack("<Iiiiii", packages.MAGIC, -7, 864, 522, 0, 0)
    after = text("None") + struct.pack("<I", 0)
    at = len(lead) + 4 + len(after) + 8 + 4 + 8 + 20
    record = 12 + 4 * template + 8 + 4 + (16 if wide else 8) + behind
    imports_at, exports_at = at + len(names), at + len(names) + len(imports)
    end = exports_at + record * len(held)
    exports, place = b"", end
    for cls, n, data in held:
        exports += struct.pack("<ii", cls, 0) + b"\0" * (4 * template) + struct.pack("<i", 0) + name(n) + struct.pack("<I", 0) + struct.pack("<qq" if wide else "<ii", len(data), place) + b"\0" * behind
        place += len(data)
    head = lead + struct.pack("<i", end) + after + struct.pack("<ii", len(NAMES), at) + text("") + struct.pack("<ii", 0, 0) + struct.pack("<5i", len(held), exports_at, 2, imports_at, end)
    return head + names + imports + exports, b"".join(d for *_, d in held)


def properties() -> bytes:
    slots = struct.pack("<i", 2) + struct.pack("<ii", -1, 1)
    return b"".join([
        tag("Size", "IntProperty", struct.pack("<i", 1234)),
        name("SRGB") + name("BoolProperty") + struct.pack("<ii", 0, 0) + b"\1\0",
        tag("Place", "StructProperty", struct.pack("<3f", 1, 2, 3), name("Vector") + b"\0" * 16),
        tag("Odd", "MapProperty", b"?????", name("Size") + name("Size")),
        tag("Materials", "ArrayProperty", slots, name("ObjectProperty")),
        name("None"),
    ])


def texture(form: str, pixels: bytes, width: int, height: int, flags: int = packages.INLINE, at: int = 0) -> bytes:
    mip = b"\0" * 4 + struct.pack("<iiiq", flags, len(pixels), len(pixels), at) + (pixels if flags & packages.INLINE else b"") + struct.pack("<iii", width, height, 1)
    return name("None") + b"\0" * 8 + name(form) + struct.pack("<qiii", 0, width, height, 1) + text(form) + struct.pack("<ii", 0, 1) + mip


@pytest.mark.parametrize("hashed", [True, False])
@pytest.mark.parametrize("template,wide", [(True, True), (True, False), (False, True), (False, False)])
def test_tables(hashed, template, wide):
    p = packages.Package(*package([(-1, "Wall", b"\0" * 90), (-2, "Floor", properties())], hashed, template, wide, 40))
    assert p.names == NAMES and [i["name"] for i in p.imports] == ["Texture2D", "StaticMesh"]
    assert [(e["name"], e["class_name"], e["size"]) for e in p.exports] == [("Wall", "Texture2D", 90), ("Floor", "StaticMesh", len(properties()))]
    assert [p.resolve(i) for i in (1, -2, 0, 3, -3)] == ["Wall", "StaticMesh", "None", "None", "None"]


def test_properties():
    p = packages.Package(*package([(-2, "Floor", properties())]))
    values, end = p.properties(p.exports[0])
    assert values == {"Size": 1234, "SRGB": True, "Place": [1, 2, 3], "Odd": None, "Materials": ["Texture2D", "Floor"]} and end == len(properties())
    assert packages.describe_mesh("Floor", "StaticMesh", values) == "StaticMesh 'Floor', 2 material slot(s)"
    cut = packages.Package(*package([(-2, "Floor", properties()[:30])]))
    assert cut.properties(cut.exports[0])[0] is None


def test_no_package():
    with pytest.raises(packages.Unsupported):
        packages.Package(b"NOT A PACKAGE" + b"\0" * 128)
    data, held = package([(-1, "Wall", b"\0" * 90)])
    for n in range(0, len(data), 7):
        with pytest.raises((ValueError, struct.error)):
            packages.Package(data[:n], held)


def unfiltered(png: bytes) -> np.ndarray:
    width, height = struct.unpack_from(">II", png, 16)
    at = png.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + struct.unpack_from(">I", png, at - 4)[0]]), np.uint8)
    return rows.reshape(height, -1)[:, 1:].reshape(height, width, -1)


def test_textures():
    pixels = bytes(range(64))
    bgra = np.frombuffer(pixels, np.uint8).reshape(4, 4, 4)[..., [2, 1, 0, 3]]
    p = packages.Package(*package([(-1, "Wall", texture("PF_B8G8R8A8", pixels, 4, 4))]))
    found = packages.texture(p, p.exports[0])
    assert (found["form"], found["width"], found["height"], found["reason"]) == ("PF_B8G8R8A8", 4, 4, None) and (unfiltered(found["png"]) == bgra).all()
    away = packages.Package(*package([(-1, "Wall", texture("PF_B8G8R8A8", pixels, 4, 4, packages.SEPARATE, 3))]))
    assert packages.texture(away, away.exports[0])["png"] is None
    assert (unfiltered(packages.texture(away, away.exports[0], b"???" + pixels)["png"]) == bgra).all()


def test_blocks_of_explicit_alpha():
    block = bytes([0x10] + [0] * 7) + struct.pack("<HHI", 0xF800, 0, 0)
    out = images.decode_blocks(block, 4, 4, "DXT3")
    assert out[0, 0].tolist() == [255, 0, 0, 0] and out[0, 1].tolist() == [255, 0, 0, 17]
    assert images.packed_565(struct.pack("<2H", 0x07E0, 0x001F), 2, 1).tolist() == [[[0, 252, 0, 255], [0, 0, 248, 255]]]


def test_package_exports(spark):
    pixels = bytes(range(64))
    data, held = package([(-1, "Wall", texture("PF_B8G8R8A8", pixels, 4, 4, packages.SEPARATE, 3)), (-2, "Floor", properties())])
    files = [("a/x.uasset", data), ("a/x.uexp", held), ("a/x.ubulk", b"???" + pixels), ("b/x.uasset", data), ("c.uasset", b"no"), ("d.umap", None), ("e.txt", b"text")]
    rows = packages.package_exports(spark.createDataFrame(files, "virtual_path string, content binary")).collect()
    by = {(r.virtual_path, r.number): r for r in rows}
    assert set(by) == {("a/x.uasset", 1), ("a/x.uasset", 2), ("b/x.uasset", 1), ("b/x.uasset", 2), ("c.uasset", None), ("d.umap", None)}
    assert by["a/x.uasset", 1].png is not None and by["a/x.uasset", 1].width == 4 and by["a/x.uasset", 1].error is None
    assert json.loads(by["a/x.uasset", 2].properties)["Size"] == 1234 and by["a/x.uasset", 2].note == "StaticMesh 'Floor', 2 material slot(s)"
    assert by["c.uasset", None].error and by["d.umap", None].error
    assert by["b/x.uasset", 1].png is None and by["b/x.uasset", 1].note == "no cooked texture data"
