"""Containers, models and images against hand-built bytes."""

import io
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest

from stratasift.sources import archives, images, models, scan

CUBE = b"""mtllib cube.mtl
v 0 0 0
v 1 0 0
v 1 1 0
v 0 1 0
v 0 0 1
v 1 0 1
v 1 1 1
v 0 1 1
vt 0 0
vt 1 0
vt 1 1
vt 0 1
vn 0 0 1
usemtl body
f 1/1/1 2/2/1 3/3/1 4/4/1
f 5/1/1 6/2/1 7/3/1 8/4/1
"""


def zipped(**files: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def named(rows):
    return {r["member"]: r["content"] for r in rows if r["error"] is None}


def test_zip_members_and_path_safety():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("../../escaped.txt", "x")
        z.writestr("ok.txt", "y")
    rows = archives.members_of("a.zip", out.getvalue())
    assert named(rows) == {"ok.txt": b"y"}
    assert any(r["error"] and "leaves its root" in r["error"] for r in rows)


@pytest.mark.parametrize(("path", "safe"), [("/etc/passwd", "etc/passwd"), ("C:\\Windows\\system32\\x.dll", "Windows/system32/x.dll"), ("a/./b", "a/b"), ("a/../con.txt", "_con.txt")])
def test_safe_path(path, safe):
    assert archives.safe_path(path) == safe


@pytest.mark.parametrize("path", ["../../etc/passwd", "a/../../b", "", "./"])
def test_unsafe_path(path):
    with pytest.raises(archives.Unsafe):
        archives.safe_path(path)


def test_tar_skips_links():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("f.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    assert named(archives.members_of("a.tar", out.getvalue())) == {"f.txt": b"hi"}


def test_budgets():
    bomb = zipped(a=b"\0" * (8 << 20))
    rows = archives.members_of("b.zip", bomb, max_bytes=1 << 20)
    assert not named(rows) and "size limit" in rows[-1]["error"]
    rows = archives.members_of("e.zip", zipped(a=b"1", b=b"2", c=b"3", d=b"4"), max_entries=3)
    assert list(named(rows)) == ["a", "b", "c"] and "entry limit" in rows[-1]["error"]


def test_broken_and_unsupported():
    assert archives.members_of("x.zip", b"PK\3\4garbage")[0]["error"]
    assert "unsupported" in archives.members_of("x.cab", b"MSCF....")[0]["error"]
    assert archives.members_of("x.txt", b"plain text, nothing else in here") == []


def afs(names: bool) -> bytes:
    parts = [b"one" * 10, b"two" * 7, b"three"]
    at, table, body = 2048, [], b""
    for p in parts:
        table.append((at + len(body), len(p)))
        body += p + b"\0" * (-len(p) % 2048)
    head = b"AFS\0" + struct.pack("<I", 3) + b"".join(struct.pack("<II", *t) for t in table)
    records = b"".join(f"n{i}.bin".encode().ljust(48, b"\0") for i in range(3))
    head += struct.pack("<II", 2048 + len(body), len(records)) if names else struct.pack("<II", 0, 0)
    return head.ljust(2048, b"\0") + body + records


def test_afs():
    assert named(archives.members_of("a.afs", afs(True)))["n1.bin"] == b"two" * 7
    assert list(named(archives.members_of("a.afs", afs(False)))) == [f"file_{i:05d}.bin" for i in range(3)]


def test_offset_table():
    parts = [bytes([i]) * 1024 for i in range(1, 5)]
    starts = [20 + 1024 * i for i in range(4)]
    blob = struct.pack("<5I", 4, *starts) + b"".join(parts)
    assert named(archives.members_of("d/x.dat", blob)) == {f"x_{i:05d}.dat": p for i, p in enumerate(parts)}
    pairs = struct.pack("<11I", 5, 44, 1024, 1068, 1024, 0, 0, 2092, 1024, 3116, 1024) + b"".join(parts)
    assert list(named(archives.members_of("x.dat", pairs)).values()) == parts
    few = struct.pack("<4I", 3, 16, 2064, 4112) + b"\1" * 6144
    for other in (few, blob[:4090], struct.pack("<5I", 4, 20, 24, 22, 28) + blob[20:], pairs + b"\0" * 4100, np.random.default_rng(1).bytes(4096), b"this is just text " * 300):
        assert archives.offset_table(other) is None


def test_template_container():
    body = b"MYG0" + struct.pack("<I", 1) + struct.pack("<II", 16, 4) + b"abcd"
    assert list(named(archives.members_of("x.myg", body)).values()) == [b"abcd"]


def test_lz4():
    assert archives.lz4_block(bytes([0x40]) + b"abcd") == b"abcd"
    assert archives.lz4_block(bytes([0x40]) + b"abcd" + struct.pack("<H", 4) + b"\x10e"[:2]) == b"abcdabcde"
    assert archives.lz4_block(bytes([0x1F]) + b"a" + struct.pack("<H", 1) + bytes([0, 0x10]) + b"z") == b"a" * 20 + b"z"
    with pytest.raises(ValueError):
        archives.lz4_block(bytes([0x14]) + b"a" + struct.pack("<H", 9))


def pak() -> bytes:
    def record(offset, data, raw, method, blocks=()):
        out = struct.pack("<QQQI", offset, len(data), len(raw), method) + b"\0" * 20
        if method:
            out += struct.pack("<I", len(blocks)) + b"".join(struct.pack("<QQ", *b) for b in blocks)
        return out + struct.pack("<BI", 0, 65536)

    plain, raw = b"hello", b"x" * 1000
    packed = zlib.compress(raw)
    body = record(0, plain, plain, 0) + plain
    start = len(body)
    lead = len(record(0, packed, raw, 1, [(0, 0)]))
    blocks = [(lead, lead + len(packed))]
    body += record(0, packed, raw, 1, blocks) + packed
    string = lambda s: struct.pack("<i", len(s) + 1) + s.encode() + b"\0"
    index = string("../../../") + struct.pack("<I", 2) + string("a.txt") + record(0, plain, plain, 0) + string("b.bin") + record(start, packed, raw, 1, blocks)
    footer = b"\0" * 16 + b"\0" + struct.pack("<IIQQ", archives.PAK_MAGIC, 8, len(body), len(index)) + b"\0" * 20 + b"Zlib".ljust(32, b"\0") + b"\0" * 96
    return body + index + footer


def test_pak():
    assert named(archives.members_of("p.pak", pak())) == {"a.txt": b"hello", "b.bin": b"x" * 1000}


def test_pak_directory_index():
    data = b"payload"
    record = struct.pack("<QQQI", 0, len(data), len(data), 0) + b"\0" * 20 + struct.pack("<BI", 0, 0)
    body = record + data
    string = lambda s: struct.pack("<i", len(s) + 1) + s.encode() + b"\0"
    encoded = struct.pack("<3I", 1 << 31 | 1 << 30, 0, len(data))
    directory = struct.pack("<I", 1) + string("Game/") + struct.pack("<I", 1) + string("x.bin") + struct.pack("<i", 0)
    lead = string("../../../") + struct.pack("<IQ", 1, 7) + struct.pack("<I", 0) + struct.pack("<I", 1)
    size = len(lead) + 36 + 4 + len(encoded)
    index = lead + struct.pack("<QQ", len(body) + size, len(directory)) + b"\0" * 20 + struct.pack("<I", len(encoded)) + encoded
    footer = b"\0" * 17 + struct.pack("<IIQQ", archives.PAK_MAGIC, 11, len(body), size) + b"\0" * 20 + b"Zlib".ljust(160, b"\0")
    assert named(archives.members_of("p.pak", body + index + directory + footer)) == {"Game/x.bin": data}


def test_dae():
    import xml.etree.ElementTree as tree

    root = tree.fromstring(models.write_dae(rigged()))
    assert len(root.findall(".//{*}geometry")) == 1 and [n.get("name") for n in root.iter("{http://www.collada.org/2005/11/COLLADASchema}node") if n.get("type") == "JOINT"] == ["Hips", "Spine", "Head"]


def test_pak_encoded_entry():
    bits = 1 << 31 | 1 << 30 | 1 << 29 | 1 << 23 | 1 << 6 | 3
    e = archives.pak_encoded_entry(struct.pack("<4I", bits, 4096, 2048, 1024), 0)
    assert (e["offset"], e["unpacked"], e["size"], e["method"], e["n_blocks"], e["encrypted"]) == (4096, 2048, 1024, 1, 1, False)


def unity_bundle(kind: int) -> bytes:
    data = b"serialized bytes " * 20
    stored = bytes([0xF0, len(data) - 15 if len(data) - 15 < 255 else 255]) if kind else b""
    if kind:
        rest = len(data) - 15
        lengths = b"\xff" * (rest // 255) + bytes([rest % 255])
        stored = b"\xf0" + lengths + data
    else:
        stored = data
    table = b"\0" * 16 + struct.pack(">I", 1) + struct.pack(">IIH", len(data), len(stored), kind) + struct.pack(">I", 1) + struct.pack(">qqI", 0, len(data), 4) + b"CAB-1\0"
    head = b"UnityFS\0" + struct.pack(">I", 6) + b"5.x.x\0" + b"2018.4\0"
    return head + struct.pack(">qIII", 0, len(table), len(table), 0) + table + stored


@pytest.mark.parametrize("kind", [0, 2])
def test_unity_bundle(kind):
    assert named(archives.members_of("a.bundle", unity_bundle(kind))) == {"CAB-1": b"serialized bytes " * 20}


def iso() -> bytes:
    def record(name: bytes, lba: int, size: int, flags: int = 0) -> bytes:
        n = 33 + len(name) + (1 - len(name) % 2)
        r = bytearray(n)
        r[0], r[25], r[32] = n, flags, len(name)
        struct.pack_into("<I", r, 2, lba)
        struct.pack_into("<I", r, 10, size)
        r[33 : 33 + len(name)] = name
        return bytes(r)

    files = {b"SYSTEM.CNF;1": b"BOOT2 = cdrom0:", b"MODEL.BIN;1": b"m" * 3000}
    root = record(b"\0", 20, 2048, 2) + record(b"\1", 20, 2048, 2)
    at, payload = 21, b""
    for name, data in files.items():
        root += record(name, at, len(data))
        payload += data.ljust(-(-len(data) // 2048) * 2048, b"\0")
        at += -(-len(data) // 2048)
    pvd = bytearray(2048)
    pvd[0], pvd[1:6] = 1, b"CD001"
    pvd[156:190] = record(b"\0", 20, 2048, 2)
    end = bytearray(2048)
    end[0], end[1:6] = 255, b"CD001"
    return b"\0" * 16 * 2048 + bytes(pvd) + bytes(end) + b"\0" * 2 * 2048 + root.ljust(2048, b"\0") + payload


def test_iso():
    image = archives.Iso(iso())
    assert image.platform() == "PS1/PS2"
    assert named(archives.members_of("d.iso", iso())) == {"SYSTEM.CNF": b"BOOT2 = cdrom0:", "MODEL.BIN": b"m" * 3000}
    raw = b"".join(b"\0" * 24 + iso()[i : i + 2048] + b"\0" * 280 for i in range(0, len(iso()), 2048))
    assert named(archives.members_of("d.bin", raw))["MODEL.BIN"] == b"m" * 3000


def test_cue(spark):
    sheet = b'FILE "track 1.bin" BINARY\n  TRACK 01 MODE2/2352\n file two.bin BINARY\nREM FILE x'
    files = [("d/a.cue", sheet), ("d/track 1.bin", b"x"), ("two.bin", b"y"), ("e.CUE", b"\xff"), ("f.cue", None)]
    tracks = scan.cue_tracks(spark.createDataFrame(files, "virtual_path string, content binary")).collect()
    assert {tuple(r) for r in tracks} == {("d/a.cue", "d/track 1.bin", True), ("d/a.cue", "d/two.bin", False)}
    assert archives.members_of("d/a.cue", sheet) == []


def test_obj_and_mtl():
    m = models.parse_obj(CUBE, "cube")
    assert sum(len(x["vertices"]) for x in m["meshes"]) == 8 and sum(len(x["indices"]) // 3 for x in m["meshes"]) == 4
    assert m["materials"][0]["name"] == "body" and m["libraries"] == ["cube.mtl"]
    mtl = models.parse_mtl(b"newmtl body\nKd .8 .3 .2\nNs 250\nmap_Kd texture.png\n")
    assert mtl[0]["base_color"][:3] == [0.8, 0.3, 0.2] and mtl[0]["roughness"] == pytest.approx(0.5) and mtl[0]["textures"] == {"diffuse": "texture.png"}


def test_obj_negative_indices_and_bad_lines():
    m = models.parse_obj(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nv x y z\nf -3 -2 -1\nf 1 2 bad\n")
    assert len(m["meshes"][0]["vertices"]) >= 3 and m["meshes"][0]["indices"][:3].tolist() == [0, 1, 2]


def test_stl_and_ply():
    blob = b"\0" * 80 + struct.pack("<I", 1) + struct.pack("<12fH", 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0)
    m = models.parse_stl(blob)
    assert len(m["meshes"][0]["vertices"]) == 3 and len(m["meshes"][0]["indices"]) == 3
    text = b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    assert models.parse_ply(text)["meshes"][0]["indices"].tolist() == [0, 1, 2, 0, 2, 3]
    for order, mark in (("<", b"little"), (">", b"big")):
        head = text[: text.index(b"0 0 0")].replace(b"ascii", b"binary_" + mark + b"_endian")
        body = struct.pack(order + "12f", 0, 0, 0, 1, 0, 0, 1, 1, 0, 0, 1, 0) + struct.pack(order + "B4i", 4, 0, 1, 2, 3)
        assert models.parse_ply(head + body)["meshes"][0]["indices"].tolist() == [0, 1, 2, 0, 2, 3]


def rigged() -> dict:
    m = models.model("test", "hero")
    m["materials"] = [{"name": "body", "base_color": [0.8, 0.3, 0.2, 1], "roughness": 0.5, "textures": {}}]
    m["meshes"] = [models.mesh("hero", [[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], [0, 1, 2, 0, 2, 3], material=0, joints=np.zeros((4, 4), int), weights=np.array([[2.0, 0, 0, 0]] * 4))]
    m["bones"] = [{"name": n, "parent": p, "translation": [0, 1, 0], "rotation": [0, 0, 0, 1], "scale": [1, 1, 1]} for n, p in (("Hips", -1), ("Spine", 0), ("Head", 1))]
    m["clips"] = [{"name": "Idle", "duration": 1.0, "tracks": {"Spine": {"rotation": [(0.0, [0, 0, 0, 1]), (1.0, [0, 0, 1, 0])], "translation": [(0.0, [0, 0, 0]), (1.0, [0, 1, 0])]}}}]
    return m


def test_glb_round_trip():
    m = models.parse_gltf(models.write_glb(rigged()), "hero")
    assert len(m["meshes"][0]["vertices"]) == 4 and len(m["meshes"][0]["indices"]) == 6
    assert [(b["name"], b["parent"]) for b in m["bones"]] == [("Hips", -1), ("Spine", 0), ("Head", 1)]
    assert m["meshes"][0]["joints"] is not None and np.allclose(m["meshes"][0]["weights"].sum(axis=1), 1)
    assert m["clips"][0]["duration"] == pytest.approx(1.0) and set(m["clips"][0]["tracks"]["Spine"]) == {"rotation", "translation"}
    with pytest.raises(ValueError):
        models.parse_gltf(models.write_glb(rigged())[:12])


def test_obj_round_trip():
    text, mtl = models.write_obj(models.parse_obj(CUBE, "cube"))
    again = models.parse_obj(text.encode())
    assert sum(len(x["vertices"]) for x in again["meshes"]) == 8 and "newmtl body" in mtl


def test_bvh():
    blob = b"""HIERARCHY
ROOT Hips
{
 OFFSET 0 0 0
 CHANNELS 6 Xposition Yposition Zposition Zrotation Xrotation Yrotation
 JOINT Spine
 {
  OFFSET 0 1 0
  CHANNELS 3 Zrotation Xrotation Yrotation
  End Site
  {
   OFFSET 0 1 0
  }
 }
}
MOTION
Frames: 3
Frame Time: 0.033333
0 1 0 0 0 0 0 0 0
0 2 0 90 0 0 0 0 0
0 3 0 0 0 0 0 0 0
"""
    m = models.parse_bvh(blob)
    track = m["clips"][0]["tracks"]["Hips"]
    assert [b["name"] for b in m["bones"]] == ["Hips", "Spine"] and len(m["clips"][0]["tracks"]) == 2
    assert len(track["translation"]) == 3 and len(track["rotation"]) == 3
    assert track["rotation"][1][1] == pytest.approx([0, 0, 0.5**0.5, 0.5**0.5])


def test_validation():
    m = models.model("x", "x")
    m["meshes"] = [models.mesh("m", np.zeros((4, 3)), [0, 1, 99])]
    issues, _ = models.validate(m)
    assert any("out-of-range" in i for i in issues)
    assert models.validate(models.model("x", "x"))[0] == ["no mesh"] and models.quality(models.model("x", "x")) == 0
    assert models.validate(rigged()) == ([], []) and models.quality(rigged()) == pytest.approx(0.75)
    loop = rigged()
    loop["bones"][0]["parent"] = 2
    assert any("cycle" in i for i in models.validate(loop)[0])


def test_images():
    png = images.write_png(np.zeros((16, 32, 3)))
    assert images.read_header(png) == {"format": "PNG", "width": 32, "height": 16}
    assert images.read_header(b"GIF89a" + struct.pack("<HH", 7, 9))["height"] == 9
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 10
    assert images.read_header(jpeg)["width"] == 30
    assert images.read_header(b"nothing") is None
    blob = b"HEADER" + b"\0" * 100 + png + b"\xff" * 50
    assert images.find_embedded(blob, {"PNG": b"\x89PNG\r\n\x1a\n"}) == [(106, "PNG")]


def test_blocks():
    white, black = struct.pack("<HHI", 0xFFFF, 0, 0), struct.pack("<HHI", 0, 0, 0)
    assert (images.decode_blocks(white, 4, 4, "BC1") == 255).all() and (images.decode_blocks(black, 4, 4, "BC1")[..., :3] == 0).all()
    assert (images.decode_blocks(bytes([255, 255]) + b"\0" * 6 + white, 4, 4, "BC3")[..., 3] == 255).all()
    assert images.decode_blocks(white * 4, 5, 7, "BC1").shape == (7, 5, 4)
    rng = np.random.default_rng(1)
    swizzled = np.stack([np.full((8, 8), 255), rng.integers(0, 255, (8, 8)), rng.integers(0, 255, (8, 8)), rng.integers(0, 255, (8, 8))], axis=-1)
    assert images.unswizzle_normal(swizzled)[1] and not images.unswizzle_normal(np.full((8, 8, 4), 255))[1]


def test_tim_and_bits():
    tim = struct.pack("<II", 0x10, 2) + struct.pack("<IHHHH", 12 + 8, 0, 0, 2, 2) + struct.pack("<4H", 31, 0x8000, 0, 0x7FFF)
    p = images.decode_tim(tim)
    assert p[0, 0].tolist() == [255, 0, 0, 255] and p[1, 0, 3] == 0 and p[0, 1, 3] == 255 and p[1, 1].tolist() == [255] * 4
    assert images.unpack_bits(bytes([0x21, 0x43]), 4, 4).tolist() == [1, 2, 3, 4]
    assert images.unpack_bits(bytes([0xF0]), 2, 4, -1, 2).tolist() == [-1, 1]


def test_scan_detects_and_expands(spark, tmp_path):
    root = tmp_path / "game" / "data" / "models"
    root.mkdir(parents=True)
    (root / "cube.obj").write_bytes(CUBE)
    (root / "copy.obj").write_bytes(CUBE)
    (root / "pack.pak").write_bytes(zipped(**{"level1.zip": zipped(**{"level2.zip": zipped(**{"leaf.obj": CUBE + b"# x\n"})})}))
    (root / "x.forge").write_bytes(b"scimitar\0" + struct.pack("<I", 27) + b"\xff" * 90)
    (root / "t.tim").write_bytes(struct.pack("<II", 0x10, 2) + struct.pack("<IHHHH", 20, 0, 0, 2, 2) + b"\xff" * 8)
    (root / "u.bin").write_bytes(b"\x93\xfe" * 200)
    files = scan.read_files(spark, str(tmp_path / "game"))
    found = {r.virtual_path: r for r in scan.detect(spark, files).collect()}
    assert found["data/models/cube.obj"].format == "Wavefront OBJ" and found["data/models/pack.pak"].category == "archive"
    assert found["data/models/x.forge"].engine == "Anvil" and found["data/models/t.tim"].format == "Sony TIM texture"
    assert found["data/models/u.bin"].format == "Unknown binary" and found["data/models/copy.obj"].confidence > 0.9
    whole, problems = scan.expand(spark, files, work_dir=str(tmp_path / "work"))
    paths = {r.virtual_path: r.depth for r in whole.select("virtual_path", "depth").collect()}
    assert paths["data/models/pack.pak!level1.zip!level2.zip!leaf.obj"] == 3 and problems.count() == 0
    _, cut = scan.expand(spark, files, max_depth=1, work_dir=str(tmp_path / "work2"))
    assert any("nesting depth" in r.reason for r in cut.collect())
    parsed = {r.virtual_path: r for r in models.parse_models(whole).collect()}
    assert len(parsed) == 3 and all(r.valid and r.triangles == 4 for r in parsed.values())


def test_cli(spark, tmp_path, capsys):
    import json

    from stratasift import cli

    root = tmp_path / "g"
    root.mkdir()
    (root / "cube.obj").write_bytes(CUBE)
    (root / "globalgamemanagers").write_bytes(b"\1" * 50)
    assert cli.main(["scan", str(root), "--out", str(tmp_path / "o"), "--work", str(tmp_path / "w")]) == 0
    assert json.loads(capsys.readouterr().out)["models"] == 1 and (tmp_path / "o" / "report.html").exists()
    assert cli.main(["detect", str(root)]) == 0 and "Unity" in capsys.readouterr().out
    assert cli.main(["formats"]) == 0 and cli.main(["bogus"]) == 2 and cli.main(["inspect", str(tmp_path / "none")]) == 1
