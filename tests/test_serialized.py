import struct

import pytest

from stratasift.rules.strings import COMMON_STRINGS, string_table
from stratasift.sources import serialized


def fixture(version: int = 17) -> bytes:
    """One TextAsset: a string, then an int array."""
    place = {n: at | 1 << 31 for at, n in string_table().items()}
    own = b"m_Values\0"
    nodes = [
        (0, "TextAsset", place["Base"], 0), (1, "string", place["m_Name"], 0), (2, "Array", place["Array"], serialized.ALIGN), (3, "int", place["size"], 0), (3, "char", place["data"], 0),
        (1, "vector", 0, 0), (2, "Array", place["Array"], 0), (3, "int", place["size"], 0), (3, "int", place["data"], 0),
    ]
    tree = struct.pack("<ii", len(nodes), len(own))
    for level, kind, name, meta in nodes:
        tree += struct.pack("<HBBIIiii", 1, level, 0, place[kind], name, -1, 0, meta) + (b"\0" * 8 if version >= 19 else b"")
    tree += own
    types = struct.pack("<i", 1) + struct.pack("<i?h", 49, False, -1) + b"\0" * 16 + tree + (struct.pack("<i", 0) if version >= 21 else b"")
    value = struct.pack("<i", 5) + b"hello\0\0\0" + struct.pack("<i3i", 3, 7, 8, 9)
    meta = b"2018.4.1f1\0" + struct.pack("<i?", 5, True) + types + struct.pack("<i", 1)
    lead = 20 if version < 22 else 48
    meta += b"\0" * (-(lead + len(meta)) % 4)
    meta += struct.pack("<q" + ("q" if version >= 22 else "I") + "Ii", 1, 0, len(value), 0)
    at = lead + len(meta)
    size = at + len(value)
    if version < 22:
        head = struct.pack(">IIII", len(meta), size, version, at) + b"\0" * 4
    else:
        head = struct.pack(">IIII", 0, 0, version, 0) + b"\0" * 4 + struct.pack(">Iqqq", len(meta), size, at, 0)
    return head + meta + value


@pytest.mark.parametrize("version", [17, 19, 21, 22])
def test_objects(version):
    (o,) = serialized.read_objects(fixture(version))
    assert o["class_name"] == "TextAsset" and o["value"] == {"m_Name": "hello", "m_Values": [7, 8, 9]}


def test_unsupported_and_broken(spark):
    with pytest.raises(ValueError):
        serialized.read_objects(fixture()[:8] + struct.pack(">I", 99) + fixture()[12:])
    rows = serialized.object_rows(spark.createDataFrame([("a", bytearray(fixture())), ("b", bytearray(b"no"))], "virtual_path string, content binary")).collect()
    assert {r.virtual_path: r.error is None for r in rows} == {"a": True, "b": False}


def test_strings():
    assert len(COMMON_STRINGS) == len(set(COMMON_STRINGS)) and serialized.resolve(1 << 31, b"") == "AABB" and serialized.resolve(1 << 31 | 1, b"").startswith("unknown_common")
