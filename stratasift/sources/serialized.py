"""Serialized asset files with a type tree: object tables, and schema-on-read values as JSON rows."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from stratasift.rules.strings import string_table

#: Struct codes of the primitive type names, the flag of nodes that align, versions that are read.
PRIMITIVES = {
    "SInt8": "b", "UInt8": "B", "char": "B", "bool": "?", "SInt16": "h", "short": "h", "UInt16": "H", "unsigned short": "H", "SInt32": "i", "int": "i", "UInt32": "I", "unsigned int": "I", "Type*": "I",
    "SInt64": "q", "long long": "q", "UInt64": "Q", "unsigned long long": "Q", "FileSize": "Q", "float": "f", "double": "d",
}
ALIGN, VERSIONS = 0x4000, range(13, 24)
CLASS_NAMES = {1: "GameObject", 4: "Transform", 21: "Material", 23: "MeshRenderer", 28: "Texture2D", 33: "MeshFilter", 43: "Mesh", 48: "Shader", 49: "TextAsset", 74: "AnimationClip", 83: "AudioClip", 90: "Avatar", 95: "Animator", 114: "MonoBehaviour", 137: "SkinnedMeshRenderer", 142: "AssetBundle", 213: "Sprite"}
_COMMON = string_table()


def resolve(offset: int, buffer: bytes) -> str:
    """A name by its offset: into the built-in table with bit 31 set, else into the file's own buffer."""
    if offset >> 31:
        return _COMMON.get(offset & 0x7FFFFFFF, f"unknown_common_{offset & 0x7FFFFFFF}")
    end = buffer.find(b"\0", offset)
    return buffer[offset:end].decode("utf-8", "replace") if 0 <= offset < len(buffer) and end >= 0 else f"unknown_{offset}"


class Cursor:
    def __init__(self, data: bytes, at: int = 0, big: bool = False):
        self.data, self.at, self.order = data, at, ">" if big else "<"

    def take(self, code: str):
        form = self.order + code
        (v,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return v

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("read beyond the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def align(self, base: int = 0) -> None:
        self.at += -(self.at - base) % 4


def tree_nodes(c: Cursor, version: int) -> list[dict]:
    """Nodes of a type tree blob in file order: level, type, name, size, align."""
    count, size = c.take("i"), c.take("i")
    fields = [("version", "u2"), ("level", "u1"), ("flags", "u1"), ("type", "u4"), ("name", "u4"), ("size", "i4"), ("index", "i4"), ("meta", "i4"), *([("hash", "u8")] if version >= 19 else [])]
    kind = np.dtype([(n, c.order + f) for n, f in fields])
    rows = np.frombuffer(c.raw(count * kind.itemsize), kind)
    names = c.raw(size)
    return [{"level": int(r["level"]), "type": resolve(int(r["type"]), names), "name": resolve(int(r["name"]), names), "size": int(r["size"]), "align": bool(r["meta"] & ALIGN)} for r in rows]


def nest(nodes: list[dict]) -> dict:
    """A level-encoded list as a tree: a node's parent is the last one before it that is a level higher."""
    last: dict[int, dict] = {}
    for n in nodes:
        n = {**n, "children": []}
        last[n["level"]] = n
        if n["level"]:
            last[n["level"] - 1]["children"].append(n)
    return last[0]


def read_value(c: Cursor, node: dict, base: int):
    """The value that a tree node describes, at the cursor."""
    kind, children = node["type"], node["children"]
    align = node["align"]
    if kind in PRIMITIVES:
        v = c.take(PRIMITIVES[kind])
    elif kind == "string":
        v = c.raw(c.take("i")).decode("utf-8", "replace")
        align = True
    elif kind == "TypelessData":
        v = c.raw(c.take("i")).hex()
        align = True
    elif len(children) == 1 and children[0]["type"] == "Array" or kind == "Array":
        array = node if kind == "Array" else children[0]
        n, item = c.take("i"), array["children"][1]
        if n < 0 or n > len(c.data):
            raise ValueError("implausible array size")
        if item["type"] in PRIMITIVES and not item["align"]:
            code = c.order + PRIMITIVES[item["type"]]
            v = list(struct.unpack(f"{code[0]}{n}{code[1]}", c.raw(n * struct.calcsize(code))))
        else:
            v = [read_value(c, item, base) for _ in range(n)]
        align = align or array["align"]
    else:
        v = {child["name"]: read_value(c, child, base) for child in children}
    if align:
        c.align(base)
    return v


def read_objects(data: bytes) -> list[dict]:
    """Rows of the object table: path_id, class_id, class_name, byte_start, byte_size, and value where the file has type trees."""
    head = Cursor(data, 0, True)
    _, _, version, data_at = (head.take("I") for _ in range(4))
    if version not in VERSIONS:
        raise ValueError(f"unsupported serialized version {version}")
    big = head.take("B") != 0
    head.at += 3
    if version >= 22:
        head.take("I"), head.take("q")
        data_at = head.take("q")
        head.take("q")
    if not 0 < data_at <= len(data):
        raise ValueError("data offset outside the file")
    c = Cursor(data, head.at, big)
    c.text(), c.take("i")
    trees = c.take("?")
    types = []
    for _ in range(c.take("i")):
        class_id = c.take("i")
        if version >= 16:
            c.take("?")
        if version >= 17:
            c.take("h")
        if class_id == 114 if version >= 16 else class_id < 0:
            c.raw(16)
        c.raw(16)
        root = None
        if trees:
            root = nest(tree_nodes(c, version))
            if version >= 21:
                c.raw(4 * max(0, c.take("i")))
        types.append((class_id, root))
    out = []
    for _ in range(c.take("i")):
        c.align()
        path_id = c.take("q")
        start = (c.take("q") if version >= 22 else c.take("I")) + data_at
        size, type_no = c.take("I"), c.take("i")
        class_id, root = types[type_no] if version >= 16 else next(t for t in types if t[0] == type_no)
        if version < 16:
            c.take("H"), c.take("h")
            if version == 15:
                c.take("B")
        row = {"path_id": path_id, "class_id": class_id, "class_name": CLASS_NAMES.get(class_id, f"Class{class_id}"), "byte_start": start, "byte_size": size, "value": None}
        if root:
            row["value"] = read_value(Cursor(data[start : start + size], 0, big), root, 0)
        out.append(row)
    return out


def object_rows(files: DataFrame) -> DataFrame:
    """The objects of serialized files (virtual_path, content), values as JSON; a file that cannot be read gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["virtual_path", "path_id", "class_id", "class_name", "byte_size", "value", "error"]
        for frame in frames:
            rows = []
            for path, content in zip(frame["virtual_path"], frame["content"]):
                try:
                    rows += [(path, o["path_id"], o["class_id"], o["class_name"], o["byte_size"], json.dumps(o["value"]) if o["value"] is not None else None, None) for o in read_objects(bytes(content))]
                except Exception as e:  # a broken file is a row, whatever broke it
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("virtual_path", "content").mapInPandas(run, "virtual_path string, path_id long, class_id long, class_name string, byte_size long, value string, error string")
