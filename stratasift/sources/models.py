"""Model and animation files as plain records: meshes, materials, bones, clips.

A model is {"format", "name", "meshes", "materials", "bones", "clips", "libraries"}. A mesh holds
numpy arrays: vertices (n, 3), normals and uvs where the file has them, indices (m,) of
triangles, joints and weights (n, 4) where skinned. `parse_models` maps files to rows.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def model(form: str, name: str) -> dict:
    return {"format": form, "name": name, "meshes": [], "materials": [], "bones": [], "clips": [], "libraries": []}


def mesh(name: str, vertices, indices, normals=None, uvs=None, material: int = -1, joints=None, weights=None) -> dict:
    return {
        "name": name, "vertices": np.asarray(vertices, float).reshape(-1, 3), "indices": np.asarray(indices, np.int64), "normals": np.asarray(normals if normals is not None else [], float).reshape(-1, 3),
        "uvs": np.asarray(uvs if uvs is not None else [], float).reshape(-1, 2), "material": material, "joints": joints, "weights": weights,
    }


def parse_obj(blob: bytes, name: str = "model") -> dict:
    """Wavefront OBJ. Corners with the same token share a vertex of their mesh; polygons become fans; bad lines are skipped."""
    out = model("OBJ", name)
    pools: dict[str, list] = {"v": [], "vt": [], "vn": []}
    names: list[str] = []
    groups: list[dict] = []

    def open_group(title: str, material: int) -> dict:
        groups.append({"name": title, "material": material, "corners": {}, "faces": []})
        return groups[-1]

    here = open_group(name, -1)
    for line in blob.decode("utf-8", "ignore").splitlines():
        tag, *rest = line.split() or [""]
        tag = tag.lower()
        try:
            if tag in pools:
                size = 2 if tag == "vt" else 3
                row = [float(x) for x in rest[:size]]
                pools[tag].append((row + [0.0] * size)[:size])
            elif tag == "f":
                for token in rest:
                    if token not in here["corners"]:
                        refs = [int(x) if x else 0 for x in (token.split("/") + ["", ""])[:3]]
                        lens = [len(pools[p]) for p in ("v", "vt", "vn")]
                        here["corners"][token] = [r - 1 if r > 0 else n + r if r < 0 else -1 for r, n in zip(refs, lens)]
                here["faces"].append(rest)
            elif tag in ("o", "g", "usemtl"):
                title = " ".join(rest)
                if tag == "usemtl":
                    if title not in names:
                        names.append(title)
                    if here["corners"]:
                        here = open_group(f"mesh_{len(groups)}", names.index(title))
                    here["material"] = names.index(title)
                else:
                    here = open_group(title or f"mesh_{len(groups)}", here["material"])
            elif tag == "mtllib":
                out["libraries"].append(" ".join(rest))
        except (ValueError, IndexError):
            continue
    for g in groups:
        if not g["corners"]:
            continue
        number = {token: i for i, token in enumerate(g["corners"])}
        pick = lambda pool, which, blank: [pools[pool][c[which]] if 0 <= c[which] < len(pools[pool]) else blank for c in g["corners"].values()]
        has = lambda pool, which: any(0 <= c[which] < len(pools[pool]) for c in g["corners"].values())
        indices = [number[t] for face in g["faces"] for i in range(1, len(face) - 1) for t in (face[0], face[i], face[i + 1])]
        out["meshes"].append(mesh(g["name"], pick("v", 0, [0.0] * 3), indices, pick("vn", 2, [0.0, 0.0, 1.0]) if has("vn", 2) else None, pick("vt", 1, [0.0, 0.0]) if has("vt", 1) else None, g["material"]))
    if not out["meshes"] and pools["v"]:
        out["meshes"].append(mesh(name, pools["v"], []))
    out["materials"] = [{"name": n, "base_color": [0.8, 0.8, 0.8, 1.0], "roughness": 0.5, "textures": {}} for n in names]
    return out


#: What the texture keys of MTL files stand for.
MTL_KEYS = {"map_kd": "diffuse", "map_ks": "specular", "map_bump": "normal", "bump": "normal", "norm": "normal", "map_ke": "emission", "map_d": "mask", "map_pr": "roughness", "map_pm": "metallic"}


def parse_mtl(blob: bytes) -> list[dict]:
    """Materials of an MTL file: colour, roughness 1 - sqrt(Ns / 1000), textures by use."""
    out: list[dict] = []
    for line in blob.decode("utf-8", "ignore").splitlines():
        key, *rest = line.split() or [""]
        key = key.lower()
        if key == "newmtl":
            out.append({"name": " ".join(rest), "base_color": [0.8, 0.8, 0.8, 1.0], "roughness": 0.5, "textures": {}})
        elif out and key == "kd" and len(rest) >= 3:
            out[-1]["base_color"] = [*map(float, rest[:3]), 1.0]
        elif out and key == "ns" and rest:
            out[-1]["roughness"] = max(0.0, 1.0 - math.sqrt(min(1000.0, max(0.0, float(rest[0]))) / 1000))
        elif out and key in MTL_KEYS and rest:
            out[-1]["textures"][MTL_KEYS[key]] = rest[-1]
    return out


def parse_stl(blob: bytes, name: str = "model") -> dict:
    """STL, binary where the size fits the triangle count, otherwise text."""
    out = model("STL", name)
    (n,) = struct.unpack_from("<I", blob, 80) if len(blob) >= 84 else (0,)
    if n and 84 + 50 * n <= len(blob) <= 84 + 50 * n + 1024:
        rows = np.frombuffer(blob, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
        out["meshes"].append(mesh(name, rows["v"].reshape(-1, 3), np.arange(3 * n), np.repeat(rows["n"], 3, axis=0)))
        return out
    vertices = [[float(x) for x in w[1:4]] for w in (line.split() for line in blob.decode("utf-8", "ignore").splitlines()) if len(w) >= 4 and w[0].lower() == "vertex"]
    if not vertices:
        raise ValueError("no STL triangles")
    out["meshes"].append(mesh(name, vertices, np.arange(len(vertices) // 3 * 3)))
    return out


#: Scalar names of PLY headers.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse_ply(blob: bytes, name: str = "model") -> dict:
    """PLY text or binary in either byte order; the header gives the schema."""
    end = blob.index(b"end_header")
    body = blob.index(b"\n", end) + 1
    kind, elements = "ascii", []
    for line in blob[:end].decode("ascii", "ignore").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"] and elements:
            elements[-1][2].append((w[-1], PLY_TYPES[w[-2]], PLY_TYPES[w[2]] if w[1] == "list" else None))
    order = ">" if kind.endswith("big_endian") else "<"
    tokens = iter(blob[body:].split()) if kind == "ascii" else None
    at = body

    def take(form: str) -> float:
        nonlocal at
        if tokens is not None:
            return float(next(tokens))
        v = np.frombuffer(blob, order + form, 1, at)[0]
        at += np.dtype(form).itemsize
        return float(v)

    rows: dict[str, list] = {"x": [], "normal": [], "uv": []}
    indices: list[int] = []
    for element, count, properties in elements:
        for _ in range(count):
            row = {p: [take(f) for _ in range(int(take(n)))] if n else take(f) for p, f, n in properties}
            if element == "vertex":
                rows["x"].append([row["x"], row["y"], row["z"]])
                if "nx" in row:
                    rows["normal"].append([row["nx"], row["ny"], row["nz"]])
                u = next((k for k in ("u", "s", "texture_u") if k in row), None)
                if u:
                    rows["uv"].append([row[u], row[{"u": "v", "s": "t", "texture_u": "texture_v"}[u]]])
            elif element == "face":
                face = [int(i) for p in ("vertex_indices", "vertex_index") if p in row for i in row[p]]
                indices += [x for i in range(1, len(face) - 1) for x in (face[0], face[i], face[i + 1])]
    out = model("PLY", name)
    out["meshes"].append(mesh(name, rows["x"], indices, rows["normal"] or None, rows["uv"] or None))
    return out


#: glTF component types and the sizes of element types.
GLTF_COMPONENTS = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}
GLTF_SIZES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}


def parse_gltf(blob: bytes, name: str = "model", siblings: dict[str, bytes] | None = None) -> dict:
    """GLB or glTF: triangle meshes, materials, the first skin, animations. Buffers come from the GLB, data URIs or siblings."""
    binary = b""
    if blob[:4] == b"glTF":
        if len(blob) < 20:
            raise ValueError("truncated GLB")
        at, text = 12, None
        while at + 8 <= len(blob):
            size, kind = struct.unpack_from("<I4s", blob, at)
            if at + 8 + size > len(blob):
                raise ValueError("truncated GLB chunk")
            if kind == b"JSON":
                text = blob[at + 8 : at + 8 + size]
            elif kind == b"BIN\0":
                binary = blob[at + 8 : at + 8 + size]
            at += 8 + size
        if text is None:
            raise ValueError("GLB without JSON")
        g = json.loads(text)
    else:
        g = json.loads(blob)
    buffers = []
    for b in g.get("buffers", []):
        uri = b.get("uri")
        buffers.append(binary if uri is None else base64.b64decode(uri.split(",", 1)[1]) if uri.startswith("data:") else (siblings or {}).get(uri, b""))

    def accessor(i: int) -> np.ndarray:
        a = g["accessors"][i]
        form, width = np.dtype("<" + GLTF_COMPONENTS[a["componentType"]]), GLTF_SIZES[a["type"]]
        if "bufferView" not in a:
            return np.zeros((a["count"], width))
        v = g["bufferViews"][a["bufferView"]]
        start, step = v.get("byteOffset", 0) + a.get("byteOffset", 0), v.get("byteStride") or form.itemsize * width
        data = np.ndarray((a["count"], width), form, buffers[v["buffer"]], start, (step, form.itemsize))
        if a.get("normalized"):
            return np.maximum(data / np.iinfo(form).max, -1.0)
        return np.array(data)

    out = model("GLB" if blob[:4] == b"glTF" else "glTF", name)
    images = [x.get("name") or x.get("uri", "") for x in g.get("images", [])]
    for m in g.get("materials", []):
        p = m.get("pbrMetallicRoughness", {})
        slots = {"diffuse": p.get("baseColorTexture"), "metallic": p.get("metallicRoughnessTexture"), "normal": m.get("normalTexture"), "ao": m.get("occlusionTexture"), "emission": m.get("emissiveTexture")}
        used = {k: images[g["textures"][t["index"]]["source"]] for k, t in slots.items() if t and "source" in g["textures"][t["index"]]}
        out["materials"].append({"name": m.get("name", ""), "base_color": p.get("baseColorFactor", [1, 1, 1, 1]), "roughness": p.get("roughnessFactor", 1.0), "textures": used})
    for m in g.get("meshes", []):
        for p in m["primitives"]:
            if p.get("mode", 4) != 4:
                continue
            a = p["attributes"]
            read = lambda k: accessor(a[k]) if k in a else None
            v = accessor(a["POSITION"])
            indices = accessor(p["indices"]).ravel() if "indices" in p else np.arange(len(v))
            out["meshes"].append(mesh(m.get("name", name), v, indices, read("NORMAL"), read("TEXCOORD_0"), p.get("material", -1), read("JOINTS_0"), read("WEIGHTS_0")))
    nodes = g.get("nodes", [])
    up = {c: i for i, n in enumerate(nodes) for c in n.get("children", [])}
    joints = g["skins"][0]["joints"] if g.get("skins") else []
    for j in joints:
        n = nodes[j]
        out["bones"].append({"name": n.get("name", f"bone_{j}"), "parent": joints.index(up[j]) if up.get(j) in joints else -1, "translation": n.get("translation", [0, 0, 0]), "rotation": n.get("rotation", [0, 0, 0, 1]), "scale": n.get("scale", [1, 1, 1])})
    for c in g.get("animations", []):
        tracks: dict[str, dict] = {}
        last = 0.0
        for ch in c["channels"]:
            if "node" not in ch["target"]:
                continue
            s = c["samplers"][ch["sampler"]]
            t, v = accessor(s["input"]).ravel(), accessor(s["output"])
            last = max(last, float(t.max(initial=0)))
            tracks.setdefault(nodes[ch["target"]["node"]].get("name", ""), {})[ch["target"]["path"]] = list(zip(t.tolist(), v.tolist()))
        out["clips"].append({"name": c.get("name", "clip"), "duration": last, "tracks": tracks})
    return out


def euler_quaternion(degrees: list[float], order: str) -> tuple[float, float, float, float]:
    """(x, y, z, w) of rotations about the axes of `order`, the first outermost."""
    q = (0.0, 0.0, 0.0, 1.0)
    for angle, axis in zip(degrees, order):
        h = math.radians(angle) / 2
        r = [0.0, 0.0, 0.0, math.cos(h)]
        r["XYZ".index(axis)] = math.sin(h)
        ax, ay, az, aw = q
        bx, by, bz, bw = r
        q = (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)
    return q


def parse_bvh(blob: bytes, name: str = "clip") -> dict:
    """BVH: a joint hierarchy and frames of channel values; rotations become quaternions in channel order."""
    words = iter(blob.decode("utf-8", "ignore").split())
    out, stack, channels = model("BVH", name), [], []
    for w in words:
        w = w.upper()
        if w in ("ROOT", "JOINT"):
            out["bones"].append({"name": next(words), "parent": stack[-1] if stack else -1, "translation": [0, 0, 0], "rotation": [0, 0, 0, 1], "scale": [1, 1, 1]})
            current = len(out["bones"]) - 1
        elif w == "END":
            next(words)
            current = -1
        elif w == "{":
            stack.append(current)
        elif w == "}":
            stack.pop()
        elif w == "OFFSET":
            offset = [float(next(words)) for _ in range(3)]
            if stack[-1] >= 0:
                out["bones"][stack[-1]]["translation"] = offset
        elif w == "CHANNELS":
            channels += [(stack[-1], next(words)) for _ in range(int(next(words)))]
        elif w == "MOTION":
            break
    next(words)
    frames = int(next(words))
    next(words), next(words)
    step = float(next(words))
    tracks: dict[str, dict] = {}
    for f in range(frames):
        row: dict[int, dict] = {}
        try:
            for bone, channel in channels:
                kind = row.setdefault(bone, {"position": {}, "angles": [], "order": ""})
                v = float(next(words))
                if channel.lower().endswith("position"):
                    kind["position"][channel[0].upper()] = v
                else:
                    kind["angles"].append(v)
                    kind["order"] += channel[0].upper()
        except StopIteration:
            break
        for bone, kind in row.items():
            track = tracks.setdefault(out["bones"][bone]["name"], {})
            if kind["position"]:
                track.setdefault("translation", []).append((f * step, [kind["position"].get(a, 0.0) for a in "XYZ"]))
            if kind["angles"]:
                track.setdefault("rotation", []).append((f * step, list(euler_quaternion(kind["angles"], kind["order"]))))
    out["clips"].append({"name": name, "duration": max(0, frames - 1) * step, "frames": frames, "tracks": tracks})
    return out


def parse_template(blob: bytes, name: str = "model") -> dict:
    """The documented sample model: `MYM0`, vertex and index counts, positions, 16-bit indices."""
    if blob[:4] != b"MYM0":
        raise ValueError("not a template model")
    n, m = struct.unpack_from("<II", blob, 4)
    out = model("MYM", name)
    out["meshes"].append(mesh(name, np.frombuffer(blob, "<f4", 3 * n, 12), np.frombuffer(blob, "<u2", m, 12 + 12 * n)))
    return out


PARSERS: dict[str, Callable] = {"Wavefront OBJ": parse_obj, "STL (ascii)": parse_stl, "STL": parse_stl, "PLY": parse_ply, "PLY (ascii)": parse_ply, "GLB (glTF binary)": parse_gltf, "glTF (JSON)": parse_gltf, "BVH": parse_bvh, "Template model": parse_template}
BY_EXTENSION = {"obj": parse_obj, "stl": parse_stl, "ply": parse_ply, "glb": parse_gltf, "gltf": parse_gltf, "bvh": parse_bvh, "mym": parse_template}


def validate(m: dict) -> tuple[list[str], list[str]]:
    """Issues and warnings of a model: counts that disagree, indices out of range, broken hierarchies, empty clips."""
    issues, warnings = [], []
    if not m["meshes"]:
        return ["no mesh"], []
    for x in m["meshes"]:
        n = len(x["vertices"])
        if not n:
            issues.append(f"{x['name']}: no vertices")
        if len(x["indices"]) % 3:
            issues.append(f"{x['name']}: index count is no multiple of 3")
        if len(x["indices"]) and (x["indices"].max() >= n or x["indices"].min() < 0):
            issues.append(f"{x['name']}: out-of-range index")
        for part in ("normals", "uvs"):
            if len(x[part]) not in (0, n):
                warnings.append(f"{x['name']}: {part} count differs")
        if x["joints"] is not None:
            if len(x["joints"]) != n or x["weights"] is None or len(x["weights"]) != n:
                issues.append(f"{x['name']}: skin count differs")
            elif m["bones"] and np.max(x["joints"], initial=0) >= len(m["bones"]):
                issues.append(f"{x['name']}: joint outside the skeleton")
    for i, b in enumerate(m["bones"]):
        seen, at = {i}, b["parent"]
        while 0 <= at < len(m["bones"]) and at not in seen:
            seen.add(at)
            at = m["bones"][at]["parent"]
        if at != -1:
            issues.append(f"bone {b['name']}: " + ("cycle" if at in seen else "bad parent"))
    for c in m["clips"]:
        if not c["tracks"]:
            warnings.append(f"{c['name']}: no tracks")
        if c["duration"] <= 0:
            warnings.append(f"{c['name']}: no duration")
    return issues, warnings


def quality(m: dict) -> float:
    """Weighted existence of parts less penalties, 0 to 1; 0 without a mesh."""
    issues, warnings = validate(m)
    if not m["meshes"]:
        return 0.0
    any_of = lambda part: any(len(x[part]) for x in m["meshes"])
    score = 0.35 * any_of("vertices") + 0.15 * any_of("indices") + 0.05 * any_of("normals") + 0.1 * any_of("uvs") + 0.05 * bool(m["materials"]) + 0.1 * any(x["textures"] for x in m["materials"])
    score += 0.1 * bool(m["bones"]) + 0.1 * bool(m["clips"]) - 0.25 * len(issues) - 0.03 * len(warnings)
    return max(0.0, min(1.0, score))


def write_glb(m: dict) -> bytes:
    """A GLB of the meshes, materials, skeleton and clips."""
    data = bytearray()
    g: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": [], "buffers": [{}]}

    def put(values: np.ndarray, component: int, kind: str, bounds: bool = False) -> int:
        raw = np.ascontiguousarray(values, dtype="<" + GLTF_COMPONENTS[component]).tobytes()
        data.extend(b"\0" * (-len(data) % 4))
        g["bufferViews"].append({"buffer": 0, "byteOffset": len(data), "byteLength": len(raw)})
        data.extend(raw)
        a = {"bufferView": len(g["bufferViews"]) - 1, "componentType": component, "count": len(values), "type": kind}
        if bounds and len(values):
            flat = np.asarray(values, "<f4").reshape(len(values), -1)
            a |= {"min": flat.min(axis=0).tolist(), "max": flat.max(axis=0).tolist()}
        g["accessors"].append(a)
        return len(g["accessors"]) - 1

    if m["materials"]:
        g["materials"] = [{"name": x["name"], "pbrMetallicRoughness": {"baseColorFactor": list(map(float, x["base_color"])), "roughnessFactor": float(x["roughness"])}} for x in m["materials"]]
    for b in m["bones"]:
        g["nodes"].append({"name": b["name"], "translation": list(map(float, b["translation"])), "rotation": list(map(float, b["rotation"])), "scale": list(map(float, b["scale"]))})
    for i, b in enumerate(m["bones"]):
        if b["parent"] >= 0:
            g["nodes"][b["parent"]].setdefault("children", []).append(i)
        else:
            g["scenes"][0]["nodes"].append(i)
    if m["bones"]:
        g["skins"] = [{"joints": list(range(len(m["bones"])))}]
    for x in m["meshes"]:
        a = {"POSITION": put(x["vertices"], 5126, "VEC3", True)}
        if len(x["normals"]) == len(x["vertices"]) and len(x["normals"]):
            a["NORMAL"] = put(x["normals"], 5126, "VEC3")
        if len(x["uvs"]) == len(x["vertices"]) and len(x["uvs"]):
            a["TEXCOORD_0"] = put(x["uvs"], 5126, "VEC2")
        skinned = x["joints"] is not None and m["bones"]
        if skinned:
            w = np.asarray(x["weights"], float)
            total = w.sum(axis=1, keepdims=True)
            a |= {"JOINTS_0": put(np.asarray(x["joints"]), 5123, "VEC4"), "WEIGHTS_0": put(w / np.where(total == 0, 1, total), 5126, "VEC4")}
        p = {"attributes": a, "indices": put(x["indices"], 5125, "SCALAR")} if len(x["indices"]) else {"attributes": a}
        if 0 <= x["material"] < len(m["materials"]):
            p["material"] = x["material"]
        g["meshes"].append({"name": x["name"], "primitives": [p]})
        g["nodes"].append({"name": x["name"], "mesh": len(g["meshes"]) - 1, **({"skin": 0} if skinned else {})})
        g["scenes"][0]["nodes"].append(len(g["nodes"]) - 1)
    place = {b["name"]: i for i, b in enumerate(m["bones"])}
    for c in m["clips"]:
        made = {"name": c["name"], "channels": [], "samplers": []}
        for bone, channels in c["tracks"].items():
            for path, keys in channels.items():
                if bone in place and keys:
                    t, v = zip(*keys)
                    made["samplers"].append({"input": put(np.array(t), 5126, "SCALAR", True), "output": put(np.array(v), 5126, "VEC4" if path == "rotation" else "VEC3")})
                    made["channels"].append({"sampler": len(made["samplers"]) - 1, "target": {"node": place[bone], "path": path}})
        if made["channels"]:
            g.setdefault("animations", []).append(made)
    data.extend(b"\0" * (-len(data) % 4))
    g["buffers"] = [{"byteLength": len(data)}]
    text = json.dumps({k: v for k, v in g.items() if v != []}, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    return b"glTF" + struct.pack("<II", 2, 28 + len(text) + len(data)) + struct.pack("<I", len(text)) + b"JSON" + text + struct.pack("<I", len(data)) + b"BIN\0" + bytes(data)


def write_obj(m: dict, library: str = "model.mtl") -> tuple[str, str]:
    """OBJ and MTL texts; skeletons and clips have no place in them."""
    lines, base = [f"mtllib {library}"], 1
    for x in m["meshes"]:
        lines.append(f"o {x['name']}")
        lines += [f"v {a:g} {b:g} {c:g}" for a, b, c in x["vertices"]]
        has_uv, has_n = len(x["uvs"]) == len(x["vertices"]), len(x["normals"]) == len(x["vertices"])
        lines += [f"vt {a:g} {b:g}" for a, b in x["uvs"]] if has_uv else []
        lines += [f"vn {a:g} {b:g} {c:g}" for a, b, c in x["normals"]] if has_n else []
        if 0 <= x["material"] < len(m["materials"]):
            lines.append(f"usemtl {m['materials'][x['material']]['name']}")
        corner = lambda i: f"{i}/{i if has_uv else ''}/{i if has_n else ''}".rstrip("/")
        lines += ["f " + " ".join(corner(int(i) + base) for i in t) for t in x["indices"][: len(x["indices"]) // 3 * 3].reshape(-1, 3)]
        base += len(x["vertices"])
    mtl = [f"newmtl {x['name']}\nKd {' '.join(f'{v:g}' for v in x['base_color'][:3])}\nNs {1000 * (1 - x['roughness']) ** 2:g}" for x in m["materials"]]
    return "\n".join(lines) + "\n", "\n".join(mtl) + "\n"


def write_dae(m: dict) -> str:
    """COLLADA with geometry, materials and the bone hierarchy; skins and clips are left out."""
    from xml.sax.saxutils import quoteattr

    nums = lambda a: " ".join(f"{v:g}" for v in np.asarray(a).ravel())
    geometry, scene = [], []
    for i, x in enumerate(m["meshes"]):
        parts = [("POSITION", x["vertices"], "X Y Z")] + ([("NORMAL", x["normals"], "X Y Z")] if len(x["normals"]) else []) + ([("TEXCOORD", x["uvs"], "S T")] if len(x["uvs"]) else [])
        sources = ""
        for kind, rows, axes in parts:
            params = "".join(f'<param name="{a}" type="float"/>' for a in axes.split())
            sources += f'<source id="g{i}-{kind}"><float_array id="g{i}-{kind}-a" count="{rows.size}">{nums(rows)}</float_array><technique_common><accessor source="#g{i}-{kind}-a" count="{len(rows)}" stride="{rows.shape[1]}">{params}</accessor></technique_common></source>'
        inputs = f'<input semantic="VERTEX" source="#g{i}-v" offset="0"/>' + "".join(f'<input semantic="{kind}" source="#g{i}-{kind}" offset="0"/>' for kind, _, _ in parts[1:])
        geometry.append(f'<geometry id="g{i}" name={quoteattr(x["name"])}><mesh>{sources}<vertices id="g{i}-v"><input semantic="POSITION" source="#g{i}-POSITION"/></vertices><triangles count="{len(x["indices"]) // 3}">{inputs}<p>{" ".join(map(str, x["indices"]))}</p></triangles></mesh></geometry>')
        scene.append(f'<node id="n{i}" name={quoteattr(x["name"])}><instance_geometry url="#g{i}"/></node>')
    children: dict[int, list[int]] = {}
    for i, b in enumerate(m["bones"]):
        children.setdefault(b["parent"], []).append(i)

    def joint(i: int) -> str:
        b = m["bones"][i]
        return f'<node id="b{i}" name={quoteattr(b["name"])} type="JOINT"><translate>{nums(b["translation"])}</translate>{"".join(map(joint, children.get(i, [])))}</node>'

    scene += [joint(i) for i in children.get(-1, [])]
    return f'<?xml version="1.0" encoding="utf-8"?><COLLADA xmlns="http://www.collada.org/2005/11/COLLADASchema" version="1.4.1"><asset><up_axis>Y_UP</up_axis></asset><library_geometries>{"".join(geometry)}</library_geometries><library_visual_scenes><visual_scene id="scene">{"".join(scene)}</visual_scene></library_visual_scenes><scene><instance_visual_scene url="#scene"/></scene></COLLADA>'


ROW = "virtual_path string, format string, meshes int, vertices long, triangles long, materials int, bones int, clips int, skinned boolean, valid boolean, issues array<string>, warnings array<string>, quality double, error string"


def parse_models(files: DataFrame) -> DataFrame:
    """One row for each file (virtual_path, content) whose extension names a model: counts, validity, quality, or the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in ROW.replace("array<string>", "x").split(",")]
        for frame in frames:
            rows = []
            for path, content in zip(frame["virtual_path"], frame["content"]):
                parser = BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower())
                if parser is None or content is None:
                    continue
                try:
                    m = parser(bytes(content), path.rsplit("/", 1)[-1].rsplit(".", 1)[0])
                    issues, warnings = validate(m) if m["format"] != "BVH" else ([], [])
                    rows.append((path, m["format"], len(m["meshes"]), sum(len(x["vertices"]) for x in m["meshes"]), sum(len(x["indices"]) // 3 for x in m["meshes"]), len(m["materials"]), len(m["bones"]), len(m["clips"]),
                                 any(x["joints"] is not None for x in m["meshes"]), not issues, issues, warnings, quality(m), None))
                except Exception as e:  # a broken file is a row, whatever broke it
                    rows.append((path, None, *[0] * 6, False, False, [], [], 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return files.select("virtual_path", "content").mapInPandas(run, ROW)
