"""Models converted to export formats, a row for each file that a model becomes."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from stratasift.sources import models

EXPORT_SCHEMA = "virtual_path string, form string, target string, content binary, error string"


def self_contained_gltf(m: dict) -> bytes:
    """The JSON form of a GLB, its buffer as a data URI."""
    glb = models.write_glb(m)
    (length,) = struct.unpack_from("<I", glb, 12)
    doc = json.loads(glb[20 : 20 + length])
    if doc.get("buffers"):
        (size,) = struct.unpack_from("<I", glb, 20 + length)
        held = glb[28 + length : 28 + length + size]
        doc["buffers"][0]["uri"] = "data:application/octet-stream;base64," + base64.b64encode(held[: doc["buffers"][0]["byteLength"]]).decode()
    return json.dumps(doc).encode()


def _obj(m: dict, stem: str) -> dict[str, bytes]:
    text, library = models.write_obj(m, f"{stem}.mtl")
    return {f"{stem}.obj": text.encode(), f"{stem}.mtl": library.encode()}


WRITE: dict[str, Callable[[dict, str], dict[str, bytes]]] = {
    "glb": lambda m, stem: {f"{stem}.glb": models.write_glb(m)},
    "gltf": lambda m, stem: {f"{stem}.gltf": self_contained_gltf(m)},
    "obj": _obj,
    "dae": lambda m, stem: {f"{stem}.dae": models.write_dae(m).encode()},
}


def export_models(files: DataFrame, forms: list[str]) -> DataFrame:
    """The models among files (virtual_path, content) in each form: EXPORT_SCHEMA.

    target is the file's name; folders and repeated names are the caller's (sinks.export_folder,
    sinks.unique_names). A form without a writer, a model without meshes, or one that is not
    valid gives a row with its error. Null content and other files give none.
    """

    def made(content: bytes, stem: str, parse: Callable) -> tuple[dict | None, str | None]:
        try:
            m = parse(content, stem)
            problems = models.validate(m)[0] if m["meshes"] else ["no meshes"]
            return m, "; ".join(problems) or None
        except Exception as e:  # a broken file is a row, whatever broke it
            return None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["virtual_path"], frame["content"]):
                stem, _, ext = path.rsplit("/", 1)[-1].rpartition(".")
                parse, rows = models.BY_EXTENSION.get(ext.lower()), []
                if parse is None or content is None:
                    continue
                m, problem = made(bytes(content), stem, parse)
                for form in forms:
                    wrong = problem or (None if form in WRITE else f"no writer for {form}")
                    try:
                        rows += [(path, form, None, None, wrong)] if wrong else [(path, form, name, data, None) for name, data in WRITE[form](m, stem).items()]
                    except Exception as e:
                        rows.append((path, form, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["virtual_path", "form", "target", "content", "error"])

    return files.select("virtual_path", "content").mapInPandas(run, EXPORT_SCHEMA)
