import json

from stratasift.sources import exports, models

OBJ = b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n"


def test_export_models(spark):
    files = [("a/t.obj", OBJ), ("b/broken.glb", b"glTF"), ("c/none.obj", None), ("d/x.txt", b"x"), ("e/empty.obj", b"")]
    rows = exports.export_models(spark.createDataFrame(files, "virtual_path string, content binary"), ["glb", "gltf", "obj", "dae", "fbx"]).collect()
    by = {(r.virtual_path, r.form, r.target): r for r in rows}
    assert {k[2] for k in by if k[0] == "a/t.obj"} == {"t.glb", "t.gltf", "t.obj", "t.mtl", "t.dae", None}
    assert by["a/t.obj", "fbx", None].error == "no writer for fbx"
    for form in ("glb", "gltf"):
        (mesh,) = models.parse_gltf(bytes(by["a/t.obj", form, f"t.{form}"].content))["meshes"]
        assert len(mesh["vertices"]) == 3 and list(mesh["indices"]) == [0, 1, 2]
    assert json.loads(by["a/t.obj", "gltf", "t.gltf"].content)["buffers"][0]["uri"].startswith("data:")
    assert len(models.parse_obj(bytes(by["a/t.obj", "obj", "t.obj"].content))["meshes"]) == 1
    assert all(by["b/broken.glb", f, None].error and by["e/empty.obj", f, None].error for f in ("glb", "obj"))
    assert {r.virtual_path for r in rows} == {"a/t.obj", "b/broken.glb", "e/empty.obj"}
