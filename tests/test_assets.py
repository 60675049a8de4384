import numpy as np
import pandas as pd
import pytest

from stratasift.operators import assets


def test_skeleton_joins(spark):
    bones = spark.createDataFrame([("f", "m", 0, 10), ("f", "m", 1, 11), ("f", "m", 2, 12)], "file string, asset string, ix long, transform long")
    transforms = spark.createDataFrame([("f", 10, 1, None), ("f", 11, 2, 10)], "file string, transform long, object long, father long")
    objects = spark.createDataFrame([("f", 1, "Hips"), ("f", 2, "Spine")], "file string, object long, name string")
    got = sorted((r.ix, r.name, r.parent) for r in assets.resolve_skeleton(bones, transforms, objects).collect())
    assert got == [(0, "Hips", -1), (1, "Spine", 0), (2, "bone_12", -1)]


def test_renderers_and_slots(spark):
    pair = lambda rows, c: spark.createDataFrame([("f", *r) for r in rows], f"file string, {c}")
    r = assets.renderers_of(pair([(1,), (2,), (3,)], "mesh long"), pair([(1, 50)], "mesh long, renderer long"), pair([(1, 7), (2, 8)], "mesh long, object long"), pair([(7, 60), (8, 61)], "object long, renderer long"))
    assert {x.mesh: (x.renderer, x.is_skinned) for x in r.collect()} == {1: (50, True), 2: (61, False), 3: (None, False)}
    s = assets.texture_slots(pair([(50, 5, 0), (50, 6, 1)], "renderer long, material long, material_ix long"), pair([(5, "diffuse", "a", 1), (6, "diffuse", "b", 0), (6, "normal", "c", 1)], "material long, usage string, texture string, slot_ix long"))
    assert {x.usage: x.texture for x in s.collect()} == {"diffuse": "a", "normal": "c"}


def test_bounds_and_edges(spark):
    v = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 0.0), ("a", 0, 1, 2.0, 0.0, 0.0), ("a", 0, 9, 2.0, 9.0, 0.0)], "asset string, mesh int, ix int, x double, y double, z double")
    r = assets.bounds(v, 5).first()
    assert r.centre == [1, 0, 0] and r.radius == 1
    d = spark.createDataFrame([("a", [1.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "asset string, centre_declared array<double>, extent array<double>")
    x, y = assets.within_declared(assets.bounds(v, 5), d).first(), assets.within_declared(assets.bounds(v), d).first()
    assert x.strict and x.loose and not y.strict and not y.loose
    t = spark.createDataFrame([("a", 0, 1, 2), ("a", 0, 2, 3)], "asset string, i int, j int, k int")
    assert assets.triangle_edges(t).count() == 5


def test_matrices():
    bones = [{"parent": -1, "translation": [0, 1, 0], "rotation": [0, 0, 0.5**0.5, 0.5**0.5], "scale": [1, 1, 1]}, {"parent": 0, "translation": [1, 0, 0], "rotation": [0, 0, 0, 1], "scale": [2, 2, 2]}]
    m = assets.joint_matrices(bones)
    assert m[1][:3, 3] == pytest.approx([0, 2, 0])
    moved = assets.skin(pd.DataFrame({"x": [1.0], "y": [0.0], "z": [0.0], "joints": [[0, 1]], "weights": [[1.0, 0.0]]}), m)
    assert moved[0] == pytest.approx([0, 2, 0])
    binds = np.stack([np.eye(4), np.eye(4)])
    binds[1][1, 3] = -2
    assert assets.rebind(binds, [-1, 0])[1][:3, 3] == pytest.approx([0, 2, 0])
    assert (assets.rebind(np.zeros((1, 4, 4)), [-1])[0] == np.eye(4)).all()
