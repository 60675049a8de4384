"""Joins and geometry over decoded assets: skeletons, renderers, texture slots, bounds, edges, skinning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_skeleton(bones: DataFrame, transforms: DataFrame, objects: DataFrame) -> DataFrame:
    """(asset, ix, name, parent) of bones (asset, ix, transform): names by transform and object, parents by transform.

    transforms is (file, transform, object, father), objects (file, object, name), bones also
    carries file. A bone without a named object is called by its transform's number.
    """
    t = bones.join(transforms, ["file", "transform"], "left").join(objects, ["file", "object"], "left")
    up = bones.select("file", "asset", F.col("transform").alias("father"), F.col("ix").alias("parent"))
    return t.join(up, ["file", "asset", "father"], "left").select("asset", "ix", F.coalesce("name", F.concat(F.lit("bone_"), F.col("transform").cast("string"))).alias("name"), F.coalesce("parent", F.lit(-1)).alias("parent"))


def renderers_of(meshes: DataFrame, skinned: DataFrame, filters: DataFrame, plain: DataFrame) -> DataFrame:
    """(file, mesh, renderer, is_skinned): a skinned renderer of the mesh, else the renderer beside a filter that holds it."""
    s = skinned.groupBy("file", "mesh").agg(F.min("renderer").alias("s"))
    p = filters.join(plain, ["file", "object"]).groupBy("file", "mesh").agg(F.min("renderer").alias("p"))
    j = meshes.join(s, ["file", "mesh"], "left").join(p, ["file", "mesh"], "left")
    return j.select("file", "mesh", F.coalesce("s", "p").alias("renderer"), F.col("s").isNotNull().alias("is_skinned"))


def texture_slots(renderer_materials: DataFrame, material_textures: DataFrame) -> DataFrame:
    """(file, renderer, usage, texture): of several slots of one usage, the first by material and slot order."""
    j = renderer_materials.join(material_textures, ["file", "material"])
    return j.groupBy("file", "renderer", "usage").agg(F.min_by("texture", F.struct("material_ix", "slot_ix")).alias("texture"))


def bounds(vertices: DataFrame, first: int | None = None) -> DataFrame:
    """(asset, low, high, centre, radius) of long-form vertices (asset, mesh, ix, x, y, z); `first` limits vertices a mesh for framing."""
    v = vertices if first is None else vertices.where(F.col("ix") < first)
    axes = ("x", "y", "z")
    b = v.groupBy("asset").agg(F.array(*[F.min(a) for a in axes]).alias("low"), F.array(*[F.max(a) for a in axes]).alias("high"))
    span = F.zip_with("low", "high", lambda a, c: c - a)
    radius = F.sqrt(F.aggregate(span, F.lit(0.0), lambda s, d: s + d * d)) / 2
    return b.select("asset", "low", "high", F.zip_with("low", "high", lambda a, c: (a + c) / 2).alias("centre"), radius.alias("radius"))


def within_declared(found: DataFrame, declared: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(asset, strict, loose): whether found bounds keep to the declared centre and extent, within a share, and within 4 extents and 1."""
    j = found.join(declared, "asset")
    each = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("centre_declared", "extent"), lambda a, d: F.struct(F.greatest(d.centre_declared - d.extent - a.low, a.high - d.centre_declared - d.extent).alias("excess"), d.extent.alias("extent")))
    return j.select("asset", F.forall(each, lambda e: e.excess <= F.greatest(e.extent * tolerance, F.lit(1e-4))).alias("strict"), F.forall(each, lambda e: e.excess <= e.extent * 3 + 1).alias("loose"))


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """Distinct undirected edges (asset, a, b) of triangles (asset, i, j, k)."""
    e = triangles.select("asset", F.explode(F.array(F.struct(F.col("i").alias("p"), F.col("j").alias("q")), F.struct(F.col("j").alias("p"), F.col("k").alias("q")), F.struct(F.col("k").alias("p"), F.col("i").alias("q")))).alias("e"))
    return e.select("asset", F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b")).distinct()


def joint_matrices(bones: list[dict], inverse_binds: np.ndarray | None = None) -> np.ndarray:
    """World matrices of bones (parent, translation, rotation, scale), times their inverse binds if given."""
    world = np.zeros((len(bones), 4, 4))
    done: set[int] = set()

    def place(i: int) -> np.ndarray:
        if i not in done:
            b = bones[i]
            x, y, z, w = b["rotation"]
            m = np.eye(4)
            m[:3, :3] = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]) * np.asarray(b["scale"], float)
            m[:3, 3] = b["translation"]
            world[i] = place(b["parent"]) @ m if b["parent"] >= 0 else m
            done.add(i)
        return world[i]

    for i in range(len(bones)):
        place(i)
    return world if inverse_binds is None else world @ inverse_binds


def skin(vertices: pd.DataFrame, matrices: np.ndarray) -> np.ndarray:
    """Positions of vertices (x, y, z, joints, weights) moved by their joints: the sum of weight times matrix times point."""
    points = np.concatenate([vertices[["x", "y", "z"]].to_numpy(float), np.ones((len(vertices), 1))], axis=1)
    joints, weights = np.stack(vertices["joints"].to_numpy()), np.stack(vertices["weights"].to_numpy()).astype(float)
    return np.einsum("vj,vjab,vb->va", weights, matrices[joints], points)[:, :3]


def rebind(inverse_binds: np.ndarray, parents: list[int]) -> np.ndarray:
    """Local matrices of a bind pose from inverse binds; a singular one counts as the identity."""
    world = np.stack([np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-12 else np.eye(4) for m in inverse_binds])
    return np.stack([np.linalg.inv(world[p]) @ w if p >= 0 else w for w, p in zip(world, parents)])


def tracks_to_nodes(tracks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(clip, bone, node) of tracks (clip, bone): the first node (node, bone) of that name, null where an export drops the track."""
    first = nodes.groupBy("bone").agg(F.min("node").alias("node"))
    return tracks.select("clip", "bone").join(first, "bone", "left").select("clip", "bone", "node")


def resolve_package_index(refs: DataFrame, index: str, exports: DataFrame, imports: DataFrame, name: str) -> DataFrame:
    """refs with the name that a signed index points at: n is the n-th export, -n the n-th import, 0 "None", others "?".

    exports and imports are (number, name), from 1. One equi-join over both tables.
    """
    targets = exports.select(F.col("number").cast("long").alias("at__"), F.col("name").alias(name)).unionByName(imports.select((-F.col("number")).cast("long").alias("at__"), F.col("name").alias(name)))
    found = refs.join(targets, F.col(index) == F.col("at__"), "left").drop("at__")
    return found.withColumn(name, F.when(F.col(index) == 0, "None").otherwise(F.coalesce(name, F.lit("?"))))
