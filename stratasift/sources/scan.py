"""Scanning file trees into DataFrames: listing, detection, and container expansion to a bounded fixpoint."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasift.functions import bytes_
from stratasift.operators import relational
from stratasift.rules.signatures import CONTAINER_CATEGORIES, SIGNATURES, extension_rows

#: How soon a file is looked at, by its extension.
MODEL_EXTENSIONS = "obj fbx gltf glb dae ply stl".split()
CONTAINER_EXTENSIONS = "zip 7z rar tar gz pak iso bin bundle assets".split()
HEADER = 65_536 + 64

MEMBER_SCHEMA = "container string, format string, virtual_path string, content binary, error string"


def priority(name: Column) -> Column:
    """80 for models, 70 for containers, 50 for the rest."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(ext.isin(MODEL_EXTENSIONS), 80).when(ext.isin(CONTAINER_EXTENSIONS), 70).otherwise(50)


def read_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """virtual_path, size, mtime, content, error of all files below a folder; content of files over max_bytes is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:(//)?", "")
    path = F.regexp_replace("path", "^file:(//)?", "")
    rel = F.substr(path, F.length(base) + 2)
    large = F.col("length") > F.lit(max_bytes if max_bytes is not None else 1 << 62)
    return files.select(rel.alias("virtual_path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.when(~large, F.col("content")).alias("content"), F.when(large, F.concat("path", F.lit(" (too large)"))).alias("error"))


#: Fixed value: the line of a cue sheet that names a track's file.
TRACK_LINE = r'(?im)^[ \t]*FILE[ \t]+("[^"\r\n]*"|[^\s"]+)'


def cue_tracks(files: DataFrame) -> DataFrame:
    """cue, track, found: the files that the cue sheets among files (virtual_path, content) name, and whether they stand beside them."""
    sheets = files.where(F.lower("virtual_path").endswith(".cue") & F.col("content").isNotNull())
    named = F.regexp_extract_all(F.make_valid_utf8(F.col("content").cast("string")), F.lit(TRACK_LINE), F.lit(1))
    folder = F.regexp_extract("virtual_path", r"^(.*/)?[^/]*$", 1)
    tracks = sheets.select(F.col("virtual_path").alias("cue"), folder.alias("folder"), F.explode(named).alias("name")).select("cue", F.concat("folder", F.btrim("name", F.lit('"'))).alias("track"))
    there = files.select(F.col("virtual_path").alias("track"), F.lit(True).alias("found"))
    return tracks.join(there, "track", "left").select("cue", "track", F.coalesce("found", F.lit(False)).alias("found"))


def detect(spark: SparkSession, files: DataFrame) -> DataFrame:
    """virtual_path, format, category, confidence, engine: the arg-max of signature, text, extension and fallback rules.

    The signature table is fixed and small; its broadcast joins each file's head once.
    """
    rows = [(n, r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for n, r in enumerate(SIGNATURES)]
    s = F.broadcast(spark.createDataFrame(rows, "n int, magic string, format string, category string, place int, ext string, engine string, confidence double"))
    ext = F.lower(F.regexp_extract("virtual_path", r"\.([^./!]+)$", 1))
    heads = files.where("content is not null").select("virtual_path", ext.alias("own"), F.substring("content", 1, HEADER).alias("head"), F.col("content"))
    hit = F.hex(F.substr(F.col("head"), F.col("place") + 1, F.length("magic") / 2)) == F.col("magic")
    magic = heads.join(s, hit)
    agrees = (F.col("ext") == F.col("own")) & (F.col("ext") != "")
    fields = lambda rank, confidence, form, category, engine: [F.lit(rank).alias("rank") if isinstance(rank, int) else rank.alias("rank"), confidence.alias("confidence"), form.alias("format"), category.alias("category"), engine.alias("engine")]
    none = F.lit(None).cast("string")
    best = magic.select("virtual_path", "n", F.col("confidence").alias("c"), agrees.alias("agrees"), "format", "category", "engine")
    best = best.groupBy("virtual_path").agg(F.max_by(F.struct("c", "agrees", "format", "category", "engine"), F.struct("c", -F.col("n"))).alias("m"))
    first = best.select("virtual_path", *fields(0, F.least(F.lit(1.0), F.col("m.c") + F.when(F.col("m.agrees"), 0.03).otherwise(0.0)), F.col("m.format"), F.col("m.category"), F.col("m.engine")))

    text = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    textual = bytes_.looks_textual(F.col("content"))
    obj_lines = F.regexp_count(text, F.lit(r"(?m)^(v|vt|vn|f|o|g|usemtl|mtllib)\s"))
    low = F.lower(text)
    made = lambda form, category, c: F.struct(F.lit(form).alias("format"), F.lit(category).alias("category"), (F.lit(c) if isinstance(c, float) else c).alias("c"))
    rules = (
        F.when(low.startswith("<?xml") & low.contains("collada"), made("COLLADA (DAE)", "model", 0.96))
        .when(text.rlike(r"^\s*\{") & text.contains('"asset"') & text.contains('"version"'), made("glTF (JSON)", "model", 0.95))
        .when(text.startswith("ply"), made("PLY (ascii)", "model", 0.95))
        .when(low.startswith("solid ") & low.contains("facet normal"), made("STL (ascii)", "model", 0.94))
        .when(low.startswith("version 1") & low.rlike("skeleton|triangles"), made("Valve SMD", "model", 0.9))
        .when(text.rlike(r"^\s*HIERARCHY\s+ROOT"), made("BVH", "animation", 0.97))
        .when(obj_lines >= 4, made("Wavefront OBJ", "model", F.least(F.lit(0.97), 0.75 + 0.01 * obj_lines)))
        .when(low.rlike(r"(^|\n)newmtl "), made("Wavefront MTL", "other", 0.9))
    )
    second = heads.where(textual).select("virtual_path", rules.alias("r")).where("r is not null").select("virtual_path", *fields(1, F.col("r.c"), F.col("r.format"), F.col("r.category"), none))
    e = F.broadcast(spark.createDataFrame(extension_rows(), "own string, hint string, c double"))
    third = heads.join(e, "own").select("virtual_path", *fields(2, F.col("c"), F.concat(F.upper("own"), F.lit(" (by extension)")), F.col("hint"), none))
    packed = bytes_.compression_kind(F.col("content"))
    last = F.when(F.octet_length("content") == 0, 1.0).when(packed.isNotNull(), 0.55).when(textual, 0.4).otherwise(0.2)
    name = F.when(F.octet_length("content") == 0, "Empty file").when(packed.isNotNull(), F.concat(packed, F.lit(" data"))).when(textual, "Text data").otherwise("Unknown binary")
    # Headers without a magic number of their own: plausible integers decide.
    u32 = lambda at, big=False: bytes_.unsigned(F.col("head"), at, 4, big)
    size, head = F.octet_length("content"), F.hex(F.substring("head", 1, 16))
    renderware = u32(0).isin(0x10, 0x16, 0x1B, 0x24) & ((u32(8) >= 0x30000) | u32(8).between(1, 0x3F)) & u32(4).between(1, size)
    serialized = (size >= 64) & u32(8, True).between(5, 30) & ((u32(4, True) == 0) | (F.abs(u32(4, True) - size) <= 4096)) & (u32(12, True) < size) & (u32(0, True) > 0)
    timed = (u32(0) == 0x10) & ((u32(4) % 8) <= 3) & u32(8).between(12, size)
    afs = head.startswith("41465300") & u32(4).between(1, 999_999) & u32(8).between(8, size) & (u32(12) <= size)
    tail = F.hex(F.substr("content", F.greatest(F.lit(1), size - 255), F.lit(256)))
    binary = (
        F.when(afs, F.struct(made("CRI AFS archive", "archive", 0.95), F.lit("CRI Middleware").alias("engine")))
        .when(head.startswith("7363696D6974617200"), F.struct(made("Ubisoft Anvil forge archive", "game_container", 0.95), F.lit("Anvil").alias("engine")))
        .when(timed, F.struct(made("Sony TIM texture", "texture", 0.9), F.lit("PS1").alias("engine")))
        .when(head.startswith("54494D32"), F.struct(made("Sony TIM2 texture", "texture", 0.9), F.lit("PS2").alias("engine")))
        .when(head.startswith("00D1CE"), F.struct(made("Frostbite container", "game_container", 0.9), F.lit("Frostbite").alias("engine")))
        .when((u32(0) == 0x41) & u32(4).isin(0, 1) & u32(8).between(1, 4095), F.struct(made("Sony TMD model", "model", 0.8), F.lit("PS1").alias("engine")))
        .when(renderware, F.struct(F.when(u32(0) == 0x16, made("RenderWare Texture Dictionary (TXD)", "texture", 0.9)).when(u32(0) == 0x1B, made("RenderWare Animation (ANM)", "animation", 0.9)).when(u32(0) == 0x24, made("RenderWare Delta Morph", "model", 0.9)).otherwise(made("RenderWare Clump (DFF)", "model", 0.9)), F.lit("RenderWare").alias("engine")))
        .when(head.startswith("414B504B"), F.struct(made("Wwise audio package (.pck)", "audio", 0.95), F.lit("Wwise").alias("engine")))
        .when(tail.contains("E1126F5A"), F.struct(made("Unreal PAK", "game_container", 0.93), F.lit("Unreal").alias("engine")))
        .when(serialized, F.struct(made("Unity SerializedFile", "game_container", 0.72), F.lit("Unity").alias("engine")))
    )
    headed = heads.select("virtual_path", binary.alias("b")).where("b is not null").select("virtual_path", *fields(1, F.col("b.col1.c"), F.col("b.col1.format"), F.col("b.col1.category"), F.col("b.engine")))
    fourth = heads.select("virtual_path", *fields(3, last, name, F.when(packed.isNotNull(), "compressed").otherwise("unknown"), none))
    return relational.best_candidate(first.unionByName(second).unionByName(headed).unionByName(third).unionByName(fourth), "virtual_path")


def is_container(category: Column) -> Column:
    return category.isin(*CONTAINER_CATEGORIES)


def open_containers(files: DataFrame, max_bytes: int = 8 << 30, max_entries: int = 200_000, max_ratio: float = 200.0) -> DataFrame:
    """Members of each blob that is a container, one Arrow batch of files at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from stratasift.sources.archives import members_of

        columns = ["container", "format", "virtual_path", "content", "error"]
        for frame in frames:
            for path, content in zip(frame["virtual_path"], frame["content"]):
                rows = members_of(path, bytes(content), max_bytes, max_entries, max_ratio) if content is not None else []
                yield pd.DataFrame([(path, r["format"], f"{path}!{r['member']}" if r["member"] else None, r["content"], r["error"]) for r in rows], columns=columns)

    return files.select("virtual_path", "content").mapInPandas(run, MEMBER_SCHEMA)


def expand(spark: SparkSession, files: DataFrame, max_depth: int = 10, work_dir: str | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """All files and members to a nesting depth, and the problems met: (virtual_path, depth, content, hash), (virtual_path, reason).

    Each round opens the last round's containers once: content seen before, by its hash, is not
    opened again. Rounds are written to work_dir (the session's spark.checkpoint.dir when
    unset), so that no round recomputes another, and executors may be lost in between.
    """
    base = work_dir or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir or give work_dir")

    def keep(df: DataFrame) -> DataFrame:
        path = f"{base}/expand-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    level = keep(files.where("content is not null").select("virtual_path", F.lit(0).alias("depth"), "content", bytes_.content_hash(F.col("content")).alias("hash")))
    everything, opened, problems = level, None, None
    for depth in range(max_depth + 1):
        owners = relational.duplicate_owners(level, "hash", "virtual_path").where("not is_duplicate").select("virtual_path", "content", "hash")
        if opened is not None:
            owners = owners.join(opened, "hash", "left_anti")
        members = keep(open_containers(owners, **limits))
        if members.isEmpty():
            break
        if depth == max_depth:
            cut = members.where("error is null").select(F.col("container").alias("virtual_path"), F.lit(f"nesting depth limit of {max_depth} reached").alias("reason")).distinct()
            problems = cut if problems is None else problems.unionByName(cut)
            break
        bad = members.where("error is not null").select(F.col("container").alias("virtual_path"), F.col("error").alias("reason"))
        problems = bad if problems is None else problems.unionByName(bad)
        hashes = owners.select("hash")
        opened = keep(hashes if opened is None else opened.unionByName(hashes))
        level = keep(members.where("virtual_path is not null").select("virtual_path", F.lit(depth + 1).alias("depth"), "content", bytes_.content_hash(F.col("content")).alias("hash")))
        everything = everything.unionByName(level)
    if problems is None:
        problems = spark.createDataFrame([], "virtual_path string, reason string")
    return everything, problems
