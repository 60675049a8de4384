"""Expressions over names and paths: sanitising, normalising, tokens, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratasift.rules.engines import DEVICE_NAMES, NAME_NOISE

ILLEGAL = r'[\x00-\x1f<>:"|?*]'


def sanitize_component(name: Column) -> Column:
    """A name that any file system takes: illegal characters become `_`, edge blanks and final dots go, device names get a `_`."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(name, ILLEGAL, "_")), r"\.+$", "")
    clean = F.when((clean == "") | clean.isin(".", ".."), "_").otherwise(clean)
    reserved = F.upper(F.split_part(clean, F.lit("."), F.lit(1))).isin(*DEVICE_NAMES)
    return F.substring(F.when(reserved, F.concat(F.lit("_"), clean)).otherwise(clean), 1, 200)


def normalise_path(path: Column) -> Column:
    """A relative path without drive, root, `.` and `..`; null if it escapes its root or nothing is left."""
    raw = F.regexp_replace(path, r"\\", "/")
    raw = F.regexp_replace(F.regexp_replace(raw, r"^/+", ""), r"^[A-Za-z]:/*", "")
    parts = F.filter(F.split(raw, "/"), lambda p: ~p.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("escaped"))

    def step(state: Column, part: Column) -> Column:
        up, empty = part == "..", F.size(state.kept) == 0
        kept = F.when(up & ~empty, F.slice(state.kept, F.lit(1), F.greatest(F.size(state.kept) - 1, F.lit(0)))).when(up, state.kept).otherwise(F.concat(state.kept, F.array(part)))
        return F.struct(kept.alias("kept"), (state.escaped | (up & empty)).alias("escaped"))

    folded = F.aggregate(parts, start, step)
    return F.when(~folded.escaped & (F.size(folded.kept) > 0), F.array_join(F.transform(folded.kept, sanitize_component), "/"))


def slug(name: Column) -> Column:
    """Lower-case letters, digits and single underscores, 64 characters at most."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_"), "_+", "_")
    return F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 64)


def stem(name: Column) -> Column:
    """The last path segment without its last extension."""
    last = F.substring_index(name, "/", -1)
    return F.when(last.rlike(r"^.+\.[^.]+$"), F.regexp_replace(last, r"\.[^.]+$", "")).otherwise(last)


def name_tokens(name: Column) -> Column:
    """Sorted distinct lower-case words of the stem, without noise words and plain numbers."""
    words = F.split(F.lower(stem(name)), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$") & ~w.isin(*NAME_NOISE))
    return F.array_sort(F.array_distinct(kept))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays plus 0.1, 1 at most; 0 where nothing is shared."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, F.least(F.lit(1.0), shared / F.size(F.array_union(a, b)) + 0.1)).otherwise(F.lit(0.0))


def path_proximity(a: Column, b: Column) -> Column:
    """Common leading directories over the deeper depth, ignoring case; 0 where one has no directory."""
    folders = lambda p: F.slice(F.split(F.lower(p), "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    x, y = folders(a), folders(b)
    equal = F.zip_with(x, y, lambda i, j: F.coalesce(i == j, F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    common = F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), common / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


#: What a texture is used for, by the first pattern that its stem matches; otherwise diffuse.
USAGES = [
    ("normal", r"(_n|_nrm|_norm|normal|_nm)\b|_n$"),
    ("roughness", r"(rough|_r$|_rgh)"),
    ("metallic", r"(metal|_m$|_mtl)"),
    ("ao", r"(ambient|_ao\b|occlusion)"),
    ("emission", r"(emis|glow|_e$)"),
    ("specular", r"(spec|_s$)"),
    ("mask", r"(mask|_mk\b|opacity|alpha)"),
    ("diffuse", r"(diffuse|albedo|basecolor|base_color|_d$|_c$|col)"),
]


def texture_usage(name: Column) -> Column:
    s, out = F.lower(stem(name)), None
    for usage, pattern in USAGES:
        out = F.when(s.rlike(pattern), usage) if out is None else out.when(s.rlike(pattern), usage)
    return out.otherwise("diffuse")


def version_numbers(version: Column) -> Column:
    """The first three numbers of a dotted version: leading digits of each part, 0 where there are none."""
    numbers = F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda p: F.coalesce(F.when(p.rlike("^[0-9]"), F.regexp_extract(p, "^([0-9]+)", 1)).cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0))), 1, 3)
